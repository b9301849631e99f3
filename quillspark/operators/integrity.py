"""Set operations, upserts and integrity checks (Q1-Q10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh_cases(new: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """Q1: rows whose key is not stored yet, one a key (copies inside the batch go as well)."""
    return new.join(existing.select(key), key, "left_anti").dropDuplicates([key])


def add_evidence(old: DataFrame, new: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Q2: insert or ignore: of each key the earliest row stays."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    first = both.groupBy(*keys).agg(F.min(F.struct(at, *[c for c in rest if c != at])).alias("_f"))
    return first.select(*keys, *[F.col(f"_f.{c}").alias(c) for c in rest])


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q3: keys that several rows have, and how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def domain_violations(df: DataFrame, allowed: dict[str, Sequence], ranges: dict[str, tuple[float, float]] = {}) -> DataFrame:  # noqa: B006
    """Q4: rows with a value outside its list or range, or a null in a listed column, and which column."""
    bad = [F.when(F.col(c).isNull() | ~F.col(c).isin(*vs), F.lit(c)) for c, vs in allowed.items()]
    bad += [F.when(~F.col(c).between(lo, hi), F.lit(c)) for c, (lo, hi) in ranges.items()]
    return df.withColumn("violations", F.concat_ws(",", *bad)).where("violations <> ''")


def merge_snapshot(old: DataFrame, new: DataFrame, now: str, key: str = "id") -> DataFrame:
    """Q5: insert or update by key: new values win, ``first_seen_at`` stays, ``last_seen_at`` moves.

    Rows of ``old`` that the scan did not see stay as they are.
    """
    values = [c for c in new.columns if c != key]
    o, n = old.alias("o"), new.alias("n")
    seen = F.col(f"n.{key}").isNotNull()
    at = F.lit(now).cast("timestamp")
    pick = [F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in values]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(
        F.coalesce(f"n.{key}", f"o.{key}").alias(key),
        *pick,
        F.coalesce("o.first_seen_at", at).alias("first_seen_at"),
        F.when(seen, at).otherwise(F.col("o.last_seen_at")).alias("last_seen_at"),
        F.when(~seen, "kept").when(F.col(f"o.{key}").isNull(), "inserted").otherwise("updated").alias("action"),
    )


def orphans(existing: DataFrame, written: DataFrame, key: str = "id") -> DataFrame:
    """Q6: stored keys that the last scan did not write."""
    return existing.select(key).join(written.select(key), key, "left_anti").distinct()


def cascade_delete(child: DataFrame, parents: DataFrame, child_key: str, parent_key: str = "id") -> DataFrame:
    """Q7: the rows of ``child`` whose parent is left."""
    return child.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_semi")


def fk_violations(child: DataFrame, parents: DataFrame, child_key: str, parent_key: str = "id") -> DataFrame:
    """Q10: rows of ``child`` that point at no parent."""
    return child.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def merge_report(merged: DataFrame, gone: DataFrame) -> DataFrame:
    """How many rows a merge wrote, kept and removed."""
    counts = merged.groupBy("action").agg(F.count("*").alias("n"))
    return counts.unionByName(gone.agg(F.count("*").alias("n")).select(F.lit("removed").alias("action"), "n"))
