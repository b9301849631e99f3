"""Version lineage (V1-V5), heads, history and number allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators.scores import avg_score_by_version, feedback_summary


def head_versions(versions: DataFrame) -> DataFrame:
    """The row of each prompt's latest version."""
    last = Window.partitionBy("prompt_id").orderBy(F.desc("version"))
    return versions.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def latest_version(prompts: DataFrame, versions: DataFrame) -> DataFrame:
    """Latest version number of every prompt, 0 when it has none."""
    heads = versions.groupBy(F.col("prompt_id").alias("id")).agg(F.max("version").alias("_v"))
    return prompts.join(heads, "id", "left").select("id", F.coalesce("_v", F.lit(0)).cast("long").alias("latest_version"))


def version_history(versions: DataFrame, scores: DataFrame, runs: DataFrame) -> DataFrame:
    """Every version with its mean score and the change from the version before."""
    scored = versions.join(avg_score_by_version(scores, runs), ["prompt_id", "version"], "left")
    before = F.lag("avg_score").over(Window.partitionBy("prompt_id").orderBy("version"))
    return scored.select("prompt_id", "version", "created_at", "created_by", "avg_score", (F.col("avg_score") - before).alias("change"))


def versions_of(versions: DataFrame, prompt_id: int) -> DataFrame:
    """V1: a prompt's versions in order."""
    return versions.where(F.col("prompt_id") == prompt_id).orderBy("version")


def version_at(versions: DataFrame, prompt_id: int, version: int) -> DataFrame:
    """V1: one version of a prompt."""
    return versions.where((F.col("prompt_id") == prompt_id) & (F.col("version") == version))


def allocate_versions(new: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """Number a batch of new versions after those that exist; one writer a table."""
    heads = existing.groupBy("prompt_id").agg(F.max("version").alias("_head"))
    place = F.row_number().over(Window.partitionBy("prompt_id").orderBy(order))
    return new.join(heads, "prompt_id", "left").withColumn("version", (F.coalesce("_head", F.lit(0)) + place).cast("long")).drop("_head")


def record_versions(new: DataFrame, existing: DataFrame, order: str, author: str = "human") -> DataFrame:
    """V2: rows to append: numbered, with the head before the batch, or the row before, as parent."""
    numbered = allocate_versions(new, existing, order)
    parent = F.when(F.col("version") > 1, F.col("version") - 1)
    return numbered.withColumn("parent_version", parent).withColumn("created_by", F.lit(author))


def rollback(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """V3: a new head with an old version's content; a version that does not exist gives an error row.

    ``requests`` is ``(prompt_id, to_version)``, one row a prompt.
    """
    target = versions.select("prompt_id", F.col("version").alias("to_version"), "template")
    heads = versions.groupBy("prompt_id").agg(F.max("version").alias("_head"))
    found = requests.join(target, ["prompt_id", "to_version"], "left").join(heads, "prompt_id", "left")
    ok = F.col("template").isNotNull()
    return found.select(
        "prompt_id",
        F.when(ok, F.col("_head") + 1).alias("version"),
        F.when(ok, F.col("to_version")).alias("parent_version"),
        "template",
        F.when(ok, rollback_note(F.col("to_version"))).alias("note"),
        F.when(~ok, F.lit("no such version")).alias("error"),
    )


def version_line_changes(pairs: DataFrame, versions: DataFrame) -> DataFrame:
    """V4: lines added, removed and kept between two versions, the n-th copy of a line with the n-th.

    ``pairs`` is ``(prompt_id, old, new)``.
    """

    def lines(which: str) -> DataFrame:
        of = versions.select("prompt_id", F.col("version").alias(which), F.explode(F.split("template", "(?<=[.])\\s")).alias("line"))
        each = pairs.join(of, ["prompt_id", which])
        nth = F.row_number().over(Window.partitionBy("prompt_id", "old", "new", "line").orderBy("line"))
        return each.withColumn("nth", nth).select("prompt_id", "old", "new", "line", "nth", F.lit(True).alias(f"in_{which}"))

    both = lines("old").join(lines("new"), ["prompt_id", "old", "new", "line", "nth"], "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").otherwise("kept")
    return both.select("prompt_id", "old", "new", "line", "nth", change.alias("change"))


def run_note(prefix: Column, run_id: Column, n: Column) -> Column:
    """What a version made from a run says of it."""
    return F.format_string("%s from run %s (%d feedback)", prefix, run_id.cast("string"), n)


def rollback_note(to_version: Column) -> Column:
    """What a version that goes back to another says."""
    return F.concat(F.lit("rollback to v"), to_version.cast("string"))


def fork_versions(runs: DataFrame, feedback: DataFrame, versions: DataFrame) -> DataFrame:
    """V5: a new version from each run's version, noting the run and how much feedback it had."""
    n = runs.join(feedback_summary(feedback), "run_id", "left").select(
        "run_id", F.col("target_id").alias("prompt_id"), F.col("target_version").alias("parent_version"), F.coalesce("n", F.lit(0)).alias("n")
    )
    return allocate_versions(n.withColumn("note", run_note(F.lit("iterate"), F.col("run_id"), F.col("n"))).drop("n"), versions, "run_id")
