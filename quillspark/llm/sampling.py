"""Held-out folds and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """True where crc32 of the id as text is divisible by ``folds``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def bounded_sample(keys: DataFrame, label: str, per_label: int, seed: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``per_label`` rows of each label, those of the least seeded hashes of their ids.

    Rows pass by a threshold on the hash that leaves each label little more than its share, so only
    about ``per_label`` rows a label are ranked.
    """
    order = F.xxhash64(F.lit(seed), F.col(id_col))
    counts = keys.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"))
    share = F.pmod(order, F.lit(1 << 40)) / float(1 << 40)
    # One row a label: as many as a model has classes.
    near = keys.join(F.broadcast(counts), F.col(label) == F.col("_label")).where(share * F.col("_n") < 1.3 * per_label + 50)
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_share", id_col))
    return near.withColumn("_share", share).withColumn("_rank", rank).where(F.col("_rank") <= per_label).select(*keys.columns)
