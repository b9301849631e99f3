"""Line dedup by overlapping windows of three lines; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.storage import materialise

WINDOW = 3


def line_windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``(doc_id, pos, h1, h2)``: a 128-bit hash of each run of ``width`` lines; none for shorter texts."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    starts = F.when(F.size("_l") >= width, F.sequence(F.lit(0), F.size("_l") - width)).otherwise(F.array().cast("array<int>"))
    # Each part of a window is one line: lines hold no line feed, so joining them loses nothing.
    joined = F.array_join(F.slice("_l", F.col("pos") + 1, F.lit(width)), "\n")
    return (
        docs.select(F.col("doc_id").alias("doc_id"), lines.alias("_l"))
        .select("doc_id", "_l", F.explode(starts).alias("pos"))
        .select("doc_id", "pos", joined.alias("_w"))
        .select("doc_id", "pos", F.xxhash64("_w").alias("h1"), F.xxhash64(F.lit(1), F.col("_w")).alias("h2"))
    )


def covered_spans(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``(doc_id, spans)``: sorted, disjoint line ranges ``[a, b)`` that later copies of windows cover.

    The first occurrence of a window is that of the smallest ``(doc_id, pos)``. First places come from
    a partial aggregation; windows join them back by hash, and a frequent window's rows may be split
    over tasks. Windows that overlap or touch are merged in the partition of their document.
    """
    windows = materialise(line_windows(docs, width), "windows")
    repeated = (
        windows.groupBy("h1", "h2").agg(F.count("*").alias("_n"), F.min(F.struct("doc_id", "pos")).alias("_first")).where("_n > 1")
    )
    later = windows.join(repeated, ["h1", "h2"]).where("not (struct(doc_id, pos) <=> _first)").select("doc_id", "pos")
    order = Window.partitionBy("doc_id").orderBy("pos")
    return (
        later.withColumn("_new", (F.col("pos") > F.lag("pos").over(order) + width).cast("int"))
        .withColumn("_run", F.sum(F.coalesce("_new", F.lit(0))).over(order))
        .groupBy("doc_id", "_run")
        .agg(F.min("pos").alias("a"), (F.max("pos") + width).alias("b"))
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))
    )


def dedup_lines(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``(doc_id, n_lines, n_removed, n_spans, kept_text)`` of every row.

    Lines are what line feeds separate. A null text counts as empty: one empty line, nothing removed.
    Texts of fewer than three lines are untouched. Later occurrences inside one document go too.
    ``doc_id`` must be unique and not null for rows to be told apart: rows with a null id are never
    cut, and rows that share an id are cut alike. Other columns are ignored.
    """
    base = docs.select("doc_id", "text")
    spans = covered_spans(base.where("doc_id is not null"), width).withColumnRenamed("doc_id", "_doc")
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    kept = F.expr(
        """flatten(zip_with(concat(array(0), transform(spans, s -> s.b)), concat(transform(spans, s -> s.a), array(size(_l))),
           (a, b) -> slice(_l, a + 1, greatest(b - a, 0))))"""
    )
    # Rows that share an id would differ in length: ranges past the end are cut off by slice().
    joined = base.join(spans, F.col("doc_id") == F.col("_doc"), "left").withColumn("_l", lines)
    with_kept = joined.withColumn("_k", F.when(F.col("spans").isNull(), F.col("_l")).otherwise(kept))
    return with_kept.select(
        "doc_id",
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size("_k")).cast("long").alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.array_join("_k", "\n").alias("kept_text"),
    )
