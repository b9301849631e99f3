"""Exact dedup with a persistent digest index, bucketed and sorted by hash."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.storage import files_for, materialise, matching, move, remove, shared_root


def text_digest(text: Column) -> Column:
    """SHA-256 (lowercase hex) of the unchanged text in UTF-8; a null text counts as the empty one."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class DigestIndex:
    """A table ``(digest, keep_id, group_size)`` bucketed and sorted by ``digest``.

    :meth:`add` deduplicates a delivery: its rows are grouped by digest (partial aggregation, so a
    digest of any frequency shuffles one row per task), what the index does not hold yet is found by
    a sort-merge anti-join in which only the delivery's side is shuffled, and those digests are
    appended in the same bucketing. A row stays if its digest is new and its id is the largest of
    its digest in the delivery; a digest that an earlier delivery brought keeps that earlier row.
    Each delivery adds a file a bucket; :meth:`compact` makes one of them again.

    The index lies in a folder of its own below ``folder``, by default the shared one of ``spark.checkpoint.dir``,
    and the folder's name tells its buckets. Each session names it a table in its own catalog again, so an index
    outlives the session, and needs no catalog that outlives it.

    Nulls: a null text equals the empty text; a null id sorts below all others. Repeated rows (same
    id and text) count separately in ``group_size``. An empty delivery changes nothing. Other columns,
    whatever their names, are ignored.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None, folder: str | None = None):
        self.spark, self.folder = spark, (folder or shared_root(spark)).rstrip("/")
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        found = matching(spark, f"{self.folder}/{self.name}.buckets-*")
        # Left by a compaction that ended between its last two steps.
        for path in [] if found else matching(spark, f"{self.folder}/{self.name}.compacted-*/_SUCCESS"):
            at = path.rsplit("/", 1)[0]
            found = [at.replace(".compacted-", ".buckets-")]
            move(spark, at, found[0])
        self.buckets = int(found[0].rsplit("-", 1)[1]) if found else buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.path = f"{self.folder}/{self.name}.buckets-{self.buckets}"
        self._name(self.name, self.path)

    def _name(self, name: str, path: str) -> None:
        self.spark.sql(f"drop table if exists {name}")
        columns = "digest string, keep_id long, group_size long"
        self.spark.sql(f"create table {name} ({columns}) using parquet clustered by (digest) sorted by (digest) into {self.buckets} buckets location '{path}'")

    def _write(self, df: DataFrame, name: str) -> None:
        # One task per bucket, so each write adds one file a bucket.
        dealt = df.repartition(self.buckets, "digest").sortWithinPartitions("digest")
        dealt.write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").mode("append").saveAsTable(name)

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def split(self, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``groups`` (one row a digest) that the index lacks, and those it has as the index holds them.

        The index is read by its buckets: only ``groups`` is shuffled, whatever the index's size.
        """
        # A merge hint on the delivery's side, so that neither side is broadcast and the buckets count.
        new = groups.hint("merge").join(self.entries().select("digest"), "digest", "left_anti")
        old = groups.select("digest").hint("merge").join(self.entries(), "digest")
        return new, old

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Deduplicate ``docs`` against the index and append its new digests.

        Returns one row per input row: ``(id, digest, keep_id, group_size, kept)``. The result does not
        read the index, which may be dropped.
        """
        rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_digest(F.col(text_col)).alias("digest"))
        groups = rows.groupBy("digest").agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size"))
        # Written first: else the joins below would move under the grouping and shuffle every row.
        groups = materialise(groups, "digests")
        n = groups.count()
        new, old = self.split(groups)
        fresh = materialise(new, "fresh", n)
        held = fresh.unionByName(materialise(old.select(*fresh.columns), "known", n))
        self._write(fresh, self.name)
        self.spark.catalog.refreshTable(self.name)
        # ``held`` is as large as the delivery. Both sides are shuffled here, so a digest that many rows
        # share can be split over tasks.
        return rows.join(held, "digest").select(
            F.col("_id").alias(id_col),
            "digest",
            "keep_id",
            "group_size",
            F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        )

    def compact(self) -> None:
        """Rewrite the table with one sorted file a bucket, as after a single delivery."""
        other, path = f"{self.name}_compacted", self.path.replace(".buckets-", ".compacted-")
        remove(self.spark, path)
        self._name(other, path)
        # Its plain files: as a table, Spark leaves out the shuffle below for buckets that it then does not read by.
        self._write(self.spark.read.schema(self.entries().schema).parquet(self.path), other)
        self.spark.sql(f"drop table {other}")
        self.drop()
        move(self.spark, path, self.path)
        self._name(self.name, self.path)

    def drop(self) -> None:
        """Delete the index, files and all."""
        self.spark.sql(f"drop table if exists {self.name}")
        remove(self.spark, self.path)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact dedup keeps, one for each text, with all their columns.

    Only ids and digests pass through the index; texts are read again for the kept ids. Of repeated rows
    (same id, same text) one stays. A null text equals the empty one; a null id stays only if its text has
    no other. Columns may have any names; an empty table gives an empty one.
    """
    n = docs.count()
    index = DigestIndex(docs.sparkSession, buckets=min(files_for(n), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    kept = index.add(docs, id_col, text_col).where("kept").groupBy("digest", "keep_id").agg(F.count("*").alias("n"))
    kept = materialise(kept, "kept", n)
    index.drop()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), text_digest(F.col(text_col)).alias("digest"))
    held = lambda these: whole.join(these, (whole["digest"] == these["digest"]) & whole["id"].eqNullSafe(these["keep_id"]), "left_semi")
    again = kept.where("n > 1")
    if again.isEmpty():
        return held(kept).select("row.*")
    # Only rows that repeat are numbered; a text's copies under other ids have left by then.
    first = held(again).withColumn("k", F.row_number().over(Window.partitionBy("digest").orderBy("id"))).where("k = 1")
    return held(kept.where("n = 1")).select("row.*").unionByName(first.select("row.*"))
