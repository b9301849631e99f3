"""Hard negatives by exact inner products, scored by table lookups (the method of the Four Russians).

Vectors become integers. A candidate is packed as bit planes: plane b holds bit b of every component in
two's complement, eight dimensions a byte. An anchor has a table for each group of eight dimensions, the
sums of all 256 subsets of its components there. A plane's share of the inner product is then one lookup
for each group, shifted by the plane's weight; the planes add up to the exact score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.storage import materialise

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Percent of the positive's score that a negative's lies between.
LOW, HIGH = 50, 95
#: Most anchors and candidates of a cell, which is one group of a task.
ANCHORS, CANDIDATES = 8_192, 16_384
#: Anchors whose tables are made at a time: 16 KB each.
TABLES = 128
#: A slice of fewer candidates is not worth a cell of its own.
LEAST = 256


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component, as longs; null if any component is null or not finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")))


def pack_planes(values: np.ndarray, bits: int) -> np.ndarray:
    """Bytes ``[row, plane, group]``: bit ``7 - k`` of a byte is the plane's bit of the group's dimension ``k``."""
    planes = (values[:, None, :] >> np.arange(bits)[None, :, None]) & 1
    return np.packbits(planes.astype(np.uint8), axis=2)


def subset_sums(values: np.ndarray) -> np.ndarray:
    """``[group, byte, anchor]``: what the dimensions set in a byte add up to, by doubling a dimension at a time."""
    n, dims = values.shape
    groups = -(-dims // 8)
    padded = np.zeros((n, groups * 8), dtype=np.int64)
    padded[:, :dims] = values
    out = np.zeros((groups, 256, n), dtype=np.int64)
    for g in range(groups):
        for k in range(8):
            size = 1 << k
            out[g, size : 2 * size] = out[g, :size] + padded[:, 8 * g + 7 - k]
    return out


def lookup_scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products ``[candidate, anchor]``: a lookup for each plane and group; the top plane is the sign's."""
    n, bits, groups = planes.shape
    out = np.zeros((n, tables.shape[2]), dtype=np.int64)
    part, term = np.empty_like(out), np.empty_like(out)
    for b in range(bits):
        part[:] = 0
        for g in range(groups):
            np.take(tables[g], planes[:, b, g], axis=0, out=term)
            part += term
        part <<= b
        if b == bits - 1:
            out -= part
        else:
            out += part
    return out


def _matrix(values: pd.Series, dims: int) -> np.ndarray:
    """Rows of lists as a matrix; missing dimensions are zero."""
    out = np.zeros((len(values), dims), dtype=np.int64)
    for k, v in enumerate(values):
        out[k, : len(v)] = v
    return out


def _planes(dims: int, bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                packed = pack_planes(_matrix(part.column(2).to_pandas(), dims), bits)
                raw = pa.array([p.tobytes() for p in packed], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), raw], names=["vec_id", "label", "planes"])

    return rows


class _Cell:
    """Scores of a cell's anchors, a few at a time, against its candidates in order of ids."""

    def __init__(self, anchors: pd.DataFrame, candidates: pd.DataFrame, dims: int, bits: int):
        groups = -(-dims // 8)
        # By label, so that an anchor's own label is one range of candidates.
        self.candidates = candidates.sort_values(["label", "vec_id"], kind="stable")
        self.anchors = anchors.sort_values("label", kind="stable")
        self.planes = np.frombuffer(b"".join(self.candidates["planes"]), dtype=np.uint8).reshape(-1, bits, groups)
        self.ids, self.labels = self.candidates["vec_id"].to_numpy(), self.candidates["label"].to_numpy()
        self.dims = dims

    def blocks(self, own_label: bool) -> Iterator[tuple[pd.DataFrame, np.ndarray, slice]]:
        """``(anchors, scores, candidates)``; with ``own_label``, candidates of these anchors' labels only."""
        for at in range(0, len(self.anchors), TABLES):
            some = self.anchors.iloc[at : at + TABLES]
            labels = some["label"].to_numpy()
            where = slice(np.searchsorted(self.labels, labels[0]), np.searchsorted(self.labels, labels[-1], side="right")) if own_label else slice(0, len(self.ids))
            tables = subset_sums(_matrix(some["v"], self.dims))
            yield some, lookup_scores(tables, self.planes[where]), where


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best by score, ties by id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _frame(parts: list[tuple[np.ndarray, ...]], *names: str) -> pd.DataFrame:
    """Parts of columns end to end."""
    cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, dtype=np.int64)] * len(names)
    return pd.DataFrame(dict(zip(names, cols)), dtype=np.int64)


def mine_hard_negatives(
    vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``vectors`` is ``(vec_id, embedding, label)``; the rows that the condition ``anchors`` (over these
    columns) names are anchors. A score is the inner product of two vectors of ``floor(scale * x)``. Higher
    scores come first, ties by the smaller id. An anchor's positives are its first ``positives`` other rows of
    its label; for each of them come the first ``negatives`` rows of another label with
    ``low * positive <= 100 * negative <= high * positive``.

    Rows with a null id, label or vector, or with a component that is null or not finite, take no part.
    Vectors of different lengths are scored as if zeros followed; an empty one scores 0. Rows that share an id
    count once: the one of the least label, then vector. An anchor without positives, or a positive without
    such negatives, has no row; an empty table gives an empty result. Other columns are ignored. Vectors so
    large that a score might not fit a long are an error.

    Every anchor is scored against every row, in cells of a block of anchors and a slice of rows, both of
    bounded size whatever the labels; a cell returns its own best few for each anchor, and a window merges them.
    Rows of an anchor's label are scored in the first pass, all others in the second.
    """
    spark = vectors.sparkSession
    base = vectors.where("vec_id is not null and label is not null and embedding is not null").select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), quantised(F.col("embedding"), scale).alias("v"), F.coalesce(anchors, F.lit(False)).alias("is_anchor")
    )
    one = base.where("v is not null").groupBy("vec_id").agg(F.min(F.struct("label", "v", "is_anchor")).alias("row"))
    rows = materialise(one.select("vec_id", "row.*"), "vectors")
    largest = F.greatest(F.max(F.array_max("v")), -F.min(F.array_min("v")))
    n, n_anchors, dims, most = rows.agg(F.count("*"), F.count_if("is_anchor"), F.max(F.size("v")), largest).first()
    dims, most = max(1, dims or 0), most or 0
    if dims * (most + 1) ** 2 >= 2**62:
        raise ValueError(f"components up to {most} in {dims} dimensions may give scores beyond a long")
    bits = int(most).bit_length() + 1
    blocks = max(1, -(-n_anchors // ANCHORS))
    slices = max(1, -(-n // CANDIDATES), min(n // LEAST, 4 * spark.sparkContext.defaultParallelism))
    packed = rows.select("vec_id", "label", "v").mapInArrow(_planes(dims, bits), "vec_id long, label long, planes binary")
    dealt = materialise(packed.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int")), "planes")
    cells = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def asked(df: DataFrame) -> DataFrame:
        block = F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)).cast("int")
        return df.withColumn("block", block).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def first(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            cell = _Cell(left, right, dims, bits)
            for some, scores, where in cell.blocks(True):
                ids, labels = cell.ids[where], cell.labels[where]
                for k, (a, label) in enumerate(zip(some["anchor_id"], some["label"])):
                    own = np.flatnonzero((labels == label) & (ids != a))
                    got = own[_best(scores[own, k], ids[own], positives)]
                    out.append((np.full(len(got), a), ids[got], scores[got, k]))
        return _frame(out, "anchor_id", "positive_id", "positive_score")

    def second(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            cell = _Cell(left, right, dims, bits)
            for some, scores, _ in cell.blocks(False):
                for k, (a, label, found) in enumerate(zip(some["anchor_id"], some["label"], some["found"])):
                    at_least = min(-(-low * p["positive_score"] // 100) for p in found)
                    at_most = max(high * p["positive_score"] // 100 for p in found)
                    s = scores[:, k]
                    band = np.flatnonzero((s >= at_least) & (s <= at_most) & (cell.labels != label))
                    for p in found:
                        score = p["positive_score"]
                        fit = band[(100 * s[band] >= low * score) & (100 * s[band] <= high * score)]
                        got = fit[_best(s[fit], cell.ids[fit], negatives)]
                        out.append((*(np.full(len(got), x) for x in (a, p["positive_id"], score)), cell.ids[got], s[got]))
        return _frame(out, "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")

    lead = rows.where("is_anchor").select(F.col("vec_id").alias("anchor_id"), "label", "v")
    key = ["block", "slice"]
    of_label = asked(lead).groupBy(*key).cogroup(cells.groupBy(*key)).applyInPandas(first, "anchor_id long, positive_id long, positive_score long")
    by_score = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = of_label.withColumn("_r", F.row_number().over(by_score)).where(F.col("_r") <= positives).drop("_r")
    # At most ``positives`` of an anchor.
    found = near.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("found"))
    paired = materialise(lead.join(found, "anchor_id"), "positives")
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    others = asked(paired).groupBy(*key).cogroup(cells.groupBy(*key)).applyInPandas(second, schema)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return (
        others.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    )
