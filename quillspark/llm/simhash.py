"""SimHash near-dedup: fingerprints linked by vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.graph import components
from quillspark.storage import materialise, materialise_at, remove

SHINGLE = 4
RADIUS = 4
#: Fingerprints that a shard should have at home. Each level of shared shards costs rows (a ball reaches
#: both sides of a third of the boundaries); levels inside a shard cost none.
SHARD = 100_000
#: Shards with more rows are dealt out as pairs of chunks of this size.
CHUNK = 150_000
#: Fingerprints that the tree's radii are fitted on, for each shard and at least; the tree routes every fingerprint.
FIT_SHARD, FIT_SAMPLE = 16, 8_192
QUARTERS = 4
#: Near copies by the words they share: shingles of five words, and the least Jaccard similarity.
WORDS = 5
SIMILARITY = 0.8
#: MinHash: a pair at the least similarity agrees in a band of six with 0.26, so in none of 32 with 6e-5; a pair
#: that shares a third of its words agrees in any of them with 0.04.
BANDS, BAND = 32, 6
#: Leaders of a bucket in a round, times those of the round before, and at most.
MORE_LEADERS, MOST_LEADERS = 4, 256
#: Of each bin's least hash two bits are kept beside the bands; a pair is compared by its shingles if at most so many of the
#: 192 bins differ in them. At the least similarity 29 do (with a deviation of 5), so more do with 6e-5; of a pair with a
#: similarity of a half, 72 do (with 7).
DIFFER = 48
#: Parity sketch of the documents that a first round leaves: bits for each shingle, and words of 64 bits at most. Words go by powers of two.
PARITY_BITS, PARITY_WORDS = 4, 256
#: Orders that leaders are chosen by: band k goes by order k % ORDERS. One order makes the same documents lead most
#: buckets, so a document meets few of them; each more order sees pairs from another side.
ORDERS = 2


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles: bit b is set if it is in over half of their XXH64 hashes (seed 42)."""
    raw = text.encode().lower() if text else b""  # bytes.lower() and .split() know ASCII only
    words = raw.split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    ends = (ends - 1).tolist()
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[:n], ends[min(shingle, len(words)) - 1 :])], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * ones > n).tolist()))


def _fingerprints(shingle: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64), pa.int64())], names=["doc_id", "fp"])

    return rows


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` of every row, the fingerprint as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


@dataclass
class Node:
    """A vantage point in one quarter of the bits: fingerprints within ``mu`` of it are inside."""

    point: int
    mu: int
    inside: "Node | int"
    outside: "Node | int"


def build_tree(values: np.ndarray, depth: int, rng: np.random.Generator, leaves: list[int]) -> Node | int:
    """A vantage-point tree over 16-bit values; ``leaves`` counts its shards."""
    if depth == 0 or len(values) < 2:
        leaves.append(len(leaves))
        return len(leaves) - 1
    point = int(values[rng.integers(len(values))])
    d = np.bitwise_count(values ^ np.uint16(point))
    mu = int(np.median(d))
    if not 0 < (d <= mu).sum() < len(d):
        leaves.append(len(leaves))
        return len(leaves) - 1
    return Node(point, mu, build_tree(values[d <= mu], depth - 1, rng, leaves), build_tree(values[d > mu], depth - 1, rng, leaves))


def route(tree: Node | int, values: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(shard, rows, at home)``: each value's own shard, and those its ball of ``radius`` may reach.

    By the triangle inequality a ball about x reaches inside only if d(x, v) - radius <= mu, and
    outside only if d(x, v) + radius > mu.
    """
    stack = [(tree, np.arange(len(values)), np.ones(len(values), dtype=bool))]
    while stack:
        node, rows, home = stack.pop()
        if not len(rows):
            continue
        if isinstance(node, int):
            yield node, rows, home
            continue
        d = np.bitwise_count(values[rows] ^ np.uint16(node.point)).astype(np.int64)
        near, far = d - radius <= node.mu, d + radius > node.mu
        stack.append((node.inside, rows[near], (home & (d <= node.mu))[near]))
        stack.append((node.outside, rows[far], (home & (d > node.mu))[far]))


def quarters(fps: np.ndarray) -> list[np.ndarray]:
    u = fps.view(np.uint64)
    return [((u >> np.uint64(16 * q)) & np.uint64(0xFFFF)).astype(np.uint16) for q in range(QUARTERS)]


class Forest:
    """Links between positions, kept as parents; a block of pairs is joined at a time."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return self.parent
            self.parent = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            top = self.root()
            x, y = top[a], top[b]
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))


def link_shard(home: np.ndarray, everyone: np.ndarray, quarter: int, radius: int, small: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a shard that have links, each with the smallest it is linked with in the shard.

    The shard's own tree splits its home fingerprints further by the quarter's distances. What is left large
    then goes to three more trees, one for each other quarter: of two codes within ``radius`` bits the two
    quarters that differ least differ in half of ``radius`` bits at most, so a ball of that radius is enough
    there. A leaf, or what no vantage point splits, compares blocks of pairs. Links become a forest, not a
    list of pairs.
    """
    points = np.unique(np.concatenate([home, everyone]))
    at_home, at_all = np.searchsorted(points, np.unique(home)), np.searchsorted(points, np.unique(everyone))
    full, parts = points.view(np.uint64), quarters(points)
    forest = Forest(len(points))
    first, second = radius // QUARTERS, radius // 2
    stack = [(at_home, at_all, quarter, first)]
    while stack:
        own, others, by, slack = stack.pop()
        if not len(own) or not len(others):
            continue
        if len(own) * len(others) > small:
            part = parts[by]
            d = np.bitwise_count(part[own] ^ part[own[len(own) // 2]]).astype(np.int64)
            mu = int(np.median(d))
            inside = d <= mu
            if inside.all() and mu > 0:
                mu -= 1
                inside = d <= mu
            if 0 < inside.sum() < len(own):
                e = np.bitwise_count(part[others] ^ part[own[len(own) // 2]]).astype(np.int64)
                stack.append((own[inside], others[e - slack <= mu], by, slack))
                stack.append((own[~inside], others[e + slack > mu], by, slack))
                continue
            if by == quarter and any(len(np.unique(parts[q][own])) > 1 for q in range(QUARTERS)):
                stack += [(own, others, q, second) for q in range(QUARTERS) if q != quarter]
                continue
        rows = max(1, 1_000_000 // len(others))
        for k in range(0, len(own), rows):
            a, b = np.nonzero(np.bitwise_count(full[own[k : k + rows], None] ^ full[others][None, :]) <= radius)
            forest.join(own[k : k + rows][a], others[b])
    top = forest.root()
    linked = np.flatnonzero((top != np.arange(len(points))))
    return points[linked], points[top[linked]]


def near_links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD, chunk: int = CHUNK) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct fingerprints within ``radius`` bits, exactly.

    Two fingerprints within 4 bits are within 1 bit in at least one of their four quarters. So each
    quarter has a vantage-point tree over its 16 bits, in which a ball of radius 1 crosses few
    boundaries (a ball of radius 4 among 64 bits would cross nearly all: distances gather about 32). A
    fingerprint goes to its own shard of each tree and to those its ball reaches; a shard compares its
    own fingerprints with all it got, by their whole 64 bits. Shards are counted first, and a shard
    with many rows (a large group of near copies) is dealt out as pairs of chunks. What a shard
    returns is a forest of at most as many links as it has fingerprints.
    """
    spark = fps.sparkSession
    n = fps.count()
    # A quarter has 2**16 values, so a tree of that depth can set each of them apart.
    depth = int(np.clip(np.ceil(np.log2(max(2, n) / shard)), 0, 16))
    fit = max(FIT_SAMPLE, FIT_SHARD << depth)
    share = min(1.0, 1.5 * fit / max(1, n))
    # The fit's sample is bounded: at most 2**20 fingerprints. The least hashes are taken.
    pick = fps.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("fp"), "fp").limit(fit)
    sample = np.array([r["fp"] for r in pick.collect()], dtype=np.int64)
    rng = np.random.default_rng(7)
    trees = [build_tree(q, depth, rng, []) for q in quarters(sample)] if n else [0] * QUARTERS
    slack = radius // QUARTERS

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for q, part in enumerate(quarters(values)):
                for leaf, rows, home in route(trees[q], part, slack):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), q * 100_000 + leaf), pa.int32()), pa.array(values[rows], pa.int64()), pa.array(home)], names=["shard", "fp", "home"]
                    )

    dealt = materialise(fps.select("fp").mapInArrow(deal, "shard int, fp long, home boolean"), "dealt", QUARTERS * n)
    # Large shards only, of at most 4 * 2**16.
    parts = {r["shard"]: -(-r["count"] // chunk) for r in dealt.groupBy("shard").count().where(F.col("count") > chunk).collect()}
    cuts = F.lit(1)
    if parts:
        cuts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]), F.col("shard")), F.lit(1))
    own = F.pmod(F.xxhash64("fp"), "_cuts").cast("int")
    # A cell (i, j) compares chunk i at home with all of chunk j; the usual shard is the cell (0, 0).
    every = F.sequence(F.lit(0), F.col("_cuts") - 1)
    into = F.transform(every, lambda i: F.struct(i.alias("i"), F.col("own").alias("j")))
    outof = F.transform(every, lambda j: F.struct(F.col("own").alias("i"), j.alias("j")))
    cells = (
        dealt.withColumn("_cuts", cuts)
        .withColumn("own", own)
        .withColumn("cell", F.explode(F.when(F.col("home"), F.array_union(into, outof)).otherwise(into)))
        .select("shard", "cell.i", "cell.j", "own", "fp", "home")
    )

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, own = pdf["fp"].to_numpy(), pdf["own"].to_numpy()
        at_home = pdf["home"].to_numpy(dtype=bool) & (own == pdf["i"].iloc[0])
        a, b = link_shard(fp[at_home], fp[own == pdf["j"].iloc[0]], int(pdf["shard"].iloc[0]) // 100_000, radius)
        return pd.DataFrame({"a": a, "b": b})

    return cells.groupBy("shard", "i", "j").applyInPandas(link, "a long, b long")


def _points(marked: DataFrame) -> DataFrame:
    """``(fp, least, size)`` of the distinct fingerprints of the written table ``(doc_id, fp)``; written too."""
    return materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")), "points", marked.count())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id, group_size)`` of every row of ``docs``.

    Documents whose fingerprints differ in at most ``radius`` (up to 7) bits are linked, and
    ``component_id`` is the least ``doc_id`` that links reach. Documents with equal fingerprints are one
    point until the end, so copies cost nothing in the search. A text without words, null included, has
    fingerprint zero and is linked like any other. Null ids count as larger than all others; a
    component of null ids only has a null ``component_id``. Repeated rows count each. Other columns,
    whatever their names, are ignored; an empty table gives an empty result.
    """
    marked = materialise(fingerprints(docs, shingle), "fingerprints")
    points = _points(marked)
    linked = components(near_links(points.select("fp"), radius), "a", "b")
    named = points.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("group", F.coalesce("component", "fp"))
    groups = named.groupBy("group").agg(F.min("least").alias("component_id"), F.sum("size").alias("group_size"))
    by_fp = named.select("fp", "group").join(groups, "group").select("fp", "component_id", "group_size")
    return marked.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size")


def fingerprint_links(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``(a, b)`` of document ids that connect what :func:`near_duplicates` puts into one component.

    ``marked`` is the written table ``(doc_id, fp)``, without null ids.
    """
    points = _points(marked)
    equal = marked.join(points, "fp").where("doc_id <> least").select(F.col("least").alias("a"), F.col("doc_id").alias("b"))
    first = points.select(F.col("fp").alias("a"), F.col("least").alias("_a"))
    second = points.select(F.col("fp").alias("b"), F.col("least").alias("_b"))
    return equal.unionByName(near_links(points.select("fp"), radius).join(first, "a").join(second, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))


def keep_one_per_group(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose id names their group, with all their columns; rows of null ids stay.

    Rows that share an id are one document: they stay or go together.
    """
    return _without(docs, fingerprint_links(materialise(fingerprints(docs.where("doc_id is not null"), shingle), "fingerprints"), radius))


def _without(docs: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of ``docs`` but those that links connect with a smaller id."""
    named = components(links, "a", "b")
    gone = named.where("node <> component").select("node")
    return docs.join(gone, docs["doc_id"] == gone["node"], "left_anti")


def grams(text: str | None, shingle: int = WORDS) -> np.ndarray:
    """The distinct XXH64 hashes of the word shingles, in lower case as in :func:`fingerprint`; none without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    last = (ends - 1).tolist()[min(shingle, len(words)) - 1 :]
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, last)], dtype=np.uint64))


class MinHashes:
    """One-permutation MinHash: each of ``BANDS * BAND`` bins holds the least hash of its range.

    A bin without a hash takes that of another one, the first filled of a fixed random row of bins (the next
    filled one if none of these is). Band keys hash ``BAND`` bins.
    """

    TRIES = 64

    def __init__(self):
        bins = BANDS * BAND
        rng = np.random.default_rng(11)
        self.edges = (np.arange(bins + 1, dtype=object) * 2**64 // bins)[1:-1].astype(np.uint64)
        self.other = rng.integers(0, bins, (bins, self.TRIES))
        self.odd = rng.integers(0, 1 << 63, (BANDS, BAND), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def bins(self, h: np.ndarray) -> np.ndarray:
        """What each bin holds of sorted distinct hashes, of which there is at least one."""
        first = np.concatenate([[0], np.searchsorted(h, self.edges)])
        filled = first < np.append(first[1:], len(h))
        if not filled.all():
            tried = filled[self.other]
            found = self.other[np.arange(len(first)), tried.argmax(axis=1)]
            at = np.flatnonzero(filled)
            after = at[np.searchsorted(at, np.arange(len(first))) % len(at)]
            first = np.where(filled, first, first[np.where(tried.any(axis=1), found, after)])
        return h[first]

    def sketch(self, bins: np.ndarray) -> list[int]:
        """The two lowest bits of each bin: all low ones packed in signed numbers, then all high ones."""
        return np.packbits(np.stack([bins & np.uint64(1), bins >> np.uint64(1) & np.uint64(1)]).astype(np.uint8)).view(np.int64).tolist()

    def bands(self, bins: np.ndarray) -> np.ndarray:
        """Keys (signed) of the bands."""
        mixed = (bins.reshape(BANDS, BAND) ^ (bins.reshape(BANDS, BAND) >> np.uint64(29))) * self.odd
        keys = (mixed ^ (mixed >> np.uint64(32))).sum(axis=1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (keys ^ (keys >> np.uint64(31)) ^ np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _few(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Smaller batches, whose shingles a worker holds at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _marks(shingle: int, words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, none = MinHashes(), np.zeros(0, dtype=np.int64)
        for batch in _few(batches):
            texts = batch.column(1).to_pylist()
            sets = [grams(t, words) for t in texts]
            fps = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
            held = [hashes.bins(h) if len(h) else none for h in sets]
            lists = [[hashes.bands(x) if len(x) else none for x in held], [hashes.sketch(x) if len(x) else [] for x in held]]
            cols = [pa.array(fps, pa.int64()), pa.array([len(h) for h in sets], pa.int32()), *(pa.array(x, pa.list_(pa.int64())) for x in lists)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "fp", "n", "bands", "sketch"])

    return rows


def marks(docs: DataFrame, shingle: int = SHINGLE, words: int = WORDS) -> DataFrame:
    """``(doc_id, fp, n, bands, sketch)`` of the rows with an id: fingerprint, number of distinct ``words``-word shingles, MinHash
    bands, and two bits of each MinHash."""
    base = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    return base.mapInArrow(_marks(shingle, words), "doc_id long, fp long, n int, bands array<long>, sketch array<long>")


def parity(h: np.ndarray) -> np.ndarray:
    """Bit ``h mod B`` of each hash, added without carry, as signed words; ``B`` follows the number of hashes.

    Two sets' sketches of one length differ in as many bits as the sets differ in elements, at most. The upper half of a
    sketch added to the lower one is the sketch of half the length.
    """
    words = min(PARITY_WORDS, max(1, (1 << max(0, PARITY_BITS * len(h) - 1).bit_length()) // 64))
    odd = np.bincount((h & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _sets(shingle: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            sets = [grams(t, shingle) for t in batch.column(1).to_pylist()]
            lists = [[h.view(np.int64) for h in sets], [parity(h) for h in sets]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.list_(pa.int64())) for x in lists)], names=["doc_id", "grams", "odd"])

    return rows


def _parity_differs(x: Column, y: Column) -> Column:
    """In how many bits two parity sketches differ, once both are as short as the shorter one. Lengths differ by a factor of two at most."""
    half = lambda s: F.zip_with(F.slice(s, 1, F.shiftright(F.size(s), 1)), F.slice(s, F.shiftright(F.size(s), 1) + 1, F.shiftright(F.size(s), 1)), lambda a, b: a.bitwiseXOR(b))
    bits = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k)
    return F.when(F.size(x) == F.size(y), bits(x, y)).when(F.size(x) > F.size(y), bits(half(x), y)).otherwise(bits(x, half(y)))


def similar_links(docs: DataFrame, banded: DataFrame, shingle: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Links ``(a, b)`` of documents whose word shingles have a Jaccard similarity of ``similarity`` at least.

    ``banded`` is the written table ``(doc_id, n, bands, sketch)`` of :func:`marks`. Documents that share a band of
    MinHashes form a bucket. A round holds every bucket's documents against its leaders, by their shingles; leaders
    leave the bucket, and the rest go on with four times as many leaders, until each bucket is within one component
    of the links so far. Documents of one component are never compared, and those that have no link lead first, so a
    group of near copies is done once its outsiders have led. A document keeps a row, with a seat for each bucket that
    it is in; seats meet their buckets' leaders in one join, and leaders that lead several of a document's buckets are
    compared with it once. In the first round these are ``BANDS`` at most. Later ones have a parity sketch of each document that is
    left, which bounds from below in how many shingles two of them differ, so few pairs but links are compared by their
    shingles, however large the group. No bucket is collected; the rounds grow with the logarithm of a bucket's outsiders, up to
    ``MOST_LEADERS``, then with their number, and sketches are held against each other as often as outsiders meet the
    others of their bucket. Links are always true, and connect all that is similar but pairs that share no bucket or whose sketches differ
    in more than ``DIFFER`` bins.

    Rows of null ids and texts without words have no links; rows that share an id count as one document.
    """
    spark = docs.sparkSession
    base = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    seats = F.transform("bands", lambda band, k: F.struct(band.alias("band"), (k % ORDERS).alias("turn")))
    left, size = banded.where("n > 0").select("doc_id", "n", "sketch", seats.alias("seats")), banded.count()
    links, leaders, sets, before = [], 1, None, []
    while size:
        # After the first round a document has its component so far, named by the least id, and its parity sketch.
        keys, of = ["doc_id", "n", "sketch"], F.col("doc_id")
        if sets is not None:
            keys, of = [*keys, "of", "odd"], F.col("of")
        rows = left.select(*keys, F.explode("seats").alias("seat")).select(*keys, "seat.*")
        order = F.xxhash64("turn", "doc_id")
        # Minima of parts, then the parts of a bucket: at most ``leaders`` of them.
        head = F.min(F.struct((of != F.col("doc_id")).alias("tied"), order.alias("h"), *keys)).alias("head")
        parts = rows.groupBy("band", F.pmod(order, F.lit(leaders)).alias("part")).agg(head, F.min(of).alias("a"), F.max(of).alias("b"))
        whole = parts.groupBy("band").agg(F.collect_list("head").alias("heads"), F.min("a").alias("a"), F.max("b").alias("b"))
        # Written, so that the join's stage holds no grouping and a frequent band's rows can be split.
        led, led_path = materialise_at(whole.where("a < b").select("band", "heads"), "leaders", BANDS * size)
        half = BANDS * BAND // 64
        apart = lambda h, k: F.get("sketch", F.lit(k)).bitwiseXOR(F.get(h["sketch"], F.lit(k)))
        differ = lambda h: reduce(Column.__add__, [F.bit_count(apart(h, k).bitwiseOR(apart(h, k + half))) for k in range(half)])
        head_of = lambda h: h["of"] if sets is not None else h["doc_id"]  # noqa: E731, B023
        # As a fraction of both sizes, sets of this similarity differ in (1 - similarity) / (1 + similarity) elements.
        close = lambda h: (1 + similarity) * _parity_differs(F.col("odd"), h["odd"]) <= (1 - similarity) * (F.col("n") + h["n"]) + 1e-6
        alike = lambda h: (head_of(h) != of) & (F.least("n", h["n"]) >= similarity * F.greatest("n", h["n"])) & (differ(h) <= DIFFER)  # noqa: E731, B023
        like = F.filter("heads", alike if sets is None else lambda h: alike(h) & close(h))  # noqa: B023
        met_by = F.transform(like, lambda h: F.struct(h["doc_id"].alias("a"), head_of(h).alias("a_of")))  # noqa: B023
        seat = F.struct("band", "turn", met_by.alias("near"), F.exists("heads", lambda h: h["doc_id"] == F.col("doc_id")).alias("leads"))
        met = rows.join(led, "band", "left").where("heads is not null")
        seated, seated_path = materialise_at(met.groupBy(*keys).agg(F.collect_list(seat).alias("seats")), "seats", size)
        named = seated.select("doc_id").distinct()
        # Most documents leave in the first round, so later rounds move few shingles.
        first = sets is None
        if first:
            sets = base.join(named, "doc_id", "left_semi").mapInArrow(_sets(shingle), "doc_id long, grams array<long>, odd array<long>")
        else:
            sets = sets.join(named, "doc_id", "left_semi")
        sets, sets_path = materialise_at(sets, "grams")
        for path in before:  # of the round before, used up
            remove(spark, path)
        asked = F.array_distinct(F.flatten(F.transform("seats", lambda s: s["near"])))
        pairs, pairs_path = materialise_at(seated.select(F.col("doc_id").alias("b"), of.alias("b_of"), F.explode(asked).alias("pair")).select("b", "b_of", "pair.*"), "pairs", size)
        shared = F.size(F.array_intersect("_a", "_b"))
        texts = sets.select("doc_id", "grams")
        both = pairs.join(texts.toDF("b", "_b"), "b").join(texts.toDF("a", "_a"), "a")
        near = materialise(both.where(shared >= similarity * (F.size("_a") + F.size("_b") - shared)).select("a", "b", "a_of", "b_of"), "near")
        links.append(near.select("a", "b"))
        rest = F.transform(F.filter("seats", lambda s: ~s["leads"]), lambda s: F.struct(s["band"].alias("band"), s["turn"].alias("turn")))
        going = seated.select("doc_id", "n", "sketch", of.alias("of"), *([] if first else ["odd"]), rest.alias("seats")).where("size(seats) > 0")
        if first:
            going = going.join(sets.select("doc_id", F.size("grams").alias("n"), "odd").distinct(), ["doc_id", "n"])
        if not near.isEmpty():
            merged = components(near, "a_of", "b_of").where("node <> component")
            going = going.join(merged.withColumnRenamed("node", "of"), "of", "left").withColumn("of", F.coalesce("component", "of")).drop("component")
        left, left_path = materialise_at(going, "rest", size)
        for path in (led_path, seated_path, pairs_path):
            remove(spark, path)
        before = [sets_path, left_path]
        size, leaders = left.count(), min(MOST_LEADERS, leaders * MORE_LEADERS)
    for path in before:
        remove(spark, path)
    out = spark.createDataFrame([], "a long, b long")
    for near in links:
        out = out.unionByName(near)
    return out


def keep_one_similar(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` but near copies: of documents linked by fingerprints or by shared words the least id stays.

    Links are those of :func:`near_duplicates` and of :func:`similar_links`. Texts without words, null included,
    are all alike (fingerprint zero). Rows of null ids stay. Rows that share an id are one document: they stay
    or go together. All columns are returned, whatever their names; an empty table gives an empty one.
    """
    marked = materialise(marks(docs), "marks")
    return _without(docs, fingerprint_links(marked.select("doc_id", "fp")).unionByName(similar_links(docs, marked)))
