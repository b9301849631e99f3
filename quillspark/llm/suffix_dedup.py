"""Substring dedup by a hash-compared suffix sort, sharded by sampled anchors.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier. Windows of that many
bytes are never shuffled one by one. Each window picks an anchor in itself, the k-mer with the least
hash (winnowing), so equal windows have equal anchors at equal offsets, and neighbouring windows
mostly share theirs. The jobs are:

1. anchors of all texts, one row per anchor with the offsets of its windows; k-mers that occur once
   in the corpus are dropped by a count and a semi-join;
2. anchors whose whole context (all their windows) is equal form a class: all its members but the
   first are covered wholly. That is a partial aggregation, so a passage in a third of all
   documents costs one row a task. Contexts are compared by two independent 64-bit hashes;
3. classes of one k-mer with different contexts differ in some windows only. Their first members'
   contexts are fetched and, group by group, sorted by what follows the anchor: a mergesort whose
   comparisons find the common extension by binary search on prefix polynomial hashes. Neighbours'
   extensions give the runs that share enough bytes to the right; hashes to the left split the runs.
   Orders and matches are verified on the bytes. A k-mer with very many contexts is split into
   single windows, grouped by hash;
4. covered ranges are merged per document and cut.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.storage import materialise, materialise_at, remove

LENGTH = 100
KMER = 32
#: Seed of the second hash of contexts.
OTHER = 19430322
#: Bytes hashed at a time; longer texts are cut into overlapping pieces.
PIECE = 1 << 20
#: A k-mer with more different contexts than this is split into its windows.
MAX_GROUP = 20_000
_LEFT = LENGTH - KMER
_WIDTH = _LEFT + LENGTH


@functools.lru_cache(maxsize=2)
def _tables(seed: int = 20240607) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes, and powers of an odd base and of its inverse modulo 2**64."""
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
    base = int(rng.integers(0, 2**63, dtype=np.uint64)) * 2 + 1
    inverse = pow(base, -1, 2**64)
    up = np.full(PIECE + 4 * LENGTH, base % 2**64, dtype=np.uint64)
    down = np.full(PIECE + 4 * LENGTH, inverse, dtype=np.uint64)
    up[0] = down[0] = 1
    return values, np.cumprod(up), np.cumprod(down)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def prefix_hashes(data: np.ndarray, *seed: int) -> np.ndarray:
    """``out[i]``: polynomial hash of the first ``i`` bytes, modulo 2**64."""
    values, up, _ = _tables(*seed)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=out[1:])
    return out


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive keys, in three passes whatever the width."""
    n = len(keys)
    pad = -n % width
    blocks = np.concatenate([keys, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def blob_anchors(data: np.ndarray, ends: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of texts laid end to end: ``(text, position, first start, last start, k-mer, context, context)``.

    ``ends``: where each text ends; ``limits``: starts from there on belong to another piece. The two hashes
    of the context have nothing in common.
    """
    _, _, down = _tables()
    none = (np.zeros(0, dtype=np.int64),) * 7
    if len(data) < LENGTH:
        return none
    h = prefix_hashes(data)
    n_k = len(data) - KMER + 1
    kmers = _mix((h[KMER:] - h[:-KMER]) * down[:n_k])
    at = np.arange(n_k, dtype=np.uint64)
    least = window_minima((kmers & ~np.uint64(0xFFFFFF)) | at, _LEFT + 1)
    starts = np.arange(len(least))
    text = np.searchsorted(ends, starts, side="right")
    ok = np.flatnonzero((starts + LENGTH <= ends[text]) & (starts < limits[text]))
    if not len(ok):
        return none
    anchor = (least[ok] & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[ok][1:] != text[ok][:-1])]))
    lo, hi = ok[new], ok[np.append(new[1:], len(ok)) - 1]
    anchor = anchor[new]
    ctx = _mix((h[hi + LENGTH] - h[lo]) * down[lo] + (anchor - lo).astype(np.uint64) * np.uint64(1 << 20) + (hi - lo).astype(np.uint64))
    other, back = prefix_hashes(data, OTHER), _tables(OTHER)[2]
    ctx2 = _mix((other[hi + LENGTH] - other[lo]) * back[lo])
    return text[lo], anchor, lo, hi, kmers[anchor], ctx, ctx2


def _pieces(ids: Iterable, texts: Iterable) -> Iterator[list[tuple[int, int, bytes, int]]]:
    """Runs of ``(id, offset, bytes, starts)`` of up to ``PIECE`` bytes together."""
    held, size = [], 0
    for i, text in zip(ids, texts):
        raw = text.encode() if text else b""
        if i is None or len(raw) < LENGTH:
            continue
        for at in range(0, len(raw) - LENGTH + 1, PIECE // 2):
            piece = raw[at : at + PIECE // 2 + LENGTH - 1]
            if size + len(piece) > PIECE:
                yield held
                held, size = [], 0
            held.append((i, at, piece, PIECE // 2))
            size += len(piece)
    if held:
        yield held


ANCHORS = "doc_id long, kmer long, ctx long, ctx2 long, pos long, lo long, hi long"


def _anchors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of :data:`ANCHORS`, a run of pieces at a time."""
    for batch in batches:
        for run in _pieces(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = np.frombuffer(b"".join(p[2] for p in run), dtype=np.uint8)
            ends = np.cumsum([len(p[2]) for p in run])
            begins = ends - [len(p[2]) for p in run]
            text, at, lo, hi, kmer, ctx, ctx2 = blob_anchors(data, ends, begins + [p[3] for p in run])
            ids = np.array([p[0] for p in run], dtype=np.int64)
            shift = np.array([p[1] for p in run], dtype=np.int64) - begins
            yield ids[text], kmer.view(np.int64), ctx.view(np.int64), ctx2.view(np.int64), at + shift[text], lo + shift[text], hi + shift[text]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cols in _anchors_of(batches):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "kmer", "ctx", "ctx2", "pos", "lo", "hi"])


def _anchor_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The k-mers of a run's anchors, counted."""
    for _, kmer, *_ in _anchors_of(batches):
        found, n = np.unique(kmer, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], names=["kmer", "n"])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of anchors: 68 bytes before and 100 after each, zeros beyond the text."""
    for batch in batches:
        for i, text, spots in zip(*(batch.column(k).to_pylist() for k in range(3))):
            raw = bytes(_LEFT) + (text or "").encode() + bytes(LENGTH)
            for k in range(0, len(spots), 4096):
                part = spots[k : k + 4096]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([s["kmer"] for s in part], pa.int64()),
                        pa.array([i] * len(part), pa.int64()),
                        *(pa.array([s[c] for s in part], pa.int64()) for c in ("pos", "lo", "hi")),
                        pa.array([s["hot"] for s in part], pa.bool_()),
                        pa.array([raw[s["pos"] : s["pos"] + _WIDTH] for s in part], pa.binary()),
                    ],
                    names=["kmer", "doc_id", "pos", "lo", "hi", "hot", "bytes"],
                )


def common_extension(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes rows ``a`` and ``b`` share from the anchor on, by binary search on prefix hashes."""
    low, high = np.zeros(len(a), dtype=np.int64), np.full(len(a), LENGTH)
    while (open_ := low < high).any():
        mid = (low + high + 1) // 2
        same = (h[a, _LEFT + mid] - h[a, _LEFT]) == (h[b, _LEFT + mid] - h[b, _LEFT])
        low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
    return low


def _before(mat: np.ndarray, h: np.ndarray, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Does suffix ``a`` sort before suffix ``b``? Equal suffixes: as ``ties`` says."""
    n = common_extension(h, a, b)
    spot = _LEFT + np.minimum(n, LENGTH - 1)
    return np.where(n == LENGTH, ties, mat[a, spot] < mat[b, spot])


def suffix_order(mat: np.ndarray, h: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Rows (given by ascending group) sorted by group, then by their suffix: a bottom-up mergesort.

    Every merge of a level is done at once: a row's place is its place in its own run plus its rank
    in the run beside it, found by binary search.
    """
    order = np.arange(len(group))
    first = np.searchsorted(group, group, side="left")
    size = np.searchsorted(group, group, side="right") - first
    width = 1
    while width < size.max(initial=0):
        spot = np.flatnonzero(size > width)
        local = spot - first[spot]
        side, block = (local // width) % 2, local // (2 * width) * (2 * width)
        other = np.where(side == 0, block + width, block)
        low = np.minimum(other, size[spot])
        high = np.minimum(other + width, size[spot])
        base, own = low.copy(), order[spot]
        while (live := np.flatnonzero(low < high)).size:
            mid = (low[live] + high[live]) // 2
            there = order[first[spot[live]] + mid]
            up = _before(mat, h, there, own[live], side[live] == 1)
            low[live], high[live] = np.where(up, mid + 1, low[live]), np.where(up, high[live], mid)
        target = first[spot] + block + local % width + (low - base)
        nxt = order.copy()
        nxt[target] = own
        order, width = nxt, width * 2
    return order


def covered_offsets(mat: np.ndarray, group: np.ndarray, rank: np.ndarray, o_lo: np.ndarray, o_hi: np.ndarray) -> np.ndarray:
    """``out[row, o]``: the window that starts ``o`` bytes before the anchor also starts earlier.

    ``group`` ascends; ``rank`` orders rows within it by where they start.
    """
    values, up, _ = _tables()
    h = np.zeros((len(mat), _WIDTH + 1), dtype=np.uint64)
    np.cumsum(values[mat] * up[:_WIDTH], axis=1, out=h[:, 1:])
    order = suffix_order(mat, h, group)
    same_group = group[order][1:] == group[order][:-1]
    right = mat[:, _LEFT:]
    differs = right[order[:-1]] != right[order[1:]]
    lcp = np.where(differs.any(axis=1), differs.argmax(axis=1), LENGTH)
    spot = np.minimum(lcp, LENGTH - 1)
    ordered = (lcp == LENGTH) | (right[order[:-1], spot] < right[order[1:], spot])
    if not ordered[same_group].all():  # hashes collided: sort the bytes themselves
        flat = np.ascontiguousarray(right).view(f"V{LENGTH}").ravel()
        order = np.array(sorted(range(len(mat)), key=lambda i: (group[i], flat[i].tobytes())))
        differs = right[order[:-1]] != right[order[1:]]
        lcp = np.where(differs.any(axis=1), differs.argmax(axis=1), LENGTH)
    lcp = np.where(same_group, lcp, -1)
    out = np.zeros((len(mat), _LEFT + 1), dtype=bool)
    for o in range(_LEFT + 1):
        run = np.concatenate([[0], np.cumsum(lcp < LENGTH - o)])
        live = np.flatnonzero((o_lo[order] <= o) & (o <= o_hi[order]))
        if len(live) < 2:
            continue
        rows, runs = order[live], run[live]
        left = h[rows, _LEFT] - h[rows, _LEFT - o]
        by = np.lexsort((rank[rows], left, runs))
        rows, runs, left = rows[by], runs[by], left[by]
        head = np.concatenate([[True], (runs[1:] != runs[:-1]) | (left[1:] != left[:-1])])
        leader = rows[np.flatnonzero(head)[np.cumsum(head) - 1]]
        again = np.flatnonzero(~head)
        a, b = rows[again], leader[again]
        true = (mat[a, _LEFT - o : _LEFT] == mat[b, _LEFT - o : _LEFT]).all(axis=1)
        out[a[true], o] = True
        for i in a[~true]:  # hashes collided: look for any earlier row with the same bytes
            peers = live[(run[live] == run[np.flatnonzero(order == i)[0]])]
            rows_ = order[peers]
            rows_ = rows_[rank[rows_] < rank[i]]
            out[i, o] = (mat[rows_, _LEFT - o : _LEFT] == mat[i, _LEFT - o : _LEFT]).all(axis=1).any()
    return out


SPANS = "doc_id long, a long, b long"


def _span_batch(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, a, b)], names=["doc_id", "a", "b"])


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans that the suffix sort finds in rows sorted by k-mer; a group may go over batches."""
    held: list[pa.Table] = []

    def solve(table: pa.Table) -> pa.RecordBatch:
        col = {c: table.column(c).to_numpy() for c in ("kmer", "doc_id", "pos", "lo", "hi")}
        mat = np.frombuffer(b"".join(table.column("bytes").to_pylist()), dtype=np.uint8).reshape(-1, _WIDTH)
        by = np.lexsort((col["pos"], col["doc_id"]))
        rank = np.empty(len(by), dtype=np.int64)
        rank[by] = np.arange(len(by))
        group = np.concatenate([[0], np.cumsum(col["kmer"][1:] != col["kmer"][:-1])])
        found = covered_offsets(mat, group, rank, col["pos"] - col["hi"], col["pos"] - col["lo"])
        edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, first = np.nonzero(edge == 1)
        last = np.nonzero(edge == -1)[1] - 1
        return _span_batch(col["doc_id"][row], col["pos"][row] - last, col["pos"][row] - first + LENGTH)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        kmers = batch.column("kmer").to_numpy()
        first = int(np.searchsorted(kmers, kmers[-1], side="left"))
        if first or sum(t.num_rows for t in held) > batch.num_rows:
            if first == 0:
                if held[-2].column("kmer")[-1].as_py() == int(kmers[-1]):
                    continue
            whole = pa.concat_tables([*held[:-1], held[-1].slice(0, first)])
            held = [held[-1].slice(first)]
            if whole.num_rows:
                yield solve(whole)
    if held:
        yield solve(pa.concat_tables(held))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single windows of k-mers with very many contexts: ``(doc_id, p, h1, h2)``."""
    for batch in batches:
        ids, w, h1, h2 = [], [], [], []
        for i, pos, lo, hi, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "pos", "lo", "hi", "bytes"))):
            for p in range(lo, hi + 1):
                at = _LEFT - (pos - p)
                d = hashlib.blake2b(raw[at : at + LENGTH], digest_size=16).digest()
                ids.append(i), w.append(p), h1.append(int.from_bytes(d[:8], "big", signed=True)), h2.append(int.from_bytes(d[8:], "big", signed=True))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, w, h1, h2)], names=["doc_id", "p", "h1", "h2"])


def repeated_spans(docs: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """``(doc_id, a, b)``: byte ranges ``[a, b)`` covered by strings that also start earlier; may overlap."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    counts = texts.mapInArrow(_anchor_counts, "kmer long, n long")
    # Written first, so that the semi-join's stage holds no grouping and a frequent k-mer's rows can be split.
    repeated = materialise(counts.groupBy("kmer").agg(F.sum("n").alias("n")).where("n > 1").select("kmer"), "kmers")
    anchors = texts.mapInArrow(_anchor_rows, ANCHORS)
    place = F.struct("doc_id", "pos").alias("place")
    shape = F.shiftleft(F.col("pos") - F.col("lo"), 8) + (F.col("pos") - F.col("hi"))
    some = materialise(anchors.join(repeated, "kmer", "left_semi").select("kmer", "ctx", "ctx2", shape.alias("shape"), "doc_id", "pos"), "anchors")
    key = ["kmer", "ctx", "ctx2", "shape"]
    classes = materialise(some.groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("n")), "classes")
    span_a, span_b = F.col("pos") - F.shiftright("shape", 8), F.col("pos") - F.col("shape").bitwiseAND(255)
    many = classes.where("n > 1").select(*key, "first")
    members = (
        some.join(many, key)
        .where("struct(doc_id, pos) <> first")
        .select("doc_id", span_a.alias("a"), (span_b + LENGTH).alias("b"))
    )
    contested = materialise(classes.groupBy("kmer").agg(F.count("*").alias("n_ctx")).where("n_ctx > 1"), "contested")
    spots = (
        classes.join(contested, "kmer")
        .select("kmer", "shape", "first.doc_id", "first.pos", (F.col("n_ctx") > max_group).alias("hot"))
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("kmer", "pos", span_a.alias("lo"), span_b.alias("hi"), "hot")).alias("spots"))
    )
    fetched, path = materialise_at(
        texts.join(spots, "doc_id").mapInArrow(_fetch, "kmer long, doc_id long, pos long, lo long, hi long, hot boolean, bytes binary"),
        "contexts",
    )
    cold = fetched.where("not hot").drop("hot").repartition("kmer").sortWithinPartitions("kmer")
    by_sort = cold.mapInArrow(_sorted_groups, SPANS)
    windows = fetched.where("hot").mapInArrow(_windows, "doc_id long, p long, h1 long, h2 long")
    firsts = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "p")).alias("first"), F.count("*").alias("n")).where("n > 1")
    by_window = windows.join(firsts, ["h1", "h2"]).where("struct(doc_id, p) <> first").select("doc_id", F.col("p").alias("a"), (F.col("p") + LENGTH).alias("b"))
    found = materialise(members.unionByName(by_sort).unionByName(by_window), "spans")
    remove(spark, path)
    return found


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for i, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3))):
            raw = (text or "").encode()
            merged: list[list[int]] = []
            for s in sorted((s["a"], min(s["b"], len(raw))) for s in spans or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                elif s[0] < s[1]:
                    merged.append([*s])
            digest, at = hashlib.sha256(), 0
            for a, b in merged:
                digest.update(raw[at:a])
                at = b
            digest.update(raw[at:])
            out.append((i, len(raw), sum(b - a for a, b in merged), merged, digest.hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], names=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"])


def dedup_substrings(docs: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, spans, kept_sha256)`` of every row of ``docs``.

    ``spans`` are the removed byte ranges, sorted and apart. A null text is the empty one; texts
    shorter than a window keep all. Rows with a null id neither lose bytes nor make others lose any.
    Rows that repeat an id with the same text are one document, so they do not remove each other and
    lose the same. Of different texts under one id the last by code point is that document; the others
    are treated like rows with a null id. Other columns, whatever their names, are ignored; an empty table
    gives an empty result.
    """
    base = docs.select(F.col("doc_id").cast("long"), "text")
    given = base.where("doc_id is not null")
    again = materialise(given.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated_ids")
    searched, whose = given, F.lit(True)
    if not again.isEmpty():
        last = materialise(given.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text")), "repeated_rows")
        searched = given.join(again, "doc_id", "left_anti").unionByName(last)
        base = base.join(last.toDF("_again", "_last"), F.col("doc_id") == F.col("_again"), "left")
        whose = F.col("_last").isNull() | (F.col("_last") == F.coalesce("text", F.lit("")))
    spans = repeated_spans(searched, max_group)
    per_doc = spans.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("spans")).withColumnRenamed("doc_id", "_doc")
    return base.join(per_doc, (F.col("doc_id") == F.col("_doc")) & whose, "left").select("doc_id", "text", "spans").mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, spans array<array<bigint>>, kept_sha256 string"
    )
