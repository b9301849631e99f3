"""Benchmark decontamination by an FM-index over each shard of the training texts.

A shard is a slice of documents. Its index holds the words that the benchmark knows, as numbers; all other
words only separate. The Burrows-Wheeler transform of that sequence lies in a wavelet matrix, whose bit ranks
drive backward search: all test phrases of a shard are searched at once, from their last word to their first.
Occurrences are located by stepping back to sampled suffix positions, checked on the bytes of the texts, and
merged to spans of words to remove.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.words import LETTERS_DIGITS, Words, find_words, slices, texts_of
from quillspark.storage import materialise

WINDOW = 10
#: Words of test phrases that a pass over the documents takes along. More items are more passes.
PHRASE_WORDS = 250_000
#: An item of more words than this is cut into pieces, which overlap by all words of a window but one.
PIECE = 4_096
#: Bytes of text of a shard; a longer text is a shard of its own.
SHARD = 8 << 20
#: A suffix position in so many is kept.
SAMPLE = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word, from its bytes eight at a time."""
    out = (words.end - words.start).astype(np.uint64) * _ODD
    depth, live = 0, np.arange(len(words.start))
    while len(live):
        x = (out[live] ^ words.keys(live, depth)) * _ODD
        out[live] = x ^ (x >> np.uint64(29))
        depth += 8
        live = live[words.end[live] - words.start[live] > depth]
    return out


class WaveletMatrix:
    """Ranks over a sequence of small numbers: one bit vector a level, of packed bits and counts before each 64."""

    def __init__(self, values: np.ndarray, top: int):
        self.n, self.levels = len(values), []
        for level in reversed(range(max(1, int(top).bit_length()))):
            bit = (values >> level) & 1
            zeros = int(len(bit) - bit.sum())
            packed = np.packbits(np.pad(bit.astype(np.uint8), (0, -len(bit) % 64 + 64)), bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.levels.append((level, packed, before, zeros))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    @staticmethod
    def _ones(packed: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(packed[word] & mask)

    def rank(self, value: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``value`` is among the first ``i``, for each of many."""
        lo = np.zeros(len(i), dtype=np.int64)
        for level, packed, before, zeros in self.levels:
            one = ((value >> level) & 1).astype(bool)
            a, b = self._ones(packed, before, lo), self._ones(packed, before, i)
            lo, i = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, i - b)
        return i - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at ``i``."""
        out = np.zeros(len(i), dtype=np.int64)
        for level, packed, before, zeros in self.levels:
            one = ((packed[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            ones = self._ones(packed, before, i)
            out |= one.astype(np.int64) << level
            i = np.where(one, zeros + ones, i - ones)
        return out


def suffix_array(values: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling what they are compared on; of equal zeros (separators) the later is larger.

    A comparison so never goes beyond a separator, and the rounds follow the longest run between two of them.
    """
    n = len(values)
    key = values.astype(np.int64) + 1
    sep = np.flatnonzero(values == 0)
    key = np.where(values == 0, 0, key + len(sep))
    key[sep] = np.arange(1, len(sep) + 1)
    order = np.argsort(key, kind="stable")
    width = 1
    ranked = key[order]
    rank = np.empty(n, dtype=np.int64)
    head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    while True:
        alone = head & np.append(head[1:], True)
        open_ = np.flatnonzero(~alone)  # places whose suffixes still have equals; they stay within their places
        if not len(open_):
            return order
        at = order[open_]
        after = np.where(at + width < n, rank[np.minimum(at + width, n - 1)] + 1, 0)
        by = np.lexsort((after, rank[at]))
        at, group, after = at[by], rank[at][by], after[by]
        order[open_] = at
        head[open_] = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        rank[at] = open_[np.flatnonzero(head[open_])[np.cumsum(head[open_]) - 1]]
        width *= 2


class FMIndex:
    """Backward search over a sequence of numbers from 1 on, in which zeros separate and none matches a zero."""

    def __init__(self, values: np.ndarray, top: int, sample: int = SAMPLE):
        order = suffix_array(values)
        self.last = values[order - 1]  # the one before the first is a separator, as the sequence ends with one
        self.wavelet = WaveletMatrix(self.last, top)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(values, minlength=top + 1))])
        # Stepping back must not cross a separator, so a run's first position is kept, too.
        kept = (order % sample == 0) | (self.last == 0)
        self.kept = np.packbits(np.pad(kept.astype(np.uint8), (0, -len(kept) % 64 + 64)), bitorder="little").view(np.uint64)
        self.kept_before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.kept), dtype=np.int64)])
        self.positions = order[kept]

    def back(self, value: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.smaller[value] + self.wavelet.rank(value, i)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes ``[lo, hi)`` that begin with each phrase; ``phrases`` has their words from the left, zeros after."""
        lo, hi = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.wavelet.n)
        for k in reversed(range(phrases.shape[1])):
            live = np.flatnonzero((lengths > k) & (lo < hi))
            word = phrases[live, k]
            lo[live], hi[live] = self.back(word, lo[live]), self.back(word, hi[live])
        return lo, hi

    def locate(self, i: np.ndarray) -> np.ndarray:
        """Positions of suffixes by their places in the order."""
        out, steps = np.zeros(len(i), dtype=np.int64), np.zeros(len(i), dtype=np.int64)
        live = np.arange(len(i))
        i = i.copy()
        while len(live):
            at = i[live]
            bit = ((self.kept[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            there = at[bit]
            out[live[bit]] = self.positions[WaveletMatrix._ones(self.kept, self.kept_before, there)] + steps[live[bit]]
            live, at = live[~bit], at[~bit]
            steps[live] += 1
            i[live] = self.back(self.wavelet.access(at), at)
        return out


@dataclass
class Phrases:
    """Distinct windows of items: words as numbers from 1 on, ``vocabulary`` in their order, and items of each window."""

    vocabulary: list[str]
    hashes: np.ndarray
    numbers: np.ndarray
    windows: np.ndarray
    lengths: np.ndarray
    item_at: np.ndarray
    items: list

    @classmethod
    def of(cls, items: list[tuple[object, list[str]]], window: int) -> Phrases:
        """``items``: ids and words. An item of fewer words than ``window`` is one window."""
        vocabulary = sorted({w for _, words in items for w in words})
        number = {w: k + 1 for k, w in enumerate(vocabulary)}
        owners: dict[tuple[int, ...], set] = {}
        for item, words in items:
            ids = [number[w] for w in words]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[k : k + window]), set()).add(item)
        lengths = np.array([len(w) for w in owners], dtype=np.int64)
        windows = np.zeros((len(owners), window), dtype=np.int64)
        for k, w in enumerate(owners):
            windows[k, : len(w)] = w
        data, bounds = texts_of(pa.array([" ".join(vocabulary)], pa.string()))
        hashes = word_hashes(find_words(data, bounds, LETTERS_DIGITS))
        if len(np.unique(hashes)) < len(hashes):
            raise RuntimeError("two words of the items have one hash")  # never seen; 2**-64 a pair
        order = np.argsort(hashes)
        own = [sorted(o, key=lambda x: (x is None, x)) for o in owners.values()]
        return cls(vocabulary, hashes[order], order + 1, windows, lengths, np.cumsum([0, *map(len, own)]), [i for o in own for i in o])

    def numbers_of(self, words: Words) -> np.ndarray:
        """Each word's number, 0 if no item has it (or, with a chance of 2**-64, one of the same hash)."""
        if not len(self.hashes):
            return np.zeros(len(words.start), dtype=np.int64)
        h = word_hashes(words)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.numbers[at], 0)


def _true_words(words: Words, which: np.ndarray, numbers: np.ndarray, vocabulary: list[str]) -> np.ndarray:
    """Whether the words ``which`` are, byte by byte, those that their numbers stand for."""
    some, of = np.unique(numbers, return_inverse=True)
    raw = [vocabulary[k - 1].encode() for k in some]
    size = np.array([len(r) for r in raw], dtype=np.int64)
    known = np.zeros((len(raw), size.max(initial=0) + 1), dtype=np.uint8)
    for k, r in enumerate(raw):
        known[k, : len(r)] = np.frombuffer(r, dtype=np.uint8)
    start, length = words.start[which], words.end[which] - words.start[which]
    out = length == size[of]
    for k in range(int(size.max(initial=0))):
        live = np.flatnonzero(out & (length > k))
        out[live] = words.data[start[live] + k] == known[of[live], k]
    return out


def shard_hits(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(position, length, window)`` of every occurrence of a window among the words of a shard."""
    none = (np.zeros(0, dtype=np.int64),) * 3
    if not len(phrases.lengths) or not len(words.start):
        return none
    numbers = phrases.numbers_of(words)
    # Runs of known words of one text; one that is shorter than every window holds none.
    known = numbers > 0
    begins = known & ~np.concatenate([[False], known[:-1] & (words.row[1:] == words.row[:-1])])
    run = np.cumsum(begins) - 1
    size = np.bincount(run[known]) if known.any() else np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(known)
    at = at[size[run[at]] >= phrases.lengths.min()]
    if not len(at):
        return none
    # A separator after each run.
    gap = np.append(run[at][1:] != run[at][:-1], True)
    place = np.arange(len(at)) + np.concatenate([[0], np.cumsum(gap)[:-1]])
    values = np.zeros(len(at) + int(gap.sum()), dtype=np.int64)
    values[place] = numbers[at]
    origin = np.zeros(len(values), dtype=np.int64)
    origin[place] = at
    index = FMIndex(values, len(phrases.vocabulary))
    lo, hi = index.search(phrases.windows, phrases.lengths)
    found = np.flatnonzero(lo < hi)
    n = (hi - lo)[found]
    places = np.repeat(lo[found] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    window = np.repeat(found, n)
    first = origin[index.locate(places)]
    length = phrases.lengths[window]
    # The exact check: a hash may have taken another word for one of the vocabulary.
    covered = np.flatnonzero(_covered(first, length, len(numbers)))
    wrong = covered[~_true_words(words, covered, numbers[covered], phrases.vocabulary)]
    if len(wrong):
        bad = np.concatenate([[0], np.cumsum(np.bincount(wrong, minlength=len(numbers)))])
        true = bad[first + length] == bad[first]
        first, length, window = first[true], length[true], window[true]
    return first, length, window


def _covered(first: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words lie inside any occurrence."""
    return np.cumsum(np.bincount(first, minlength=n + 1) - np.bincount(first + length, minlength=n + 1))[:n] > 0


SPAN = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("from", pa.int64()), ("to", pa.int64())])


def _hits(phrases):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Phrases = phrases.value
        for batch in batches:
            for part in slices(batch, 1, SHARD):
                words = find_words(*texts_of(part.column(1)), LETTERS_DIGITS)
                first, length, window = shard_hits(words, known)
                hit = _covered(first, length, len(words.start)) if len(first) else np.zeros(len(words.start), dtype=bool)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.bincount(words.row, minlength=part.num_rows), pa.int64()), *_added(part, words, hit, first, window, known)],
                    names=["row", "text", "n_words", "spans", "items"],
                )

    return rows


def _added(part: pa.RecordBatch, words: Words, hit: np.ndarray, first: np.ndarray, window: np.ndarray, known: Phrases) -> tuple[pa.Array, pa.Array]:
    """Spans and items of each text: those of earlier passes and what this one has found."""
    spans, items = part.column(2).to_pylist(), part.column(3).to_pylist()
    base = np.searchsorted(words.start, words.bounds[:-1])
    new = np.diff(words.row, prepend=-1) != 0
    before = np.concatenate([[False], hit[:-1]]) if len(hit) else hit
    after = np.append(hit[1:], False) if len(hit) else hit
    ends = np.append(new[1:], True) if len(hit) else new
    a, b = np.flatnonzero(hit & (new | ~before)), np.flatnonzero(hit & (ends | ~after))
    for x, y in zip(a.tolist(), b.tolist()):
        r = int(words.row[x])
        byte = int(words.bounds[r])
        spans[r] = (spans[r] or []) + [{"a": int(x - base[r]), "b": int(y - base[r]) + 1, "from": int(words.start[x]) - byte, "to": int(words.end[y]) - byte}]
    pairs = np.unique(np.stack([words.row[first], window]), axis=1) if len(first) else np.zeros((2, 0), dtype=np.int64)
    found: dict[int, set] = {}
    for r, w in zip(*pairs.tolist()):
        found.setdefault(r, set()).update(known.items[known.item_at[w] : known.item_at[w + 1]])
    for r, more in found.items():
        items[r] = sorted({*(items[r] or []), *more} - {None})
    return pa.array(spans, pa.list_(SPAN)), pa.array(items, pa.list_(pa.int64()))


SPANS = "array<struct<a:long,b:long,from:long,to:long>>"


def _pieces(bench: DataFrame, window: int) -> DataFrame:
    """``(item_id, words)``: items' words in lower case, long items in overlapping pieces."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(low, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"))
    known = bench.where("text is not null").select(F.col("item_id").cast("long"), words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(PIECE))
    return known.select("item_id", "words", F.explode(starts).alias("at")).select("item_id", F.slice("words", F.col("at") + 1, PIECE + window - 1).alias("words"))


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW, phrase_words: int = PHRASE_WORDS) -> DataFrame:
    """``(doc_id, n_words, n_hit, spans, items, kept_text)`` of every row of ``docs``, which is ``(doc_id, text)``.

    ``bench`` is ``(item_id, text)``. Words are runs of letters, digits and characters beyond ASCII, with A-Z in
    lower case. A window is ``window`` consecutive words of an item, or all of an item that has fewer. Words of a
    document that lie inside an occurrence of a window are hit: ``spans`` are maximal runs of them, by word
    ``[a, b)`` and by UTF-8 byte ``[from, to)``; ``items`` are the ids, ascending, whose windows occur; ``kept_text``
    is the text without the spans' bytes, the text itself if there are none.

    A null text, of a document or an item, has no words; a document of such a text keeps it. Words of an item with
    a null id are hit, but it isn't listed. Repeated items count once; each repeated document has its row, null ids
    included. Empty tables give no hits, or no rows. Other columns are ignored.

    Each pass over the documents takes along at most about ``phrase_words`` words of items, whose number is counted
    first; the next pass adds to what the one before has found. Documents are never shuffled.
    """
    spark = docs.sparkSession
    pieces = materialise(_pieces(bench, window).distinct(), "phrases")
    parts = max(1, -(-(pieces.agg(F.sum(F.size("words"))).first()[0] or 0) // phrase_words))
    part = F.pmod(F.xxhash64("item_id", "words"), F.lit(parts))
    out = docs.select(F.col("doc_id").alias("row"), "text", F.lit(None).cast(SPANS).alias("spans"), F.lit(None).cast("array<long>").alias("items"))
    types = out.schema["row"].dataType.simpleString()
    for k in range(parts):
        some = [(r["item_id"], r["words"]) for r in pieces.where(part == k).collect()]
        phrases = spark.sparkContext.broadcast(Phrases.of(some, window))
        out = out.select("row", "text", "spans", "items").mapInArrow(_hits(phrases), f"row {types}, text string, n_words long, spans {SPANS}, items array<long>")
    spans = _merged(F.coalesce("spans", F.array().cast(SPANS))) if parts > 1 else F.coalesce("spans", F.array().cast(SPANS))
    out = out.withColumn("spans", spans)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    raw = F.encode("text", "UTF-8")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["to"]))
    ends = F.concat(F.transform("spans", lambda s: s["from"]), F.array(F.octet_length("text").cast("long")))
    kept = F.array_join(F.zip_with(starts, ends, lambda a, b: F.decode(F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")), "UTF-8")), "")
    return out.select(
        F.col("row").alias("doc_id"), "n_words", n_hit.alias("n_hit"), "spans", F.coalesce("items", F.array().cast("array<long>")).alias("items"),
        F.when(F.size("spans") == 0, F.col("text")).otherwise(kept).alias("kept_text"),
    )


def _merged(spans):
    """Spans of several passes, in order, joined where they overlap or touch."""
    joined = lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= s["a"]),
        F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(
                F.struct(
                    F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], s["b"]).alias("b"),
                    F.element_at(acc, -1)["from"].alias("from"), F.greatest(F.element_at(acc, -1)["to"], s["to"]).alias("to"),
                )
            ),
        ),
    ).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS), joined)
