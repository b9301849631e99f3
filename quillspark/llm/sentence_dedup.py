"""Substring dedup by sliding spans of sentences."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.storage import materialise

MIN_SENTENCES = 2
MIN_WORDS = 12
_SENTENCE = re.compile(r"[^.!?。！？\n]*(?:[.!?。！？\n]+\s*|$)")


def sentences(text: str) -> list[str]:
    """The text cut after sentence ends and line feeds; the pieces joined are the text."""
    return [s for s in _SENTENCE.findall(text) if s]


def spans_of(parts: list[str], min_sentences: int, min_words: int) -> Iterator[tuple[int, int]]:
    """``(start, n)``: from each sentence the shortest run with enough sentences and words.

    A run's length depends on its own sentences only, so a repeated passage has the same runs wherever
    it stands.
    """
    words = [len(p.split()) for p in parts]
    end = have = 0
    for start in range(len(parts)):
        while end < len(parts) and (end - start < min_sentences or have < min_words):
            have += words[end]
            end += 1
        if end - start < min_sentences or have < min_words:
            return
        yield start, end - start
        have -= words[start]


def runs_of(parts: list[str], n: int = MIN_SENTENCES) -> Iterator[tuple[int, int]]:
    """``(start, n)``: every run of ``n`` sentences, or the whole text if it has fewer.

    Pieces without any character but spaces (a text's first may be one) are no sentences and go with
    the next.
    """
    real = [k for k, p in enumerate(parts) if p]
    if len(real) < n:
        if parts:
            yield 0, len(parts)
        return
    for k, (a, b) in enumerate(zip(real, real[n - 1 :])):
        start = a if k else 0
        yield start, b + 1 - start


def _whole(parts: list[str]) -> Iterator[tuple[int, int, int]]:
    """Runs by the digests of their sentences, so that no joint can be mistaken for a sentence's own text."""
    each = [xxhash.xxh3_128_digest(p) if p else b"" for p in parts]
    for start, n in runs_of(parts):
        yield start, n, xxhash.xxh3_128_intdigest(b"".join(each[start : start + n]))


def _at_least(min_sentences: int, min_words: int):
    def rows(parts: list[str]) -> Iterator[tuple[int, int, int]]:
        for start, n in spans_of(parts, min_sentences, min_words):
            yield start, n, xxhash.xxh3_128_intdigest(" ".join(parts[start : start + n]))

    return rows


def _spans(runs: Callable[[list[str]], Iterable[tuple[int, int, int]]]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, sizes, h1, h2 = [], [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = [p.strip() for p in sentences(text or "")]
                for start, n, d in runs(parts):
                    ids.append(i)
                    starts.append(start)
                    sizes.append(n)
                    h1.append((d >> 64) - (1 << 63))
                    h2.append((d & (1 << 64) - 1) - (1 << 63))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())],
                names=["doc_id", "start", "n", "h1", "h2"],
            )

    return rows


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for i, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3))):
            parts, kept, at = sentences(text or ""), [], 0
            for s in spans or ():
                kept += parts[at : s["a"]]
                at = s["b"]
            kept += parts[at:]
            out.append((i, len(parts), len(parts) - len(kept), len(spans or ()), "".join(kept)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], names=["doc_id", "n_sentences", "n_removed", "n_spans", "kept_text"])


def dedup_sentences(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, n_sentences, n_removed, n_spans, kept_text)`` of every row.

    A span is a run of at least two sentences and twelve words, compared after trimming each sentence
    (128-bit hash). Sentences covered by a span that also starts earlier, in a smaller ``doc_id`` or
    before in the same text, are removed. Spans that occur once leave by a count and a semi-join on
    half of the hash; first places come from a partial aggregation and are joined back, so a frequent
    span's rows may be split over tasks.

    A null text counts as empty (no sentences). Rows with a null id are never cut and cut no others;
    rows that repeat an id with the same text count as one document. Other columns are ignored.
    """
    return _dedup(docs, _at_least(min_sentences, min_words))


def dedup_runs(docs: DataFrame) -> DataFrame:
    """As :func:`dedup_sentences`, for every run of two sentences however short, up to the text's end.

    A repeated run of more sentences is repeated pair by pair, so this removes all repeated runs of
    several sentences. A text of fewer sentences is compared as a whole, with such texts only.
    """
    return _dedup(docs, _whole)


def _dedup(docs: DataFrame, runs: Callable[[list[str]], Iterable[tuple[int, int, int]]]) -> DataFrame:
    base = docs.select(F.col("doc_id").cast("long"), "text")
    # Written once, as it is read twice and costs most: some 20 bytes a sentence.
    spans = materialise(base.where("doc_id is not null").mapInArrow(_spans(runs), "doc_id long, start int, n int, h1 long, h2 long"), "runs")
    # Written first, so that the semi-join's stage holds no grouping and a frequent span's rows can be split.
    again = materialise(spans.groupBy("h1").count().where("count > 1").select("h1"), "again")
    some = materialise(spans.join(again, "h1", "left_semi"), "spans")
    firsts = materialise(some.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("c")).where("c > 1"), "firsts")
    later = some.join(firsts, ["h1", "h2"]).where("struct(doc_id, start) <> first").select("doc_id", "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    merged = (
        later.withColumn("_new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
        .withColumn("_run", F.sum("_new").over(order))
        .groupBy("doc_id", "_run")
        .agg(F.min("start").alias("a"), F.max("end").alias("b"))
        .groupBy(F.col("doc_id").alias("_doc"))
        .agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))
    )
    return base.join(merged, F.col("doc_id") == F.col("_doc"), "left").select("doc_id", "text", "spans").mapInArrow(
        _cut, "doc_id long, n_sentences long, n_removed long, n_spans long, kept_text string"
    )
