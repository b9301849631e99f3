"""How much the sources of a language differ in their words, by sorted pointers to word starts.

Each task holds the bytes of its documents as Arrow delivers them and an array of pointers to the starts of
words. A multikey quicksort orders the pointers of a slice; equal words are then a run, and as pointers of equal
words keep the order of their documents, a run's parts give the counts of each source and the documents that
hold the word. Only these counts leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.words import LETTERS, Words, find_words, slices, texts_of
from quillspark.storage import materialise

#: A term is kept if it is in at least so many documents of its language.
DOCUMENTS = 30
#: Added to every count.
SMOOTHING = 5
#: Shares are whole numbers of this.
UNIT = 1_000_000_000
TERMS = 50
#: Bytes of text whose pointers are sorted at a time; a longer text is sorted alone.
SLICE = 8 << 20
#: Terms times sources of a table of shares, of which a task holds one.
CELLS = 1 << 18


def multikey_quicksort(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Pointers in the order of their words, equal ones in their own order, and whether each begins a run of equals.

    All segments of a round are parted at once, by eight bytes of their words: each into those below its pivot
    (the median of three), those equal to it and those above. Equal ones go on with the next eight bytes, or are
    done where the word ends in these.
    """
    n = len(words.start)
    order, head = np.empty(n, dtype=np.int64), np.zeros(n, dtype=bool)
    ptr, key = np.arange(n), words.keys(slice(None))
    base, size, depth = np.array([0]), np.array([n]), np.array([0])

    def place(at: np.ndarray, count: np.ndarray, pointers: np.ndarray) -> None:
        order[np.repeat(at - (np.cumsum(count) - count), count) + np.arange(len(pointers))] = pointers
        head[at] = True

    while len(ptr):
        first = np.cumsum(size) - size
        a, b, c = key[first], key[first + size // 2], key[first + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))
        wide = np.repeat(pivot, size)
        less, equal = key < wide, key == wide
        n_less, n_equal = np.add.reduceat(less, first, dtype=np.int64), np.add.reduceat(equal, first, dtype=np.int64)
        parts = []
        ended = (pivot & np.uint64(0xFF)) == 0
        for which, at, count, over in (
            (less, base, n_less, n_less <= 1),
            (equal, base + n_less, n_equal, ended | (n_equal == 1)),
            (~(less | equal), base + n_less + n_equal, size - n_less - n_equal, size - n_less - n_equal <= 1),
        ):
            spots = np.flatnonzero(which)
            done = np.repeat(over, count)
            place(at[over & (count > 0)], count[over & (count > 0)], ptr[spots[done]])
            spots, live = spots[~done], ~over
            deeper = depth[live] + 8 * (which is equal)
            left = ptr[spots]
            parts.append((left, words.keys(left, np.repeat(deeper, count[live])) if which is equal else key[spots], at[live], count[live], deeper))
        ptr, key, base, size, depth = (np.concatenate(x) for x in zip(*parts))
    return order, head


def _strings(words: Words, which: np.ndarray) -> pa.Array:
    """The words as Arrow strings, copied byte by byte from where they are."""
    start, size = words.start[which], words.end[which] - words.start[which]
    bounds = np.concatenate([[0], np.cumsum(size)])
    raw = words.data[np.repeat(start - bounds[:-1], size) + np.arange(bounds[-1])]
    return pa.StringArray.from_buffers(len(which), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(raw))


def slice_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``(lang, source, term, n, docs)`` of a slice ``(text, lang, source)`` that is sorted by language and source."""
    words = find_words(*texts_of(batch.column(0)), LETTERS)
    lang, source = batch.column(1).dictionary_encode(), batch.column(2).dictionary_encode()
    group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(zero_copy_only=False)
    order, head = multikey_quicksort(words)
    row = words.row[order]
    of = group[row]
    part = head.copy()
    part[1:] |= of[1:] != of[:-1]
    begin = np.flatnonzero(part)
    n = np.diff(np.append(begin, len(order)))
    new = part.copy()
    new[1:] |= row[1:] != row[:-1]
    docs = np.add.reduceat(new, begin, dtype=np.int64) if len(begin) else n
    which = of[begin]
    return pa.RecordBatch.from_arrays(
        [lang.dictionary.take(pa.array(which // max(1, len(source.dictionary)))), source.dictionary.take(pa.array(which % max(1, len(source.dictionary)))),
         _strings(words, order[begin]), pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
        names=["lang", "source", "term", "n", "docs"],
    )


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch = batch.take(pc.sort_indices(batch, sort_keys=[("lang", "ascending"), ("source", "ascending")]))
        for part in slices(batch, 0, SLICE):
            yield slice_counts(part)


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences of each word in a source, and rows of ``docs`` with it.

    Words are runs of ASCII letters and characters beyond ASCII, with A-Z in lower case. Null texts, languages and
    sources are empty strings.
    """
    some = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counted = some.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column, smoothing: int = SMOOTHING, unit: int = UNIT) -> Column:
    """``1 + floor(unit * (count + smoothing) / (total + smoothing * terms))``, exactly; null without terms."""
    above = F.lit(unit).cast("decimal(10,0)") * (count + smoothing).cast("decimal(19,0)")
    return F.call_function("div", above, F.nullif(total + smoothing * terms, F.lit(0)).cast("decimal(19,0)")) + 1


def _distances(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Sums of differences between the shares of each two sources of a language, over a shard's terms."""
    right = right.sort_values("source", kind="stable")
    names = right["source"].to_numpy()
    terms, col = np.unique(left["term"].to_numpy(dtype=object), return_inverse=True)
    table = np.repeat(right["p0"].fillna(0).to_numpy(dtype=np.int64)[:, None], len(terms), axis=1)
    place = {s: k for k, s in enumerate(names)}
    table[left["source"].map(place).to_numpy(dtype=np.int64), col] = left["p"].to_numpy(dtype=np.int64)
    apart = [np.abs(table[k + 1 :] - table[k]).sum(axis=1) for k in range(len(names) - 1)]
    a, b = np.triu_indices(len(names), 1)
    return pd.DataFrame({"lang": right["lang"].iloc[0] if len(right) else "", "a": names[a], "b": names[b], "value": np.concatenate([np.zeros(0, dtype=np.int64), *apart])})


def source_divergence(docs: DataFrame, documents: int = DOCUMENTS, terms: int = TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for every language and source of ``docs``, ``(text, lang, source)``.

    A language keeps the terms (words of :func:`term_counts`) that at least ``documents`` of its rows hold. A group
    is a language and a source that occur together, also if no word does; :func:`share` gives each kept term's share
    in a group, and in the language. Part ``pair``: for each other source of the language, how far the shares are
    apart, summed over all kept terms (0 if there are none), all ranks. Part ``term``: for each kept term that the
    group has and that has a larger share in it than in the language, the difference, the first ``terms`` ranks.
    Ranks go from 1 in each group and part, by value, largest first, then by the item's UTF-8 bytes.

    Null texts, languages and sources count as empty strings; repeated rows count each; an empty table gives an empty
    result; a language with one source has no pairs. Other columns are ignored.

    Tasks send counts, not words. Terms are dealt into shards, each with a table of a bounded number of shares;
    a shard returns one row for each two sources, as the result has.
    """
    counts = term_counts(docs)
    same = Window.partitionBy("lang", "term")
    found = materialise(
        counts.withColumn("n_lang", F.sum("n").over(same))
        .withColumn("held", F.sum("docs").over(same))
        .where(F.col("held") >= documents)
        .withColumn("first", F.row_number().over(same.orderBy("source")) == 1)
        .select("lang", "source", "term", "n", "n_lang", "first"),
        "terms",
    )
    groups = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    of_lang = found.groupBy("lang").agg(F.count_if("first").alias("terms"), F.sum("n").alias("total_lang"))
    of_group = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    known = groups.join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left").fillna(0, ["terms", "total_lang", "total"])
    stats = materialise(known.withColumn("p0", share(F.lit(0), F.col("total"), F.col("terms"))), "groups")
    most_terms, most_sources = stats.groupBy("lang").agg(F.first("terms").alias("v"), F.count("*").alias("s")).agg(F.max("v"), F.max("s")).first()
    shards = max(1, -(-(most_terms or 0) // max(1, CELLS // (most_sources or 1))))
    shared = found.join(stats, ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("n_lang"), F.col("total_lang"), F.col("terms")).alias("q")
    )
    key = ["lang", "shard"]
    cells = shared.select("lang", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"), "source", "term", "p").groupBy(*key)
    every = stats.select("lang", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "source", "p0").groupBy(*key)
    apart = cells.cogroup(every).applyInPandas(_distances, "lang string, a string, b string, value long")
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = apart.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).select("lang", both.alias("x"), "value").select("lang", "x.*", "value")
    over = shared.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(pairs, "pair").unionByName(ranked(over, "term").where(F.col("rank") <= terms))
