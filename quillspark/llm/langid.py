"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.ftrl import Ftrl, softmax, temperature
from quillspark.llm.sampling import bounded_sample, held_out

#: Hashed n-gram features; the model's size, whatever the corpus.
BUCKETS = 1 << 15
#: Bound of the training sample: rows of each language that the weights are fitted on.
SAMPLE_PER_LANG = 800
EPOCHS = 4
UNDETERMINED = "und"


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed 1-, 2- and 3-grams of the lower-case text; None if it has no letter.

    Runs of anything but letters count as one space, so marks and digits carry no weight.
    """
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.concatenate([[32], codes[keep], [32]]).astype(np.uint32)
    one = c * np.uint32(2654435761)
    two = (one[:-1] ^ (c[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
    three = (two[:-1] ^ (c[2:] * np.uint32(668265263))) * np.uint32(374761393)
    shift = np.uint32(32 - 15)
    return np.bincount(np.concatenate([one >> shift, two >> shift, three >> shift]), minlength=BUCKETS)


def _tf_idf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    return at, x / max(float(np.sqrt(x @ x)), 1e-12)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(BUCKETS, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if (counts := ngram_counts(text)) is not None:
                df += counts > 0
                n += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], names=["bucket", "n"])


def _features(idf: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (counts := ngram_counts(text)) is not None:
                    at, x = _tf_idf(counts, idf)
                    out.append((lang, at.astype(np.int32).tobytes(), x.astype(np.float32).tobytes()))
            cols = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["lang", "at", "x"])

    return rows


@dataclass
class LanguageModel:
    """Languages, inverse document frequencies, weights (languages x buckets) and temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = ngram_counts(text) if self.langs else None
        if counts is None:
            return UNDETERMINED, 0.0
        at, x = _tf_idf(counts, self.idf)
        p = softmax((self.weights[:, at] @ x + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def fit_language_model(docs: DataFrame, learnable: Column, per_lang: int = SAMPLE_PER_LANG, seed: int = 5) -> LanguageModel:
    """Fit on the rows where ``learnable`` holds and ``lang`` is not null.

    Document frequencies come from all these rows: each task sends one row per bucket. The weights come
    from at most ``per_lang`` rows of each language (of rows that repeat an id one counts, that of the last
    text by code point), of which every fifth is held back for the temperature. Only these rows' features, not their texts, reach the driver.
    """
    spark = docs.sparkSession
    rows = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sums = rows.select("text").mapInArrow(_document_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = {r["bucket"]: r["n"] for r in sums.collect()}
    n_docs = found.pop(-1, 0)
    df = np.zeros(BUCKETS)
    df[list(found)] = list(found.values())
    idf = np.log((1 + n_docs) / (1 + df)) + 1

    chosen = bounded_sample(rows.select("doc_id", "lang"), "lang", per_lang, seed).select("doc_id").distinct()
    # At most per_lang ids for each language: small by construction.
    # One text for each of them and language, so that rows which repeat an id do not add to it.
    sample = rows.join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id", "lang").agg(F.max("text").alias("text")).select("lang", "text")
    data = sorted((r["lang"], bytes(r["at"]), bytes(r["x"])) for r in sample.mapInArrow(_features(idf), "lang string, at binary, x binary").collect())
    langs = sorted({d[0] for d in data})
    number = {lang: k for k, lang in enumerate(langs)}
    examples = [(number[a], np.frombuffer(b, np.int32), np.frombuffer(c, np.float32).astype(float)) for a, b, c in data]
    np.random.default_rng(seed).shuffle(examples)
    back = [e for k, e in enumerate(examples) if k % 5 == 4]
    front = [e for k, e in enumerate(examples) if k % 5 != 4]
    k = len(langs)
    model, bias = Ftrl(k, BUCKETS, alpha=1.0, l1=0.05, l2=0.01), np.zeros(k)
    for _ in range(EPOCHS):
        for y, at, x in front:
            p = softmax(model.weights(at) @ x + bias)
            p[y] -= 1
            model.step(at, p[:, None] * x[None, :])
            bias -= 0.01 * p
    w = model.weights().astype(np.float32) if k else np.zeros((0, BUCKETS), np.float32)
    logits = np.array([w[:, at] @ x + bias for _, at, x in back]).reshape(len(back), k)
    return LanguageModel(langs, idf, w, bias, temperature(logits, np.array([e[0] for e in back], dtype=int)) if k else 1.0)


def detect_language(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score`` for every row, from the whole text alone.

    A text that is null, empty or without letters gives ``und`` and score 0, as does any text if the
    model was fitted on no row. Of equally likely languages the first by name is taken. Rows stand for
    themselves, repeated ones too; ``keep`` may have columns named ``lang_pred`` or ``score``, which the
    result then has twice (:func:`known_language` does not). An empty table gives an empty result.
    """
    return _predicted(docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), "text"), model).select("row.*", "lang_pred", "score")


def _predicted(given: DataFrame, model: LanguageModel) -> DataFrame:
    """``(row, lang_pred, score)`` of ``(row, text)``, or of ``row`` alone if that struct has the text."""
    shared = given.sparkSession.sparkContext.broadcast(model)
    own = "text" in given.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text") if own else batch.column("row").field("text")
            made = [shared.value.predict(t.as_py()) for t in texts]
            cols = list(zip(*made)) if made else [[], []]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64())], names=["row", "lang_pred", "score"])

    return given.mapInArrow(rows, T.StructType([given.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def known_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs``, with its columns, whose language can be told.

    Documents without a letter (null and empty texts too) go. If the model was fitted on no row, those
    with letters stay, as nothing speaks against them. Columns may have any names.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    if not model.langs:
        return rows.where(F.coalesce(F.col("row.text").rlike(r"\p{L}"), F.lit(False))).select("row.*")
    return _predicted(rows, model).where(F.col("lang_pred") != UNDETERMINED).select("row.*")


def identify(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``: fitted on rows outside the held-out fold, applied to all.

    Null ids are in no fold and are not learned from. Other columns, whatever their names, are ignored.
    """
    model = fit_language_model(docs, ~held_out() & F.col("doc_id").isNotNull())
    return detect_language(docs.select("doc_id", "text", held_out().alias("held_out")), model, ("doc_id", "held_out"))
