"""Toxicity by a counterfactual-regularised classifier."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.ftrl import Ftrl
from quillspark.llm.sampling import bounded_sample, held_out

#: Bounds of the training sample: rows of label 1 and of label 0 that the weights are fitted on.
SAMPLE_TOXIC, SAMPLE_CLEAN = 3000, 5000
EPOCHS = 5
#: Weight of the squared change of the score under a swap.
PENALTY = 0.5
#: Words that name groups of people; those of a tuple are swapped for each other.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "transgender"),
    ("woman", "man", "girl", "boy"),
    ("she", "he", "they"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "queer"),
    ("black", "white", "asian", "latino", "arab"),
    ("immigrant", "native", "refugee", "foreigner"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)
#: Lengths of the beginnings of words that count beside the words, as inflected forms share them.
PREFIXES = (4, 5)
_WORD = re.compile(r"\w+")


def words(text: str | None) -> set[str]:
    """Distinct lower-case words of a text."""
    return set(_WORD.findall(text.lower())) if text else set()


def features(present: set[str]) -> set[str]:
    """The words and their beginnings; a beginning ends in ``*``, which no word holds."""
    return present | {f"{w[:k]}*" for w in present for k in PREFIXES if len(w) >= k}


def swaps(present: set[str], terms: Sequence[Sequence[str]]) -> Iterator[set[str]]:
    """The same words with each group's identity terms moved on by one, two, ... places."""
    groups = [g for g in terms if present & set(g)]
    for k in range(1, max((len(g) for g in groups), default=1)):
        move = {t: g[(i + k) % len(g)] for g in groups for i, t in enumerate(g)}
        if (changed := {move.get(w, w) for w in present}) != present:
            yield changed


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        known = self.weights
        total = self.bias + sum(known[w] for w in known.keys() & features(words(text)))
        return float(1 / (1 + np.exp(-max(-40.0, min(40.0, total)))))


def train(
    rows: list[tuple[set[str], int]], terms: Sequence[Sequence[str]] = IDENTITY_TERMS, penalty: float = PENALTY, seed: int = 3, epochs: int = EPOCHS
) -> ToxicityModel:
    """Logistic regression on distinct words and their beginnings, by FTRL with elastic-net penalties.

    For each labelled row that names a group, each epoch also takes one of its swapped versions and
    steps against ``penalty * (score - swapped score)**2`` (scores before the logistic function). Words
    on which two neutral sentences differ only by the group named so end with equal weights.
    """
    count: dict[str, int] = {}
    for present, _ in rows:
        for w in features(present):
            count[w] = count.get(w, 0) + 1
    named = {t for g in terms for t in g}
    vocabulary = sorted(w for w, n in count.items() if n >= 3 or w in named) + sorted(named - set(count))
    number = {w: i for i, w in enumerate(vocabulary)}
    index = lambda present: np.array(sorted(number[w] for w in features(present) if w in number), dtype=np.int64)
    base = sum(y for _, y in rows) / len(rows) if rows else 0.0
    bias = float(np.log((base + 1e-3) / (1 - base + 1e-3))) if rows else -40.0
    data = [(index(p), y, [index(s) for s in swaps(p, terms)]) for p, y in rows]
    model, rng = Ftrl(1, max(1, len(vocabulary)), alpha=0.3, l1=1.0, l2=0.1), np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            at, y, others = data[k]
            p = 1 / (1 + np.exp(-np.clip(model.weights(at).sum() + bias, -40, 40)))
            model.step(at, np.full((1, len(at)), p - y))
            bias -= 0.01 * (p - y)
            if others:
                other = others[int(rng.integers(len(others)))]
                only, theirs = np.setdiff1d(at, other), np.setdiff1d(other, at)
                gap = model.weights(only).sum() - model.weights(theirs).sum()
                if gap:
                    change = np.concatenate([only, theirs])
                    sign = np.concatenate([np.ones(len(only)), -np.ones(len(theirs))])
                    model.step(change, (2 * penalty * gap * sign)[None, :])
    w = model.weights()[0]
    return ToxicityModel({vocabulary[i]: float(w[i]) for i in np.flatnonzero(w)}, bias)


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [" ".join(sorted(words(t))) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "words"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, learnable: Column, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN, seed: int = 11) -> ToxicityModel:
    """Fit on a bounded sample of labelled rows; null labels and ids are no labels.

    An id that several label rows name is toxic if any says so; of several texts of an id the last by code point
    counts.

    Only the labels are sampled over all; the chosen ids, at most ``toxic + clean``, are broadcast to
    pick their texts, and the distinct words of those texts go to the driver.
    """
    known = labels.where(learnable & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = bounded_sample(known.where("toxic = 1"), "toxic", toxic, seed).union(bounded_sample(known.where("toxic = 0"), "toxic", clean, seed))
    y = {r["doc_id"]: r["toxic"] for r in chosen.collect()}
    # At most `toxic + clean` ids: small by construction.
    ids = F.broadcast(docs.sparkSession.createDataFrame([(int(i),) for i in y], "doc_id long"))
    # One text an id, so that rows which repeat an id do not add to what the driver gets.
    texts = docs.join(ids, "doc_id", "left_semi").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("text").alias("text"))
    found = texts.mapInArrow(_word_rows, "doc_id long, words string").collect()
    rows = sorted((r["doc_id"], r["words"]) for r in found)
    return train([(set(w.split(" ")) - {""}, y[i]) for i, w in rows])


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """``keep`` columns with ``score`` and ``predicted`` for every row, from the whole text alone.

    A null text scores as an empty one: the score of no words at all. Texts of any length are read whole. Equal
    texts have equal scores; a score of ``threshold`` itself is predicted 1. Rows stand for themselves, repeated
    ones and those of null ids too.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(t) for t in batch.column("_text").to_pylist()]
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=[*keep, "score", "predicted"])

    given = docs.select(*keep, F.col("text").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != "_text")
    return given.mapInArrow(rows, f"{kinds}, score double, predicted int")


def detect_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``: fitted outside the held-out fold, applied to all rows.

    Without any label every score is that of the bias alone, near 0. Other columns of both tables, whatever
    their names, are ignored; an empty table gives an empty result.
    """
    model = fit_toxicity(docs, labels, ~held_out())
    return score_toxicity(docs.select("doc_id", "text", held_out().alias("held_out")), model, ("doc_id", "held_out"))
