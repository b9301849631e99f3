"""The two classifiers against plain Python: one coordinate at a time, whole vectors, no shortcuts."""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pytest

from quillspark.llm import langid, toxicity

SMALL = "/root/testdata/sf0.001"


class PlainFtrl:
    """McMahan et al. (2013), algorithm 1, for one row of weights."""

    def __init__(self, alpha, l1, l2, beta=1.0):
        self.a, self.l1, self.l2, self.b, self.z, self.n = alpha, l1, l2, beta, {}, {}

    def weight(self, i):
        z = self.z.get(i, 0.0)
        if abs(z) <= self.l1:
            return 0.0
        return -(z - math.copysign(self.l1, z)) / ((self.b + math.sqrt(self.n.get(i, 0.0))) / self.a + self.l2)

    def update(self, i, g, w):
        n = self.n.get(i, 0.0)
        self.z[i] = self.z.get(i, 0.0) + g - (math.sqrt(n + g * g) - math.sqrt(n)) / self.a * w
        self.n[i] = n + g * g


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


# Language ----------------------------------------------------------------------------------------


def grams(text):
    text = (text or "").lower()
    if not any(c.isalpha() for c in text):
        return None
    out, gap = [], False
    for c in text:  # runs of other characters are one space
        if c.isalpha():
            out.append(ord(c))
        elif out and not gap or not out and not gap:
            out.append(32)
        gap = not c.isalpha()
    # A leading or trailing run is a space of its own beside the border's.
    codes = [32, *(out[1:] if out[0] == 32 else out), 32]
    m = 0xFFFFFFFF
    counts = {}
    for k in range(len(codes)):
        h = codes[k] * 2654435761 & m
        add = [h]
        if k + 1 < len(codes):
            h = (h ^ (codes[k + 1] * 2246822519 & m)) * 3266489917 & m
            add.append(h)
        if k + 2 < len(codes):
            add.append((h ^ (codes[k + 2] * 668265263 & m)) * 374761393 & m)
        for x in add:
            counts[x >> 17] = counts.get(x >> 17, 0) + 1
    return counts


def vector(counts, idf, rounded):
    x = {b: (1 + math.log(n)) * idf(b) for b, n in counts.items()}
    norm = math.sqrt(sum(v * v for v in x.values()))
    return {b: float(np.float32(v / norm)) if rounded else v / norm for b, v in x.items()}


def probabilities(weights, bias, x, t=1.0):
    logits = [(sum(w.get(b, 0.0) * v for b, v in x.items()) + c) / t for w, c in zip(weights, bias)]
    e = [math.exp(v - max(logits)) for v in logits]
    return [v / sum(e) for v in e]


def test_language_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    assert all(n < langid.SAMPLE_PER_LANG for n in [len(rows)])
    learn = [(r.lang, grams(r.text)) for r in rows if not held(r.doc_id) and r.lang is not None]
    learn = [(lang, c) for lang, c in learn if c is not None]
    df = {}
    for _, c in learn:
        for b in c:
            df[b] = df.get(b, 0) + 1
    idf = lambda b: math.log((1 + len(learn)) / (1 + df.get(b, 0))) + 1
    data = []
    for lang, c in learn:
        x = vector(c, idf, True)
        at = sorted(x)
        data.append((lang, np.array(at, np.int32).tobytes(), np.array([x[b] for b in at], np.float32).tobytes(), x))
    data.sort(key=lambda d: d[:3])
    langs = sorted({d[0] for d in data})
    order = [(langs.index(d[0]), d[3]) for d in data]
    np.random.default_rng(5).shuffle(order)
    front, back = [e for k, e in enumerate(order) if k % 5 != 4], [e for k, e in enumerate(order) if k % 5 == 4]
    ftrl, bias = [PlainFtrl(1.0, 0.05, 0.01) for _ in langs], [0.0] * len(langs)
    for _ in range(langid.EPOCHS):
        for y, x in front:
            w = [{b: f.weight(b) for b in x} for f in ftrl]
            p = probabilities(w, bias, x)
            for k, f in enumerate(ftrl):
                g = p[k] - (k == y)
                for b, v in x.items():
                    f.update(b, g * v, w[k][b])
                bias[k] -= 0.01 * g
    weights = [{b: float(np.float32(f.weight(b))) for b in f.z} for f in ftrl]
    loss = lambda t: -sum(math.log(max(probabilities(weights, bias, x, t)[y], 1e-12)) for y, x in back) / len(back)
    t = min((math.exp(math.log(0.05) + k * math.log(400) / 2000) for k in range(2001)), key=loss) if len(back) else 1.0
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert len(got) == len(rows)
    for r in rows:
        c = grams(r.text)
        if c is None:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        p = probabilities(weights, bias, vector(c, idf, False), t)
        assert got[r.doc_id].lang_pred == langs[p.index(max(p))] and got[r.doc_id].held_out == held(r.doc_id)
        assert got[r.doc_id].score == pytest.approx(max(p), abs=2e-2)
    model = langid.fit_language_model(docs, ~langid.held_out())
    assert model.bias == pytest.approx(bias, abs=1e-6)
    for k in range(len(langs)):
        assert {b: w for b, w in weights[k].items() if w} == pytest.approx({int(b): float(model.weights[k, b]) for b in np.flatnonzero(model.weights[k])}, abs=1e-5)


# Toxicity ----------------------------------------------------------------------------------------


def features(text):
    words = set(re.findall(r"\w+", (text or "").lower()))
    return words | {w[:k] + "*" for w in words for k in (4, 5) if len(w) >= k}


def plain_swaps(words):
    groups = [g for g in toxicity.IDENTITY_TERMS if set(g) & words]
    out = []
    for k in range(1, max([len(g) for g in groups], default=1)):
        swapped = set()
        for w in words:
            g = next((g for g in reversed(groups) if w in g), None)
            swapped.add(g[(g.index(w) + k) % len(g)] if g else w)
        if swapped != words:
            out.append(swapped)
    return out


def expand(words):
    return words | {w[:k] + "*" for w in words for k in (4, 5) if len(w) >= k}


def plain_train(rows, penalty, seed=3):
    count = {}
    for words, _ in rows:
        for f in expand(words):
            count[f] = count.get(f, 0) + 1
    named = {t for g in toxicity.IDENTITY_TERMS for t in g}
    known = {f for f, n in count.items() if n >= 3} | named
    base = sum(y for _, y in rows) / len(rows)
    bias = math.log((base + 1e-3) / (1 - base + 1e-3))
    f, rng = PlainFtrl(0.3, 1.0, 0.1), np.random.default_rng(seed)
    for _ in range(toxicity.EPOCHS):
        for k in rng.permutation(len(rows)):
            words, y = rows[k]
            mine = expand(words) & known
            w = {i: f.weight(i) for i in mine}
            p = 1 / (1 + math.exp(-max(-40, min(40, sum(w.values()) + bias))))
            for i in mine:
                f.update(i, p - y, w[i])
            bias -= 0.01 * (p - y)
            if others := plain_swaps(words):
                theirs = expand(others[int(rng.integers(len(others)))]) & known
                w = {i: f.weight(i) for i in mine ^ theirs}
                gap = sum(w[i] for i in mine - theirs) - sum(w[i] for i in theirs - mine)
                for i in (mine ^ theirs) if gap else ():
                    f.update(i, 2 * penalty * gap * (1 if i in mine else -1), w[i])
    return {i: f.weight(i) for i in known if f.weight(i)}, bias


def test_toxicity_brute_force(spark):
    """On whole documents some of which name groups, the query's scores are those of the plain loops."""
    from pyspark.sql import functions as F

    rng = random.Random(2)
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    named = [(r.doc_id, (r.text or "") + rng.choice(["", " the women and gay men said", " she met a muslim", " immigrant"])) for r in rows] + [(10**6, None), (10**6 + 1, "")]
    docs = spark.createDataFrame(named, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, y in toxic.items() if y is not None], "doc_id long, toxic int")
    learn = sorted((i, " ".join(sorted(set(re.findall(r"\w+", (t or "").lower())))), toxic[i]) for i, t in named if toxic.get(i) in (0, 1) and not held(i))
    weights, bias = plain_train([(set(w.split()), y) for _, w, y in learn], toxicity.PENALTY)
    got = toxicity.detect_toxicity(docs, labels).withColumn("score", F.round("score", 9)).collect()
    assert len(got) == len(named)
    for r in got:
        text = dict(named)[r.doc_id]
        logit = bias + sum(weights.get(f, 0.0) for f in features(text))
        want = 1 / (1 + math.exp(-max(-40, min(40, logit))))
        assert r.score == pytest.approx(want, abs=1e-6) and r.predicted == int(r.score >= 0.5) and r.held_out == held(r.doc_id)


def test_neutral_mentions_are_no_false_positives(spark):
    """Where labels go with a group's name, the penalty keeps clean held-out documents that name the group clean."""
    rng = random.Random(6)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    learn, clean = [], []
    for r in docs:
        words = toxicity.words(r.text)
        if toxic.get(r.doc_id) not in (0, 1):
            continue
        if held(r.doc_id):
            clean += [words | {"muslim"}] if not toxic[r.doc_id] else []
        else:
            y = int(toxic[r.doc_id] or rng.random() < 0.1)
            learn.append((words | ({"muslim"} if rng.random() < (0.95 if y else 0.02) else {"christian"} if rng.random() < 0.5 else set()), y))
    flagged = {}
    for penalty in (0.0, 2.0):
        model = toxicity.train(learn, penalty=penalty)
        flagged[penalty] = np.mean([model.score(" ".join(w)) >= 0.5 for w in clean])
    assert flagged[2.0] < 0.5 * flagged[0.0]
