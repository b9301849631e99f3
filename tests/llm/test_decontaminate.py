"""Decontamination and its FM-index against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import decontaminate as D
from quillspark.llm.words import LETTERS, LETTERS_DIGITS, find_words, slices, texts_of

DOCS = "doc_id long, text string, spans string, items int, row int, n_words string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, bench, window=10):
    grams = {}
    for i, t in bench:
        w = words_of(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            grams.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, items = words_of(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    items |= grams[tuple(w[k : k + n])]
        starts = [k for k in sorted(hit) if k - 1 not in hit]
        spans = [(k, next(j for j in range(k, len(w) + 1) if j not in hit)) for k in starts]
        out.append((i, len(w), len(hit), tuple(spans), tuple(sorted(items - {None}))))
    return sorted(out, key=str)


def found(spark, docs, bench, **how):
    d = spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in docs], DOCS).repartition(3)
    b = spark.createDataFrame([(i, t, "z") for i, t in bench], "item_id long, text string, words string")
    return D.decontaminate(d, b, **how).collect()


def digest(rows):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple((s.a, s.b) for s in r.spans), tuple(r["items"])) for r in rows), key=str)


def corpus(seed, few=False):
    rng = random.Random(seed)
    words = ["a", "the", "Été", "x1", "42", "naïve", "日本", "Longerword", "longerwordstill", "longerwordstills"] + ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(3 if few else 60)]
    prose = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", ", ", ".\n", "-"]) for _ in range(n))
    bench = [(k, prose(rng.choice([12, 25, 40]))) for k in range(12)]
    bench += [(20, "One two"), (21, None), (22, " ..."), (23, bench[3][1]), (3, bench[3][1]), (None, prose(15)), (24, bench[4][1][:60] + prose(9))]
    docs = [(k, prose(rng.randint(0, 120))) for k in range(40)]
    for k in range(0, 40, 3):
        t = bench[k % 12][1] or ""
        cut = rng.randrange(len(t) // 2 + 1)
        docs[k] = (k, docs[k][1] + t[cut:].upper().replace(" ", "\t") + prose(4))
    docs += [(50, "ONE... two"), (51, "two one"), (52, None), (53, ""), (54, bench[17][1]), (55, (bench[5][1] + " ") * 40), (56, "x" * 5000 + " " + bench[0][1])]
    return docs + [(None, bench[1][1]), (7, bench[2][1]), (7, bench[2][1]), (57, prose(3000))], bench


@pytest.mark.parametrize("seed, few", [(1, False), (2, True)])
def test_against_brute_force(spark, seed, few):
    docs, bench = corpus(seed, few)
    got = found(spark, docs, bench)
    assert digest(got) == brute(docs, bench)
    texts = {i: t for i, t in docs}
    for r in got:
        if r.doc_id is not None and r.doc_id != 7:
            raw = (texts[r.doc_id] or "").encode()
            left = b"".join(raw[a:b] for a, b in zip([0, *(s["to"] for s in r.spans)], [*(s["from"] for s in r.spans), len(raw)]))
            assert (r.kept_text or "").encode() == left
            assert words_of(raw[r.spans[0]["from"] : r.spans[0]["to"]].decode()) == words_of(texts[r.doc_id])[r.spans[0].a : r.spans[0].b] if r.spans else r.kept_text == texts[r.doc_id]


def test_passes_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(D, "PIECE", 6)
    docs, bench = corpus(3)
    assert digest(found(spark, docs, bench, phrase_words=150, window=4)) == brute(docs, bench, 4)


def test_empty(spark):
    docs, bench = corpus(4)
    assert found(spark, [], bench) == []
    assert digest(found(spark, docs, [])) == brute(docs, [])


def test_fm_index():
    rng = np.random.default_rng(3)
    for top, n in ((1, 40), (2, 200), (9, 500), (200, 300)):
        values = rng.integers(0, top + 1, n)
        values[-1] = 0
        index = D.FMIndex(values, top, 5)
        phrases = rng.integers(1, top + 1, (80, 3))
        lengths = rng.integers(1, 4, 80)
        lo, hi = index.search(phrases, lengths)
        for p, k, a, b in zip(phrases, lengths, lo, hi):
            want = [i for i in range(n - k + 1) if (values[i : i + k] == p[:k]).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_false_hashes_are_found_out(monkeypatch):
    """With a hash of the length only, other words pass for those of the items until bytes are compared."""
    monkeypatch.setattr(D, "word_hashes", lambda w: (w.end - w.start).astype(np.uint64))
    known = D.Phrases.of([(1, ["ab", "cde", "f"])], 2)
    words = find_words(*texts_of(pa.array(["ab cde x", "zz cde f", "q"])), LETTERS_DIGITS)
    first, length, _ = D.shard_hits(words, known)
    assert sorted(zip(first.tolist(), length.tolist())) == [(0, 2), (4, 2)]


def test_words():
    texts = ["Ab1cd", None, "", "é ÉX", "end", "word", " 9a"]
    data, bounds = texts_of(pa.array(["skipped", *texts], pa.string()).slice(1))
    for inside, pattern in ((LETTERS, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), (LETTERS_DIGITS, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")):
        w = find_words(data, bounds, inside)
        want = [(k, m) for k, t in enumerate(texts) for m in re.findall(pattern, t or "")]
        lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        assert [(int(r), w.text(k)) for k, r in enumerate(w.row)] == [(k, lower(m)) for k, m in want]
        assert [int(x) for x in w.keys(slice(None))] == [int.from_bytes(lower(m).encode()[:8].ljust(8, b"\0"), "big") for _, m in want]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    assert [b.num_rows for b in slices(batch, 0, 5)] == [3, 1, 1, 1, 1] and sum(b.num_rows for b in slices(batch, 0, 9)) == 7
