"""The audit of sources and its pointer sort against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa

from quillspark.llm import divergence as D
from quillspark.llm.words import LETTERS, find_words, texts_of

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, p string, shard int"
WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, documents, terms):
    held, counts, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        w = words_of(text)
        held.update((lang, t) for t in set(w))
        counts.update((lang, source, t) for t in w)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), k in held.items() if x == lang and k >= documents)
        sources = sorted(s for x, s in groups if x == lang)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        own = {s: {t: counts[lang, s, t] for t in kept} for s in sources}
        p, q = {s: share(c) for s, c in own.items()}, share({t: sum(own[s][t] for s in sources) for t in kept})
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            over = [(q[t] - p[s][t], t.encode()) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            out += [(lang, s, "pair", i.decode(), -v, r) for r, (v, i) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", i.decode(), -v, r) for r, (v, i) in enumerate(sorted(over)[:terms], 1)]
    return sorted(out)


def audited(spark, rows, documents, terms):
    df = spark.createDataFrame([(k, *r, "x", 1, "y", 2) for k, r in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in D.source_divergence(df, documents, terms).collect())


def corpus(seed):
    rng = random.Random(seed)
    words = ["a", "the", "Été", "naïve", "日本", "verylongwordindeed", "verylongwordindeedlonger", "verylong", "verylonx", "zz" * 40]
    words += ["".join(rng.choice("abcé𝒳") for _ in range(rng.randint(1, 12))) for _ in range(60)]
    prose = lambda n: "".join(rng.choice(words[: rng.choice([5, 30, 70])]) + rng.choice([" ", "1", ", ", ".\n", "-"]) for _ in range(n))
    rows = [(prose(rng.choice([0, 3, 40, 90])), rng.choice(["en", "de"]), rng.choice(["s1", "s2", "S3", "é4"])) for _ in range(90)]
    rows += [("The the THE", "fr", "s1"), ("...", "fr", "s2"), (None, "en", "none"), ("the", None, None), (None, None, "s1"), ("a the", "en", None), ("", "xx", "only")]
    return rows + [rows[3]] * 5 + [(prose(4000), "en", "s1")]


def test_against_brute_force(spark, monkeypatch):
    rows = corpus(1)
    want = brute(rows, 6, 7)
    assert {r[0] for r in want} == {"en", "de", "fr", ""} and len(want) > 60
    assert audited(spark, rows, 6, 7) == want
    monkeypatch.setattr(D, "CELLS", 40)  # many shards
    assert audited(spark, rows, 6, 7) == want


def test_few(spark):
    assert audited(spark, [], 1, 5) == []
    assert audited(spark, [("a b", "en", "s")], 30, 5) == []
    assert audited(spark, [("a b", "en", "s"), ("a c", "en", "t")], 30, 5) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]
    assert audited(spark, [("a b", "en", "s"), ("a c", "en", "t")], 1, 5) == brute([("a b", "en", "s"), ("a c", "en", "t")], 1, 5)


def test_pointer_sort():
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abé") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 30]))) for _ in range(n)) for n in (0, 1, 500, 40)]
    for t in (texts, ["x y " * 300, "y"], ["same"] * 50, []):
        words = find_words(*texts_of(pa.array(t, pa.string())), LETTERS)
        order, head = D.multikey_quicksort(words)
        got = [words.text(k) for k in order]
        assert got == sorted((words.text(k) for k in range(len(order))), key=str.encode)
        assert [bool(h) for h in head] == [k == 0 or got[k] != got[k - 1] for k in range(len(got))]
        assert all(a < b for a, b, h in zip(order, order[1:], head[1:]) if not h)
