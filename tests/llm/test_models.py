"""Encoding, classifiers, mixing and search against libraries, brute force and held-out accuracy."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import bpe, langid, mixing, topk, toxicity

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "  ", "   a", "a   b", "a \n b", "\n\n x", "x\t \ty", "it's we'LL  ", "é" * 300, "a" * 1000, "ab" * 700, "<|endoftext|>", "   x", "1234 5678", "日本語 テキスト", "\x1c \x85", "a\n ", "x  \n"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aAeé' \n\t\x1c  .1日!s", "the ", " of", "'ll"]), max_size=40).map("".join), min_size=1, max_size=8))
def test_bpe_any_text(library, texts):
    with bpe.contractor(PATH, public_tokenizers.PATTERN) as engine:
        for t, (ids, raw) in zip(texts, engine.encode(texts)):
            assert ids == ",".join(map(str, library.encode_ordinary(t))) and raw == t.encode()


def test_bpe_table(spark, library):
    rows = list(enumerate([*ODD, None])) + [(None, "no id")]
    rows += [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()]
    rows += [(50, "again"), (50, "again"), (50, "other")]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows if i != 50], "doc_id long, text string, n_tokens int").repartition(2)
    got = {r.doc_id: r for r in bpe.encode_documents(df, PATH, public_tokenizers.PATTERN).collect()}
    repeated = bpe.encode_documents(spark.createDataFrame([r for r in rows if r[0] == 50], "doc_id long, text string"), PATH, public_tokenizers.PATTERN)
    assert sorted(r.n_tokens for r in repeated.collect()) == sorted(len(library.encode_ordinary(t)) for i, t in rows if i == 50)
    for i, t in [r for r in rows if r[0] != 50]:
        ids = library.encode_ordinary(t or "")
        sha = lambda x: hashlib.sha256(x).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256, got[i].exact) == (len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode()), True)
    assert bpe.encode_documents(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_bpe_memory_turns_over(library):
    engine = bpe.Contractor(PATH, public_tokenizers.PATTERN, 5 * bpe.ENTRY_BYTES).__enter__()
    for t in ["one twoo three fourr five sixx seven", "five sixx eightt nine", "one twoo ten"] * 2:
        assert list(engine.encode([t]))[0][0] == ",".join(map(str, library.encode_ordinary(t)))
        assert engine.bytes <= engine.most and engine.ids.keys() == engine.raw.keys() == engine.used.keys()


def test_bpe_remembers_frequent_words(library):
    """Words of many slices stay when one slice fills the memory with words of its own."""
    engine = bpe.Contractor(PATH, public_tokenizers.PATTERN, 40 * bpe.ENTRY_BYTES).__enter__()
    common = "fourr sixx eightt"
    for k in range(4):
        own = " ".join(f"zq{chr(97 + k)}{chr(97 + j)}q" for j in range(20))
        for t in (common, own):
            assert list(engine.encode([t])) == [(",".join(map(str, library.encode_ordinary(t))), t.encode())]
    assert {"fourr", " sixx", " eightt"} <= engine.ids.keys()


def test_bpe_long_texts_and_many_queries(library, monkeypatch):
    """A text over a slice goes by sections, words of a slice by several queries."""
    monkeypatch.setattr(bpe, "SLICE_CHARS", 300)
    monkeypatch.setattr(bpe, "SECTION_WORDS", 7)
    monkeypatch.setattr(bpe, "QUERY_ROWS", 100)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéß日 \n") for _ in range(rng.randint(1, 14)))
    texts = [" ".join(word() for _ in range(rng.choice([2, 10, 90]))) for _ in range(25)] + ["x" * 1200, "", " " * 700]
    engine = bpe.Contractor(PATH, public_tokenizers.PATTERN, 40 * bpe.ENTRY_BYTES).__enter__()
    assert list(engine.encode_all(texts)) == [(",".join(map(str, library.encode_ordinary(t))), t.encode()) for t in texts]
    assert any(len(t) > 300 for t in texts)


def test_bpe_vocabulary_is_checked(tmp_path):
    line = lambda token, rank: base64.b64encode(token) + f" {rank}\n".encode()
    whole = [line(bytes([b]), b) for b in range(256)]
    for lines in (whole[1:], [*whole, line(b"ab", 65_536)]):
        (tmp_path / "v").write_bytes(b"".join(lines))
        with pytest.raises(ValueError):
            bpe.Contractor(str(tmp_path / "v"), public_tokenizers.PATTERN)


def test_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_language_odd(spark):
    rows = [(i, t, lang, 1) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 30)]
    rows += [(900, None, "en", 1), (901, "", "en", 1), (902, "123 !! \U0001f600", None, 1), (None, "the dog", "en", 1), (903, "the " * 50_000, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df).collect()}
    assert got[900] == got[901] == got[902] == ("und", 0.0) and got[903][0] == "en" and got[1][0] == "de"
    assert langid.identify(df.limit(0)).count() == 0
    no_labels = langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in no_labels} == {"und"}


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.detect_toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()
    hit = [r.predicted for r in got if r.toxic]
    false = [r.predicted for r in got if not r.toxic]
    print(len(hit), np.mean(hit), np.mean(false))
    assert np.mean(false) < 0.01 and np.mean(hit) > 0.55


def test_counterfactual_penalty():
    """Groups named more often in toxic rows: the penalty takes that weight off the name."""
    rng = random.Random(0)
    fill = [f"w{k}" for k in range(40)]
    rows = []
    for _ in range(600):
        y = rng.random() < 0.5
        group = "women" if rng.random() < (0.9 if y else 0.2) else "men"
        rows.append(({*rng.sample(fill, 6), group, *(["vile"] if y and rng.random() < 0.8 else [])}, int(y)))
    gap = lambda m: abs(m.weights.get("women", 0) - m.weights.get("men", 0))
    free, fair = toxicity.train(rows, penalty=0.0), toxicity.train(rows, penalty=2.0)
    assert gap(fair) < 0.3 * gap(free)
    assert free.score("w1 w2 women") > fair.score("w1 w2 women") and fair.score("vile w1") > 0.5


def test_toxicity_word_forms():
    """A form never seen in training counts by its beginning."""
    rng = random.Random(1)
    fill = [f"w{k}" for k in range(40)]
    rows = [({*rng.sample(fill, 6), *([f"grumble{k}"] if k % 2 else [])}, k % 2) for k in range(400)]
    model = toxicity.train(rows)
    assert model.score("w1 w2 grumblesome") > 0.5 > model.score("w1 w2 grand")


def test_toxicity_odd(spark):
    docs = spark.createDataFrame([(1, None, 2), (2, "", 2), (None, "awful", 2), (3, "x " * 200_000, 2)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    got = toxicity.detect_toxicity(docs, labels).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
    assert toxicity.detect_toxicity(docs.limit(0), labels.limit(0)).count() == 0


def test_toxicity_seed_is_stable():
    rows = [({"a", "b"}, 1), ({"a", "c"}, 0)] * 20
    assert toxicity.train(rows).weights == toxicity.train(rows).weights


def brute_fill(sizes, weights, share, cap):
    clamped, total = set(), share * sum(sizes)
    while True:
        rest = total - sum(cap * sizes[i] for i in clamped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in clamped)
        over = {i for i in range(len(sizes)) if i not in clamped and rest * weights[i] / w > cap * sizes[i]}
        if not over:
            return [cap * s if i in clamped else rest * weights[i] / w for i, s in enumerate(sizes)]
        clamped |= over


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "B", "é", "z", None, "c"]), " ".join("w" for _ in range(int(rng.paretovariate(0.8))))) for i in range(300)]
    rows += [(900, "only empty", ""), (901, "only null", None), (902, "a", None)]
    df = spark.createDataFrame([(i, t, s, 1) for i, s, t in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix_sources(df).collect()
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    size = lambda t: len((t or "").split())
    sizes = [sum(size(t) for _, x, t in rows if x == s) for s in sources]
    want = brute_fill(sizes, [(3, 1, 2)[k % 3] for k in range(len(sources))], 1.5, 2)
    for s, n, target in zip(sources, sizes, want):
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - target) < 1e-6 and r.source_size == n for r in mine)
        assert abs(sum(r.taken for r in mine) - target) <= 1 and all(0 <= r.taken <= 2 * r.size for r in mine)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(df.repartition(5)).collect()))
    mixed = mixing.repeat_documents(df)
    assert mixed.columns == df.columns
    words = {}
    for r in mixed.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + size(r.text)
    assert words == {r.doc_id: r.taken for r in got if r.taken}


def test_mixing_odd(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(df).count() == 0 and mixing.repeat_documents(df).count() == 0
    same = spark.createDataFrame([(1, "a b", "s")] * 3 + [(None, " a  b c ", "s")], "doc_id long, text string, source string")
    assert sum(r.taken for r in mixing.mix_sources(same).collect()) == round(1.5 * 9)


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 40))
    vectors[50:120] = vectors[0]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    rows += [(500, None, 1), (None, vectors[1].tolist(), 1), (501, [1.0], 1), (0, vectors[0].tolist(), 1)]
    vectors[399, :3] = -1
    rows[399] = (399, [None, None, None, *vectors[399, 3:].tolist()], 1)  # null components have the bit 0
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), 40, k=5, bits=8).collect()
    codes = vectors > 0
    for q in range(0, 400, 50):
        d = sorted((int((codes[q] != codes[i]).sum()), i) for i in range(400) if i != q)[:5]
        assert sorted((r.rank, r.distance, r.vec_id) for r in got if r.query_id == q) == [(k + 1, *x) for k, x in enumerate(d)]
    assert topk.top_k(df.limit(0), df, 40).count() == 0
    few = topk.top_k(df.where("vec_id < 3"), df.where("vec_id = 1"), 40, k=5, bits=8).collect()
    assert [r.rank for r in sorted(few, key=lambda r: r.rank)] == [1, 2]


def test_models_with_repeated_ids_and_ties(spark):
    """Rows that repeat an id add nothing to the sample, equal texts have equal results, and reruns agree."""
    rows = [(i, f"the cat w{i % 7} and", "en", i % 2) for i in range(40)] + [(i, f"der hund w{i % 7} und", "de", i % 2) for i in range(40, 80)]
    more = rows + [rows[0]] * 5 + [rows[50]] * 3 + [(None, "the cat", "en", 0)]
    schema = "doc_id long, text string, lang string, lang_pred int"
    plain, again = (spark.createDataFrame(r, schema).repartition(3) for r in (rows, more))
    for make in (lambda d: langid.identify(d), lambda d: toxicity.detect_toxicity(d, spark.createDataFrame([(i, y) for i, _, _, y in rows] * 2, "doc_id long, toxic int"))):
        once, twice = ({(r.doc_id, *[str(x) for x in r][2:]) for r in make(d).collect() if r.doc_id is not None} for d in (plain, again))
        assert once == twice and len(once) == len(rows)
        assert make(again).count() == len(more)


def test_water_filling_of_several_rounds(spark):
    """Caps that are reached one after another, as others leave more to deal."""
    sizes = [int(100 * 1.05**k) + 1 for k in range(30)]
    weights = [(3, 1, 2)[k % 3] for k in range(30)]
    total, clamped, rounds = 1.99 * sum(sizes), set(), 0
    while True:
        rest = total - sum(2.0 * sizes[k] for k in clamped)
        level = rest / sum(w for k, w in enumerate(weights) if k not in clamped)
        more = {k for k in range(30) if k not in clamped and level * weights[k] > 2 * sizes[k]}
        if not more:
            break
        clamped, rounds = clamped | more, rounds + 1
    assert rounds == 5
    df = spark.createDataFrame([(f"s{k}", s, w) for k, (s, w) in enumerate(zip(sizes, weights))], "source string, source_size long, weight long")
    got = {r.source: r.target for r in mixing.water_fill(df, 1.99, 2.0).collect()}
    assert got == pytest.approx({f"s{k}": 2.0 * sizes[k] if k in clamped else level * weights[k] for k in range(30)})
