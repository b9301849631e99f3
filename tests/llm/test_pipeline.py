"""The pipeline against plain Python, and its stages on odd tables."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
import xxhash

import corpus_pipeline

#: Names that the stages use themselves.
CLASHING = ["score", "lang_pred", "_text", "_keep", "_doc", "_size", "_taken", "_whole", "_rest", "row", "digest", "id", "n", "k", "size", "taken", "sum", "m_id", "node", "cut", "is_whole", "fp", "band", "keep_id"]
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHING)


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, lang, len(t or ""), *range(len(CLASHING))) for i, t, s, lang in rows], SCHEMA).repartition(3)


def corpus(rng):
    en = "the of and to in is you that it he was for on are with as his they at be this have from or one had by word but not".split()
    de = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass".split()
    rows = []
    for i in range(70):
        words = [rng.choice(en if i % 2 else de) + rng.choice(["", "", "", str(rng.randrange(9))]) for _ in range(rng.choice([4, 60, 80]))]
        rows.append((i, " ".join(words), rng.choice(["a", "a", "a", "b", None]), "en" if i % 2 else "de"))
    for i in range(0, 70, 7):  # near copies
        words = rows[i][1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((100 + i, " ".join(words), "b", rows[i][3]))
    rows += [(200 + k, rows[k][1], "c", None) for k in range(0, 20, 4)]  # copies
    rows += [rows[3], rows[3], (300, None, "a", "en"), (301, "", "a", "en"), (302, "12 34 !", "b", None), (303, " \n lead  and tail \t", "b", "en")]
    rows += [(None, "a row without an id", "a", "en"), (None, "and another one of those", "a", "en"), (304, "long text " + "word7 " * 40_000, "a", "en")]
    rows += [(305, "one id with", "b", "en"), (305, "two texts here", "b", "en"), (306, "nothing else to say", None, None)]
    return rows


def group(ids, linked):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(ids), 2):
        if linked(a, b):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in ids}


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or ""))


def lower(t):
    return [w.encode().lower() for w in words_of(t)]


def shingles(t, k):
    w = lower(t)
    return [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def fingerprint(t):
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles(t, 4)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def kept_after_dedup(rows):
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    best = {}
    for r in rows:
        if r[1] not in best or (best[r[1]][0] is None or r[0] is not None and r[0] > best[r[1]][0]):
            best[r[1]] = r
    rows = list(best.values())
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(r[1])
    ids = [i for i in texts if i is not None]
    fps = {i: [fingerprint(t) for t in texts[i]] for i in ids}
    sets = {i: [set(shingles(t, 5)) for t in texts[i]] for i in ids}

    def linked(a, b):
        close = any(bin(x ^ y).count("1") <= 4 for x in fps[a] for y in fps[b])
        return close or any(len(x & y) >= 0.8 * len(x | y) for x in sets[a] for y in sets[b])

    root = group(ids, linked)
    return [r for r in rows if r[0] is None or root[r[0]] == r[0]]


def mixed(rows):
    """Texts of the mix: ``(doc_id, text)``."""
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(len(words_of(r[1])) for r in rows if r[2] == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    total, capped = 1.5 * sum(size.values()), set()
    while True:
        rest, w = total - sum(2 * size[s] for s in capped), sum(weight[s] for s in sources if s not in capped)
        over = {s for s in sources if s not in capped and rest * weight[s] / w > 2 * size[s]}
        if not over:
            break
        capped |= over
    out = []
    for s in sources:
        target = 2 * size[s] if s in capped else rest * weight[s] / w
        whole = int(target // size[s])
        left = round(target) - whole * size[s]
        mine = [r for r in rows if r[2] == s]
        key = lambda r: (hashlib.md5(f"17:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), len(words_of(r[1])))
        for r in sorted(mine, key=key):
            n = len(words_of(r[1]))
            extra = min(n, max(0, left))
            left -= n
            out += [(r[0], r[1])] * (whole + (extra == n))
            if 0 < extra < n:
                ends = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", r[1])]
                out.append((r[0], r[1][: ends[extra - 1]]))
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus(random.Random(8))


def test_run(spark, rows, tmp_path):
    """Every stage's decisions, on a table of odd rows, as plain Python makes them."""
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = kept_after_dedup(rows)
    assert {304, 305, 306, None} <= {r[0] for r in kept} and len(kept) < len(rows) - 12
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t in mixed(kept):
        ids = library.encode_ordinary(t)
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_stages_keep_columns(spark, rows):
    """Columns and their values pass every stage, whatever their names; an empty table stays empty."""
    docs = table(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert all([getattr(r, c) if c not in ("count", "index") else r[c] for c in CLASHING] == list(range(len(CLASHING))) for r in out.collect()), name
        assert stage(spark, docs.limit(0), "").count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == len(rows)


def test_language_stage_without_labels(spark, rows):
    """With no language to learn from, documents with letters stay."""
    docs = table(spark, [(i, t, s, None) for i, t, s, _ in rows])
    kept = corpus_pipeline.language_id(spark, docs, "").collect()
    assert len(kept) == sum(any(c.isalpha() for c in t or "") for _, t, _, _ in rows)


def test_mixing_repeated_rows(spark):
    """Each of several equal rows has its own part: the words put out are the words taken."""
    from quillspark.llm import mixing

    rows = [(1, "a b c d", "s", None)] * 2 + [(2, "e f g", "s", None)] * 2 + [(3, "h", "s", None)] + [(None, "x y", "s", None), (None, "z w", "s", None), (None, "v", "t", None)] * 3
    docs = table(spark, rows)
    taken = sum(r.taken for r in mixing.mix_sources(docs).collect())
    assert sum(len(r.text.split()) for r in mixing.repeat_documents(docs).collect()) == taken == round(1.5 * 30)
