"""The dedup operators against brute force, on small tables with every odd case."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
import xxhash

from quillspark.llm import exact_dedup, line_dedup, sentence_dedup, simhash, suffix_dedup
from quillspark.operators.graph import components

REPO = str(Path(__file__).resolve().parents[2])
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, size long, fp long"


def table(spark, rows):
    """Rows ``(doc_id, text)`` with extra columns, some of whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, "s", None, "x", 7, 1) for i, t in rows], SCHEMA).repartition(3)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    prose = lambda k: " ".join(rng.choice(words) + rng.choice(["", "", "", "", ".", ",", ".\n"]) for _ in range(k))
    docs = [prose(rng.randint(1, 300)) for _ in range(n)]
    passage = prose(70)
    for i in range(5, n, 4):
        cut = rng.randrange(len(docs[i]) + 1)
        docs[i] = docs[i][:cut] + ". " + passage + ". " + docs[i][cut:]
    for i in range(3, n, 7):  # near copies
        base = docs[i - 1].split(" ")
        base[rng.randrange(len(base))] = "changed"
        docs[i] = " ".join(base)
    docs[10] = docs[11] = docs[12]
    docs += [None, "", " ", "a", "\n\n\n\n", "\n" * 130, "ab" * 200, "ab" * 300, prose(4000)]
    return list(enumerate(docs))


def test_exact(spark):
    rows = [*corpus(), (None, "a"), (100, "a"), (100, "a")]
    got = exact_dedup.DigestIndex(spark).add(table(spark, rows)).collect()
    texts = {}
    for i, t in rows:
        texts.setdefault(t or "", []).append(i)
    want = []
    for t, ids in texts.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.digest) for r in got), key=key) == sorted(want, key=key)


def test_exact_index_persists(spark):
    index = exact_dedup.DigestIndex(spark, "persisting", 3)
    assert index.add(table(spark, [])).count() == 0
    index.add(table(spark, [(1, "a"), (2, "b")])).collect()
    again = exact_dedup.DigestIndex(spark, "persisting")
    rows = {r.doc_id: (r.keep_id, r.kept) for r in again.add(table(spark, [(3, "a"), (4, "c"), (5, "c")])).collect()}
    assert rows == {3: (1, False), 4: (5, False), 5: (5, True)}
    assert again.entries().count() == 3
    assert again.buckets == 3


DELIVER = """
import sys
from pyspark.sql import SparkSession
from quillspark.llm.exact_dedup import DigestIndex
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.warehouse.dir", sys.argv[2]).getOrCreate()
index = DigestIndex(spark, "of_sessions", 3, sys.argv[1])
rows = spark.createDataFrame([(int(k), t) for k, t in (x.split("=") for x in sys.argv[3:])], "doc_id long, text string")
print(index.buckets, sorted((r.doc_id, r.keep_id, r.kept) for r in index.add(rows).collect()), index.entries().count())
"""


def test_exact_index_outlives_its_session(spark, tmp_path):
    """Two processes with one index: neither shares a catalog or a warehouse with the other, or with this one."""

    def deliver(number, *rows):
        cmd = [sys.executable, "-c", DELIVER, f"file://{tmp_path}/indexes", f"{tmp_path}/warehouse-{number}", *rows]
        return subprocess.run(cmd, capture_output=True, text=True, check=True, timeout=300, cwd=REPO, env=os.environ | {"PYTHONPATH": REPO}).stdout.strip()

    assert deliver(1, "1=a", "2=b", "3=b") == "3 [(1, 1, True), (2, 3, False), (3, 3, True)] 2"
    assert deliver(2, "4=a", "5=c") == "3 [(4, 1, False), (5, 5, True)] 3"
    index = exact_dedup.DigestIndex(spark, "of_sessions", folder=f"file://{tmp_path}/indexes")
    index.compact()
    plan = index.split(spark.createDataFrame([("x", 1, 1)], "digest string, keep_id long, group_size long"))[1]._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and index.entries().count() == 3
    # A compaction that was cut off before its last step is taken up again.
    index.spark.sql("drop table of_sessions")
    os.rename(f"{tmp_path}/indexes/of_sessions.buckets-3", f"{tmp_path}/indexes/of_sessions.compacted-3")
    again = exact_dedup.DigestIndex(spark, "of_sessions", folder=f"file://{tmp_path}/indexes")
    assert {r.keep_id for r in again.entries().collect()} == {1, 3, 5}
    again.drop()
    assert not any((tmp_path / "indexes").iterdir())


def test_exact_index_is_not_shuffled(spark):
    """A delivery meets the index by its buckets: only the delivery is dealt out, and the result does not read the index."""
    index = exact_dedup.DigestIndex(spark, "by_buckets", 3)
    index.add(table(spark, [(k, f"text {k}") for k in range(50)]))
    out = index.add(table(spark, [(100 + k, f"text {k}") for k in range(40, 60)]))
    groups = index.entries().select("digest", "keep_id", "group_size").limit(5)
    for side in index.split(groups):
        plan = side._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    index.compact()
    assert index.entries().count() == 60 and len(index.entries().inputFiles()) <= 3 and index.buckets == 3
    again = exact_dedup.DigestIndex(spark, "by_buckets")
    assert {r.keep_id for r in again.add(table(spark, [(900, "text 45")])).collect()} == {45}
    again.drop()
    assert {r.doc_id: (r.keep_id, r.kept) for r in out.collect()} == {100 + k: (k, False) if k < 50 else (100 + k, True) for k in range(40, 60)}


def test_keep_one(spark):
    kept = exact_dedup.keep_one(table(spark, [(1, "a"), (2, "a"), (3, None), (4, "")])).collect()
    assert sorted(r.doc_id for r in kept) == [2, 4] and len(kept[0]) == 8
    rows = [(5, "b"), (5, "b"), (5, "c"), (7, "c"), (None, "c"), (None, "d"), (None, "d")]
    kept = exact_dedup.keep_one(table(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("5", "b"), ("7", "c"), ("None", "d")]


def windows_brute(rows, cut, runs, join):
    """Units that runs covered by an earlier equal run; ``runs`` gives (start, n, key)."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        parts = cut(t or "")
        gone = set()
        for start, n, key in runs(parts):
            if key in seen:
                gone |= set(range(start, start + n))
            seen.add(key)
        out[i] = (len(parts), len(gone), join.join(p for k, p in enumerate(parts) if k not in gone))
    return out


def test_lines(spark):
    rng = random.Random(2)
    lines = [f"line {k}" for k in range(30)]
    rows = [(i, "\n".join(rng.choice(lines) if rng.random() < 0.3 else lines[(i + k) % 30] for k in range(rng.randint(1, 25)))) for i in range(60)]
    rows += corpus(3) and [(100 + i, t) for i, t in corpus(3)] + [(900, "x\n" * 500), (901, "x\nx\nx")]
    want = windows_brute(rows, lambda t: t.split("\n"), lambda p: ((k, 3, tuple(p[k : k + 3])) for k in range(len(p) - 2)), "\n")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.dedup_lines(table(spark, rows)).collect()}
    assert got == want and any(v[1] for v in want.values())


def test_lines_odd(spark):
    got = line_dedup.dedup_lines(table(spark, [(None, "a\nb\nc"), (1, "a\nb\nc"), (2, None)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed, r.kept_text) for r in got) == [(0, 0, "a\nb\nc"), (1, 0, "a\nb\nc"), (2, 0, "")]
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


def test_sentences(spark):
    rows = corpus(4)

    def runs(parts):
        trimmed = [p.strip() for p in parts]
        for a in range(len(parts)):
            for n in range(2, len(parts) - a + 1):
                if sum(len(p.split()) for p in trimmed[a : a + n]) >= 12:
                    yield a, n, " ".join(trimmed[a : a + n])
                    break

    want = windows_brute(rows, sentence_dedup.sentences, runs, "")
    got = {r.doc_id: (r.n_sentences, r.n_removed, r.kept_text) for r in sentence_dedup.dedup_sentences(table(spark, rows)).collect()}
    assert got == want and any(v[1] for v in want.values())
    assert all("".join(sentence_dedup.sentences(t or "")) == (t or "") for _, t in rows)
    assert sentence_dedup.dedup_sentences(table(spark, [])).count() == 0
    odd = sentence_dedup.dedup_sentences(table(spark, [(None, rows[20][1]), (1, rows[20][1]), (1, rows[20][1])])).collect()
    assert all(r.n_removed == 0 for r in odd)


def test_sentence_runs(spark):
    """Every sentence of a repeated run of any number of sentences over one, and copies of texts of one."""
    long, last = " ".join(f"w{k}" for k in range(20)) + ".", " Three words here. And four of them."
    rows = [r for r in corpus(11) if len(r[1] or "") < 4000]
    rows += [(900, long + last), (901, f"Else. {long}{last}"), (902, "Yes. No. Not the same"), (903, "Or so. Yes. No."), (904, "one sentence"), (905, "one sentence"), (906, "A. one sentence")]
    rows += [(907, "\n\n" + long), (908, "\n\n" + long + " Other."), (909, long), (910, "\n\nYes. No. And no end"), (911, "x y"), (912, "x\ny")]
    seen, want = set(), {}
    for i, t in rows:
        parts = sentence_dedup.sentences(t or "")
        gone, real = set(), [k for k, p in enumerate(parts) if p.strip()]
        spans = [(a, b) for a in range(len(real)) for b in range(a + 2, len(real) + 1)]
        if len(real) < 2:
            spans = [(0, len(real))] if parts else []
        for a, b in spans:
            key = (len(real) < 2, *(parts[k].strip() for k in real[a:b]))
            if key in seen:
                gone |= set(range(real[a] if a else 0, real[b - 1] + 1 if real else len(parts)))
            seen.add(key)
        want[i] = (len(parts), len(gone), "".join(p for k, p in enumerate(parts) if k not in gone))
    got = {r.doc_id: (r.n_sentences, r.n_removed, r.kept_text) for r in sentence_dedup.dedup_runs(table(spark, rows)).collect()}
    assert got == want
    assert sentence_dedup.dedup_runs(table(spark, [])).count() == 0
    assert [got[i][2] for i in (11, 12, 901, 903, 905, 906, 908, 909)] == ["", "", "Else. ", "Or so. ", "", "A. one sentence", "\n\n" + long + " Other.", ""]


def suffix_brute(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 2, dtype=bool)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p + 1 : p + 101] = True
            seen.add(raw[p : p + 100])
        kept = bytes(b for b, g in zip(raw, gone[1:]) if not g)
        out.append((i, len(raw), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed,max_group", [(5, 20_000), (6, 2), (7, 20_000)])
def test_suffixes(spark, monkeypatch, seed, max_group):
    if seed == 7:
        monkeypatch.setattr(suffix_dedup, "MAX_GROUP", 3)
    rows = corpus(seed)
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in suffix_dedup.dedup_substrings(table(spark, rows), max_group).collect()]
    assert sorted(got) == suffix_brute(rows)


def test_suffixes_odd(spark):
    text = corpus(8)[20][1] * 3
    got = suffix_dedup.dedup_substrings(table(spark, [(None, text), (4, text), (4, text)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got)[0] == (0, 0)
    once = suffix_dedup.dedup_substrings(table(spark, [(4, text)])).first()
    assert [(r.n_removed, r.spans, r.kept_sha256) for r in got if r.doc_id] == [(once.n_removed, once.spans, once.kept_sha256)] * 2 and once.n_removed
    # Repeated rows, contested k-mers among them, give what single rows give; another text under the id stays whole.
    rows = corpus(8)
    want = suffix_brute(rows)
    for more in (rows[::3], [(i, "a smaller text") for i, t in rows[1:20:4] if (t or "") > "a smaller text"]):
        got = suffix_dedup.dedup_substrings(table(spark, rows + more)).collect()
        found = {(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got}
        assert set(want) <= found and len(got) == len(rows) + len(more)
        assert {(i, n) for i, _, n, _, _ in found - set(want)} == {(i, 0) for i, _ in more if (i, _) not in rows}
    assert suffix_dedup.dedup_substrings(table(spark, [])).count() == 0


def test_suffix_collisions(monkeypatch):
    """With a hash that tells nothing apart, verification still gives the right answer."""
    rng = np.random.default_rng(0)
    mat = rng.integers(97, 99, (12, suffix_dedup._WIDTH)).astype(np.uint8)
    mat[6:] = mat[:6]
    mat[7, 10] = 120
    group, rank = np.zeros(12, dtype=int), np.arange(12)
    full = (np.zeros(12, dtype=int), np.full(12, 68))
    good = suffix_dedup.covered_offsets(mat, group, rank, *full)
    values, up, down = suffix_dedup._tables()
    monkeypatch.setattr(suffix_dedup, "_tables", lambda *_: (np.zeros_like(values), up, down))
    assert (suffix_dedup.covered_offsets(mat, group, rank, *full) == good).all() and good.any()
    want = np.array([[any((mat[i, 68 - o : 168 - o] == mat[j, 68 - o : 168 - o]).all() for j in range(i)) for o in range(69)] for i in range(12)])
    assert (good == want).all()


def test_long_text_pieces(monkeypatch):
    """A text cut into pieces has the windows of the whole."""
    raw = np.random.default_rng(1).integers(97, 101, 5000).astype(np.uint8)
    whole = suffix_dedup.blob_anchors(raw, np.array([5000]), np.array([5000]))
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    covered = set()
    for run in suffix_dedup._pieces([1], [raw.tobytes().decode()]):
        for _, at, piece, starts in run:
            _, pos, lo, hi, *_ = suffix_dedup.blob_anchors(np.frombuffer(piece, np.uint8), np.array([len(piece)]), np.array([starts]))
            covered |= {(p + at, m + at) for m, a, b in zip(pos, lo, hi) for p in range(a, b + 1)}
    assert covered == {(p, m) for m, a, b in zip(whole[1], whole[2], whole[3]) for p in range(a, b + 1)}


def fp_brute(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def group_brute(points, radius):
    parent = list(range(len(points)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(points)), 2):
        if bin(points[i] ^ points[j]).count("1") <= radius:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [root(i) for i in range(len(points))]


def test_simhash(spark):
    rows = [r for r in corpus(9)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(table(spark, rows)).collect()}
    fps = [fp_brute(t) for _, t in rows]
    assert got == {i: (f"{fp:016x}", g) for (i, _), fp, g in zip(rows, fps, group_brute(fps, 4))}
    assert simhash.near_duplicates(table(spark, [])).count() == 0
    odd = simhash.near_duplicates(table(spark, [(None, "q w e"), (None, None), (7, "q w e"), (7, "q w e")])).collect()
    assert sorted((str(r.component_id), r.group_size) for r in odd) == [("7", 3), ("7", 3), ("7", 3), ("None", 1)]


@pytest.mark.parametrize("shard,chunk", [(20, 10_000), (40, 60), (5000, 5000)])
def test_links(spark, shard, chunk):
    rng = np.random.default_rng(shard)
    base = rng.integers(0, 2**64, 500, dtype=np.uint64)
    near = base[:250].copy()
    for _ in range(5):
        near ^= np.uint64(1) << rng.integers(0, 64, 250, dtype=np.uint64)
    dense = base[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    points = np.unique(np.concatenate([base, near, dense]))
    df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long").repartition(3)
    links = simhash.near_links(df, 4, shard, chunk)
    label = {r.node: r.component for r in components(links, "a", "b").collect()}
    want = group_brute([int(p) for p in points], 4)
    signed = [int(x) for x in points.view(np.int64)]
    sets = lambda names: sorted(sorted(g) for g in {n: [s for s, m in zip(signed, names) if m == n] for n in names}.values())
    assert sets([label.get(s, s) for s in signed]) == sets([("g", w) for w in want])


def test_keep_one_per_group(spark):
    kept = simhash.keep_one_per_group(table(spark, [(1, "a b c d e"), (2, "a b c d e"), (3, "z y x w v"), (None, "a b c d e")])).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 3]


def test_keep_one_similar(spark):
    """Near copies by shared words go, which fingerprints alone keep; the pipeline's stage does the same."""
    import corpus_pipeline

    rng = random.Random(12)
    rows = []
    for base in range(0, 400, 10):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 60, 120]))]
        rows.append((base, " ".join(words)))
        for k in range(1, 4):
            copy = list(words)
            for _ in range(rng.choice([1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((base + k, " ".join(copy)))
    rows += [(1000, "a b"), (1001, "A  b"), (1002, "c"), (1003, None), (None, rows[0][1])]
    held = [(i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set(), fp_brute(t)) for i, t in rows if i is not None for w in [(t or "").lower().split()]]
    parent = {i: i for i, *_ in held}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    shared = fingers = 0
    for (i, g, f), (j, h, e) in itertools.combinations(held, 2):
        similar, close = bool(g | h) and len(g & h) >= 0.8 * len(g | h), bin(f ^ e).count("1") <= 4
        shared += similar
        fingers += similar and close
        if similar or close:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    assert shared > fingers
    got = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, table(spark, rows), "").collect()]
    assert sorted(x for x in got if x is not None) == [i for i in parent if root(i) == i] and got.count(None) == 1


def test_parity_bounds_differences():
    rng = np.random.default_rng(3)
    for n in (1, 15, 17, 150, 900, 6000):
        h = np.unique(rng.integers(0, 2**64, n + n // 4, dtype=np.uint64))
        x, y = (h[np.sort(rng.permutation(len(h))[:n])] for _ in range(2))
        p, q = (simhash.parity(v).view(np.uint64) for v in (x, y))
        assert len(p) == len(q) <= simhash.PARITY_WORDS and np.bitwise_count(p ^ q).sum() <= len(np.setxor1d(x, y))


def test_similar_links_of_a_large_group(spark, monkeypatch):
    """Of a group around one text, few pairs but links are compared, and none within a component; no link of a bucket is lost."""
    rng = random.Random(8)
    base, rows = [f"w{k}" for k in range(110)], []
    for i in range(260):
        words = list(base)
        for _ in range(rng.randrange(1, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    made, plain = [], simhash.materialise_at

    def counted(df, name, rows=None):
        out = plain(df, name, rows)
        if name == "pairs":
            made.append(out[0].count())
        return out

    monkeypatch.setattr(simhash, "materialise_at", counted)
    docs = table(spark, rows)
    marked = simhash.materialise(simhash.marks(docs), "marks")
    bands = {r.doc_id: set(r.bands) for r in marked.collect()}
    links = {(r.a, r.b) for r in simhash.similar_links(docs, marked).collect()}
    sets = {i: set(simhash.grams(t).tolist()) for i, t in rows}
    true = [(i, j) for i, j in itertools.combinations(sets, 2) if bands[i] & bands[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]

    def groups(pairs):
        parent = {i: i for i, _ in rows}

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in pairs:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
        return [root(i) for i in parent]

    assert groups(links) == groups(true)
    assert made[0] <= simhash.BANDS * len(rows) and sum(made[1:]) <= 3 * len(rows)


@pytest.mark.parametrize("small", [30, 2_000])
def test_shard_trees(small):
    """A shard's own trees, the second ones too, lose no link."""
    rng = np.random.default_rng(small)
    home = rng.integers(0, 2**64, 300, dtype=np.uint64)
    home &= np.uint64(0xFFFFFFFFFFFF00FF)  # few values in one quarter, so that its tree cannot split them
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (4, 300), dtype=np.uint64), axis=0)
    everyone = np.unique(np.concatenate([home, home ^ flips, home[:40] ^ np.uint64(3)]))
    for q in range(4):
        a, b = simhash.link_shard(home.view(np.int64), everyone.view(np.int64), q, 4, small)
        label = {r: r for r in everyone.view(np.int64).tolist()} | dict(zip(a.tolist(), b.tolist()))
        near = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1") <= 4
        part = lambda x: x >> 16 * q & 0xFFFF
        for x in home.view(np.int64).tolist():
            for y in everyone.view(np.int64).tolist():
                # What this quarter's tree must find: pairs within a quarter of the radius there.
                if near(x, y) and bin(part(x) ^ part(y)).count("1") <= 1:
                    assert label[x] == label[y]
