"""Hard negatives against brute force, with every odd row."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, slice int, v string, anchor_id long"


def table(spark, rows):
    return spark.createDataFrame([(i, e, y, 1, "x", 3) for i, e, y in rows], SCHEMA).repartition(3)


def brute(rows, is_anchor, positives=5, negatives=3):
    kept = {}
    for i, e, y in rows:
        if i is None or y is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v = [math.floor(256 * float(np.float32(x))) for x in e]
        if i not in kept or (y, v) < kept[i]:
            kept[i] = (y, v)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (y, v) in kept.items():
        if not is_anchor(a):
            continue
        scored = sorted((-dot(v, w), i, z) for i, (z, w) in kept.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == y][:positives]:
            fit = [x for x in scored if x[2] != y and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(a, p, r, i, -s, -t) for r, (t, i, _) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, is_anchor=None, **how):
    return sorted(tuple(r) for r in hard_negatives.mine_hard_negatives(table(spark, rows), F.col("vec_id") % 5 == 0 if is_anchor is None else is_anchor, **how).collect())


def odd_rows(seed, n, dims):
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-0.7, 0.9) for _ in range(dims)], rng.randrange(4)) for i in range(n)]
    rows += [(n + k, rows[7][1], k % 3) for k in range(40)]  # copies: ties everywhere
    rows += [(None, rows[0][1], 1), (900, None, 1), (901, rows[1][1], None), (902, [0.1, None], 1), (903, [math.nan] * dims, 2), (904, [math.inf] + [0.0] * (dims - 1), 2)]
    return rows + [(905, [], 1), (910, [0.5] * (dims - 3), 1), (915, [0.4] * (dims + 4), 2), rows[3], rows[3], (3, rows[4][1], 0), (-5, rows[5][1], 1)]


@pytest.mark.parametrize("dims", [1, 8, 13])
def test_against_brute_force(spark, dims):
    rows = odd_rows(dims, 150, dims)
    want = brute(rows, lambda i: i % 5 == 0)
    assert len(want) > 100 and mined(spark, rows) == want


def test_many_cells(spark, monkeypatch):
    for name, small in (("ANCHORS", 7), ("CANDIDATES", 20)):
        monkeypatch.setattr(hard_negatives, name, small)
    rows = odd_rows(5, 120, 9)
    assert mined(spark, rows) == brute(rows, lambda i: i % 5 == 0)


def test_few(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(5, [1.0], 1)]) == []
    assert mined(spark, [(5, [1.0], 1), (6, [1.0], 1)]) == []
    assert mined(spark, [(5, [1.0], 1), (6, [1.0], 1), (7, [0.6], 2), (8, [0.4], 2)]) == [(5, 6, 1, 7, 65536, 256 * 153)]
    assert mined(spark, [(5, [1.0], 1), (6, [1.0], 1)], F.lit(None).cast("boolean")) == []
    with pytest.raises(ValueError, match="long"):
        mined(spark, [(5, [1e30], 1), (6, [1.0], 1)])


def test_planes():
    rng = np.random.default_rng(1)
    a, c = rng.integers(-900, 900, (5, 19)), rng.integers(-900, 900, (30, 19))
    assert (hard_negatives.lookup_scores(hard_negatives.subset_sums(a), hard_negatives.pack_planes(c, 11)) == c @ a.T).all()
