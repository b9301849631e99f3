"""Levels and cycles against brute force, and how many jobs a deep graph takes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import contraction, graph


def brute_levels(edges):
    before, nodes = {}, {n for e in edges for n in e}
    for u, v in edges:
        before.setdefault(v, set()).add(u)
    level = {n: 0 for n in nodes if n not in before}
    while True:
        ready = {n: 1 + max(level[u] for u in before[n]) for n in nodes - set(level) if all(u in level for u in before[n])}
        if not ready:
            return {n: level.get(n) for n in nodes}
        level |= ready


def brute_leading(edges):
    reach = {}
    for u, v in edges:
        reach.setdefault(u, set()).add(v)
    changed = True
    while changed:
        changed = False
        for u in reach:
            more = set().union(*(reach.get(v, set()) for v in reach[u])) - reach[u]
            reach[u] |= more
            changed |= bool(more)
    cyclic = {u for u in reach if u in reach[u]}
    return cyclic, {u for u in reach if u in cyclic or reach[u] & cyclic}


def shapes(seed):
    rng = random.Random(seed)
    n = 40
    ids = rng.sample(range(10_000), n * 3)
    dag = [tuple(sorted((rng.randrange(n), rng.randrange(n)))) for _ in range(rng.choice([30, 60, 120]))]
    edges = [(ids[a], ids[b]) for a, b in dag if a != b]
    chain = ids[n : 2 * n]
    edges += list(zip(chain, chain[1:])) + [(ids[rng.randrange(n)], chain[0]), (chain[20], ids[2 * n])]
    if seed % 3:  # cycles behind chains
        ring = ids[2 * n + 1 : 2 * n + 1 + rng.choice([1, 2, 5])]
        edges += list(zip(ring, ring[1:] + ring[:1])) + [(chain[-1], ring[0]), (ring[-1], ids[2 * n + 10]), (ids[2 * n + 10], ids[2 * n + 11])]
    if seed % 4 == 1:  # a knot of many cycles
        knot = ids[2 * n + 12 : 2 * n + 24]
        edges += [(rng.choice(knot), rng.choice(knot)) for _ in range(30)] + [(knot[0], ids[3])]
    return edges


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    edges = shapes(seed)
    df = spark.createDataFrame([*edges, edges[0], (None, 7), (8, None)], "src long, dst long")
    assert {r.node: r.level for r in graph.topo_levels(df).collect()} == brute_levels(edges)
    cyclic, leading = brute_leading(edges)
    assert {r.node for r in contraction.leading_to_cycles(df).collect()} == leading
    starts = spark.createDataFrame([(n,) for n in {e[0] for e in edges}] + [(-1,)], "start long")
    assert {r.start: r.cyclic for r in graph.reachable_cycles(df, starts).collect()} == {e[0]: e[0] in leading for e in edges} | {-1: False}


@pytest.mark.parametrize("seed", [1])
def test_colouring_alone(spark, seed, monkeypatch):
    monkeypatch.setattr(contraction, "SHRINKS", 0.0)  # no more than one round of trimming
    edges = shapes(seed)
    df = spark.createDataFrame(edges, "src long, dst long")
    cyclic, leading = brute_leading(edges)
    assert {r.node for r in contraction.cyclic_nodes(df).collect()} == cyclic
    assert {r.node for r in contraction.leading_to_cycles(df).collect()} == leading


def test_names_and_few(spark):
    df = spark.createDataFrame([("b", "a"), ("a", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    assert {r.node: r.level for r in graph.topo_levels(df).collect()} == {"b": 0, "a": None, "c": None, "x": 0, "y": 1}
    assert {r.node for r in contraction.leading_to_cycles(df).collect()} == {"a", "b", "c"}
    none = spark.createDataFrame([], "src long, dst long")
    assert graph.topo_levels(none).count() == 0 and contraction.leading_to_cycles(none).count() == 0
    assert graph.dag_layers(none).count() == 0


def test_jobs_of_a_deep_chain(spark):
    n = 10_000
    chain = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    sc = spark.sparkContext
    sc.setJobGroup("chain", "levels")
    try:
        out = graph.topo_levels(chain)
        assert out.where("level = node").count() == n + 1
        assert len(sc.statusTracker().getJobIdsForGroup("chain")) < 40
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
