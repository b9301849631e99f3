"""Edge cases on hand-written rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillspark import storage
from quillspark.fixtures import Fixtures
from quillspark.functions import text as X
from quillspark.operators import cases as cases_of
from quillspark.operators import graph, inventory
from quillspark.operators.iterations import Convergence, check_convergence, next_round, stop_round


@pytest.mark.parametrize(
    "scores,cfg,want",
    [
        ([0.5], Convergence(), None),
        ([0.5, 0.65], Convergence(), (2, "delta")),
        ([0.5, 0.5, 0.5], Convergence(), (3, "stagnation")),
        ([0.5, 0.55, 0.6, 0.55, 0.6], Convergence(), (5, "max_rounds")),
        ([0.5, 0.9], Convergence(delta=1.0, absolute=0.9), (2, "absolute")),
        ([0.5, 0.9], Convergence(absolute=0.9), (2, "delta")),
    ],
)
def test_convergence(spark, scores, cfg, want):
    df = spark.createDataFrame([("s", k + 1, s) for k, s in enumerate(scores)], "session_id string, round int, weighted_score double")
    assert [(r.stop_round, r.reason) for r in stop_round(df, cfg).collect()] == ([want] if want else [])


@pytest.mark.parametrize("cfg", [Convergence(max_rounds=5, delta=9.0), Convergence(max_rounds=6, delta=0.4, window=2, epsilon=0.1), Convergence(max_rounds=6, delta=9.0, window=4, epsilon=0.2, absolute=0.95)])
def test_convergence_a_round_at_a_time(spark, cfg):
    """What is carried from round to round gives the reasons that all rounds together give."""
    rng = random.Random(cfg.window)
    scores = {s: [rng.choice((0.0, 0.1, 0.45, 0.5, 0.51, 1.0)) for _ in range(6)] for s in range(60)}
    rows = [(s, n, x) for s, xs in scores.items() for n, x in enumerate(xs, 1)]
    df = spark.createDataFrame(rows, "session_id long, round int, weighted_score double")
    want = {(r.session_id, r.round): r.reason for r in check_convergence(df, cfg).collect()}
    got, state = {}, None
    for n in range(1, 7):
        state = storage.materialise(next_round(state, df.where(F.col("round") == n).drop("round"), n, cfg), "state")
        got |= {(r.session_id, r.round): r.reason for r in state.collect()}
    assert got == want and len({r for r in want.values() if r}) >= 2
    assert max(len(r.steps) for r in state.collect()) == cfg.window - 1


def test_components_of_chains_and_cycles(spark):
    rng = random.Random(0)
    chain = [(i, i + 1) for i in range(300)]
    rng.shuffle(chain)
    edges = [*chain, (1000, 1001), (1001, 1000), (2000, 2000), (None, 5)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000, 2000: 2000}
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_impact_keeps_kinds_of_all_shortest_paths(spark):
    edges = spark.createDataFrame([(1, 2, "a"), (1, 3, "b"), (2, 4, "c"), (3, 4, "d"), (4, 5, "e"), (1, 5, "z")], "src long, dst long, kind string")
    got = {r.node: (r.distance, r.kinds) for r in graph.downstream_impact(edges, spark.createDataFrame([(1,)], "start long")).collect()}
    assert got == {2: (1, "a"), 3: (1, "b"), 4: (2, "a,b,c,d"), 5: (1, "z")}


def test_levels_leave_cycles_out(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (7, 8), (8, 7), (8, 9)], "src long, dst long")
    assert {r.node: r.level for r in graph.topo_levels(edges).collect()} == {1: 0, 2: 1, 3: 2, 7: None, 8: None, 9: None}


@pytest.mark.parametrize("depth", [6, 300])
def test_levels_of_long_chains(spark, depth):
    chain = [(i, i + 1) for i in range(depth)] + [(0, depth), (5000, 3), (0, 7000)]
    cycle = [(depth, 8000), (8000, 8001), (8001, 8000), (8001, 8002)]
    edges = spark.createDataFrame([*chain, *cycle], "src long, dst long")
    want = {i: i for i in range(depth + 1)} | {5000: 0, 7000: 1, 8000: None, 8001: None, 8002: None}
    assert {r.node: r.level for r in graph.topo_levels(edges).collect()} == want
    starts = spark.createDataFrame([(0,), (5000,), (8001,), (8002,)], "start long")
    assert {r.start: r.cyclic for r in graph.reachable_cycles(edges, starts).collect()} == {0: True, 5000: True, 8001: True, 8002: False}
    plain = spark.createDataFrame(chain, "src long, dst long")
    assert {r.node: r.layer for r in graph.dag_layers(plain).collect()} == {i: i for i in range(depth + 1)} | {5000: 0, 7000: 1}
    assert not any(r.cyclic for r in graph.reachable_cycles(plain, starts.where("start < 8000")).collect())


def test_cases_hold_whole_texts(spark):
    cases = Fixtures(spark, "/root/testdata/sf0.001").cases.select("case_id", "body").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.case_id: r.body for r in cases} == texts and max(len(t or "") for t in texts.values()) > 4 * 1024


def test_render_is_one_pass(spark):
    df = spark.createDataFrame([("{a} {{ b }} {c} $1", {"a": "{b}", "b": "$0"})], "t string, v map<string,string>")
    assert df.select(X.render(F.col("t"), F.col("v"))).first()[0] == "{b} $0 {c} $1"


def test_json_object(spark):
    rows = ['{"a": 1}', "```json\n{\"a\": 1}\n```", "see {\"a\": {\"b\": 2}} ok", "no", "[1]", "} {", None]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "r string").select(X.json_object(F.col("r"))).collect()]
    assert got == ['{"a": 1}', '{"a": 1}', '{"a": {"b": 2}}', None, None, None, None]


def test_impact_refuses_unknown_starts_and_cycles(spark):
    edges = spark.createDataFrame([(1, 2, "a"), (2, 3, "a"), (3, 2, "a"), (4, 5, "a")], "src long, dst long, kind string")
    one = lambda i: spark.createDataFrame([(i,)], "start long")
    for bad, why in ((9, "not in the graph"), (1, "cycle")):
        with pytest.raises(ValueError, match=why):
            graph.downstream_impact(edges, one(bad))
    assert [r.node for r in graph.downstream_impact(edges, one(4)).collect()] == [5]
    assert graph.downstream_impact(edges, one(5)).count() == 0


def test_impact_of_a_long_chain(spark):
    """No limit of rings."""
    depth = 12
    edges = spark.createDataFrame([(i, i + 1, "a") for i in range(depth)], "src long, dst long, kind string")
    got = graph.downstream_impact(edges, spark.createDataFrame([(0,)], "start long")).collect()
    assert {r.node: r.distance for r in got} == {i: i for i in range(1, depth + 1)}


def test_roles(spark):
    df = spark.createDataFrame([("human",), ("AI",), ("function",), ("system",), (None,)], "r string")
    assert [r[0] for r in df.select(X.role(F.col("r"))).collect()] == ["user", "assistant", "tool", "system", None]


def _smallest(sites, scopes):
    out = {}
    for file, site, line in sites:
        around = [(b - a, -a, q) for f, q, a, b in scopes if f is not None and f == file and line is not None and a <= line <= b]
        out[file, site, line] = min(around)[2] if around else None
    return out


def _nested(rng, file, a, b, depth, out):
    while a <= b and rng.random() < 0.9:
        to = rng.randint(a, b)
        out.append((file, f"q{rng.randrange(1000)}", a, to))
        if depth and a < to:
            _nested(rng, file, a + 1, to - rng.randrange(2), depth - 1, out)
        a = to + rng.randint(1, 3)


def test_scopes_around_sites(spark):
    rng = random.Random(4)
    scopes = []
    for k in range(6):
        _nested(rng, f"f{k}", 1, 60, 5, scopes)
    scopes += [("f1", "again", 3, 9), ("f1", "same", 3, 9), ("f0", "whole", 0, 70), ("f0", "whole", 0, 70), ("g", "x", 1, 5), ("g", "y", 5, 9), ("g", "z", 7, 8), ("f2", "none", 9, 2), (None, "n", 1, 9)]
    sites = [(f"f{rng.randrange(7)}", k, rng.randrange(70)) for k in range(200)] + [("g", k, k) for k in range(12)] + [("g", 1, 1), (None, 1, 2), ("f0", 5, None)]
    df = inventory.enclosing_scope(spark.createDataFrame(sites, "file string, site int, line int"), spark.createDataFrame(scopes, "file string, qual string, line_start int, line_end int"))
    got = df.collect()
    want = _smallest(sites, scopes)
    assert {(r.file, r.site, r.line): r.scope for r in got} == want and len(got) == len(want)
    assert spark.createDataFrame([], "file string, site int, line int").transform(lambda e: inventory.enclosing_scope(e, e.select("file", F.col("site").alias("qual"), F.col("line").alias("line_start"), F.col("line").alias("line_end")))).count() == 0


def test_intermediate_tables_are_cleared(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    before = set(storage.matching(spark, f"{storage.shared_root(spark)}/*"))
    with storage.cleared(spark):
        kept = storage.new_path(spark, "outer")
        edges.write.parquet(kept)
        with storage.cleared(spark):
            assert graph.components(edges).count() == 3 and graph.topo_levels(edges).count() == 3
        assert set(storage.matching(spark, f"{storage.shared_root(spark)}/*")) - before == set(storage.matching(spark, kept))
    assert set(storage.matching(spark, f"{storage.shared_root(spark)}/*")) == before


def test_crossing_scopes_are_not_paired_with_sites(spark):
    """Many sites and crossing scopes of one file: right scopes, and no join by a range of lines, which costs all pairs."""
    scopes = [("f", i, i * 7 % 50 - 5, i * 7 % 50 - 5 + i * 11 % 31) for i in range(2000)]
    sites = [("f", i, i % 80 - 10) for i in range(3000)]
    df = inventory.enclosing_scope(spark.createDataFrame(sites, "file string, site int, line int"), spark.createDataFrame(scopes, "file string, qual int, line_start int, line_end int"))
    best = {line: min(((b - a, -a, q) for _, q, a, b in scopes if a <= line <= b), default=(0, 0, None))[2] for line in range(-10, 70)}
    assert {r.site: r.scope for r in df.collect()} == {s: best[line] for _, s, line in sites}
    joins = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert joins and not any("<=" in j or ">=" in j for j in joins)


def test_rows_of_a_case_follow_each_other(spark):
    """The run matrix goes through cases, not targets: a body's rows are one run, and a large dataset is in several tasks."""
    targets = spark.createDataFrame([(t, t % 2) for t in range(40)], "target_id long, dataset_id long")
    given = [(c % 2, c, f"body {c}") for c in range(300)] + [(7, 999, "no target"), (None, 998, "no dataset")]
    inline = spark.createDataFrame([(3, 0, "own"), (99, 0, "no such target")], "target_id long, case_index long, body string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = cases_of.run_matrix(targets, spark.createDataFrame(given, "dataset_id long, case_index long, body string"), inline).rdd.glom().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    got = sorted((r.target_id, r.case_index, r.body) for part in rows for r in part)
    assert got == sorted([(3, 0, "own")] + [(t, c, b) for t in range(40) if t != 3 for d, c, b in given if d == t % 2])
    runs = sum(sum(a.body != b.body for a, b in zip(part, part[1:])) + 1 for part in rows if part)
    assert runs == 301 and sum(len({r.case_index for r in part}) > 1 for part in rows) >= 3  # 302 cases, 128 a task


def test_targets_of_the_matrix_are_not_broadcast(spark, tmp_path):
    """Ids of targets and of inline cases grow with the input; with small files they still don't go through the driver."""
    spark.range(40).selectExpr("id as target_id", "id % 2 as dataset_id").write.parquet(f"{tmp_path}/targets")
    spark.range(6).selectExpr("id % 2 as dataset_id", "id as case_index", "concat('body ', id) as body").write.parquet(f"{tmp_path}/cases")
    spark.range(0, 80, 20).selectExpr("id as target_id", "0L as case_index", "'own' as body").write.parquet(f"{tmp_path}/inline")
    df = cases_of.run_matrix(*[spark.read.parquet(f"{tmp_path}/{t}") for t in ("targets", "cases", "inline")])
    plan = df._jdf.queryExecution().executedPlan().toString()
    # All joins but that of cases with their dataset's size, a row a dataset.
    assert plan.count("SortMergeJoin") == 4 and plan.count("BroadcastHashJoin") <= 1
    assert sorted((r.target_id, r.case_index, r.body) for r in df.collect()) == sorted(
        [(t, 0, "own") for t in (0, 20)] + [(t, c, f"body {c}") for t in range(40) if t not in (0, 20) for c in range(6) if c % 2 == t % 2]
    )
