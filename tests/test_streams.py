"""Streams over several triggers: order, late rows, state that ends, restarts."""

from __future__ import annotations

import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quillspark.operators.iterations import Convergence, stop_round
from quillspark.streaming import jobs

DAY = datetime(2024, 3, 1)


def deliver(spark, path, rows, schema):
    """One more file of a log; files are read in the order of their times."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    for k, name in enumerate(sorted(os.listdir(path), key=lambda f: os.path.getmtime(f"{path}/{f}"))):
        os.utime(f"{path}/{name}", (1_700_000_000 + k, 1_700_000_000 + k))


def followed(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def hours(k):
    return DAY + timedelta(hours=k)


ROUNDS = "session_id string, round int, weighted_score double, at timestamp"


def run_rounds(spark, path, deliveries, **how):
    for rows in deliveries:
        deliver(spark, path, rows, ROUNDS)
    stream = jobs.stream_convergence(followed(spark, path, ROUNDS), Convergence(), **how)
    out = f"{path}-out"
    query = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    query = query.option("checkpointLocation", f"{path}-state").option("path", out).start()
    query.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return {r.session_id: (r.stop_round, r.reason) for r in spark.read.schema(jobs.STOP).parquet(out).collect()}, sizes


def test_rounds_out_of_order(spark, tmp_path):
    """Whatever the order over triggers, the answer is the batch twin's."""
    rng = random.Random(3)
    rows = [(f"s{k}", i + 1, rng.choice([0.25, 0.26, 0.3, 0.45]), hours(k + i / 10)) for k in range(12) for i in range(rng.randint(1, 7))]
    shuffled = rng.sample(rows, len(rows))
    got, _ = run_rounds(spark, f"{tmp_path}/in", [shuffled[k::4] for k in range(4)], late="100 hours")
    want = {r.session_id: (r.stop_round, r.reason) for r in stop_round(spark.createDataFrame(rows, ROUNDS)).collect()}
    assert got == want and len(want) > 5


def test_gaps_are_given_up_and_state_ends(spark, tmp_path):
    one = [("a", 1, 0.5, hours(0)), ("a", 3, 0.5, hours(1)), ("b", 1, 0.5, hours(0)), ("b", 2, 0.9, hours(1)), ("c", 2, 0.5, hours(0))]
    two = [("a", 4, 0.5, hours(2)), ("z", 1, 0.1, hours(50))]  # the second round of a, and the first of c, will not come
    three = [("z", 2, 0.1, hours(51))]
    late = [("a", 2, 0.9, hours(1)), ("b", 3, 0.1, hours(51)), ("c", 1, 0.1, hours(0))]  # too late; after the end
    four = [("z", 3, 0.4, hours(1000))]
    got, sizes = run_rounds(spark, f"{tmp_path}/in", [one, two, three, late, four], late="1 hour", forget_ms=100 * 3_600_000)
    assert got == {"a": (4, "stagnation"), "b": (2, "delta"), "z": (3, "delta")}
    assert max(sizes) > sizes[-1] and sizes[-1] <= 2  # only z is left


def test_sessions_share_buckets(spark, tmp_path):
    """The state has a list and a time for each bucket, however many sessions there are; one answer a session."""
    rows = [(f"s{k}", i, 0.25 + (0.2 if i == 3 and k % 2 else 0), hours(i + k / 100)) for k in range(40) for i in (1, 2, 3)]
    early, late = [r for r in rows if r[1] != 2], [r for r in rows if r[1] == 2]
    got, sizes = run_rounds(spark, f"{tmp_path}/in", [early, late], late="100 hours", buckets=2)
    assert got == {f"s{k}": (3, "delta" if k % 2 else "stagnation") for k in range(40)}
    assert 0 < max(sizes) <= 2 * 3


EVENTS = "run_id long, at timestamp, status string"


def test_run_states_over_triggers(spark, tmp_path):
    first = [(1, hours(0), "running"), (2, hours(0), "running"), (1, hours(2), "done")]
    second = [(1, hours(1), "failed"), (2, hours(3), "failed"), (3, hours(40), "running")]  # out of order, within an hour and more
    third = [(1, hours(0), "failed"), (3, hours(41), "done"), (1, hours(42), "running"), (9, hours(500), None)]  # the first is too late
    for rows in (first, second, third):
        deliver(spark, f"{tmp_path}/in", rows, EVENTS)
    stream = jobs.stream_run_state(followed(spark, f"{tmp_path}/in", EVENTS), "5 hours", "2 hours")
    got = sorted((r.run_id, r.started_at, r.status, r.finished_at) for r in jobs.append_all(stream, "states").collect())
    assert got == [(1, hours(0), "done", hours(2)), (1, hours(42), "running", None), (2, hours(0), "failed", hours(3)), (3, hours(40), "done", hours(41))]


COSTS = "who string, at timestamp, cost_usd double"


def test_budgets_over_triggers_and_restarts(spark, tmp_path):
    """Spending sessions over the limit, told once each by a stream that ends and starts again."""
    path, told = f"{tmp_path}/in", []
    for rows in ([("a", hours(0), 3.0), ("b", hours(0), 9.0)], [("a", hours(1), 3.0), ("a", hours(90), 7.0), ("b", hours(1), -5.0)], [("b", hours(2), 50.0), ("c", hours(300), 1.0)]):
        deliver(spark, path, rows, COSTS)
        stream = jobs.stream_budget(followed(spark, path, COSTS), "who", 5.0, "4 hours", "2 hours")
        told.append(sorted((r.who, r.started_at, r.ended_at, r.cost_usd) for r in jobs.append_all(stream, "costs", f"{tmp_path}/job").collect()))
    # The cost of b in the last delivery came too late.
    assert told == [[], [("a", hours(0), hours(5), 6.0)], [("a", hours(0), hours(5), 6.0), ("a", hours(90), hours(94), 7.0)]]


SNAPSHOT = "id long, name string, first_seen_at timestamp, last_seen_at timestamp"


def test_snapshots_over_triggers_and_restarts(spark, tmp_path):
    stored = spark.range(40).select("id", F.concat(F.lit("old"), "id").alias("name"), F.lit(DAY).alias("first_seen_at"), F.lit(DAY).alias("last_seen_at"))
    path, source, schema = f"file://{tmp_path}/snapshot", f"{tmp_path}/in", "id long, name string"

    def run(now):
        return jobs.stream_merge_snapshot(followed(spark, source, schema), stored, now, path, buckets=8)

    deliver(spark, source, [(1, "x"), (50, "x")], schema)
    deliver(spark, source, [(1, "y"), (51, "y")], schema)
    rows = {r.id: (r.name, r.first_seen_at, r.last_seen_at) for r in run("2024-03-02 00:00:00").collect()}
    before = {f.split("/merged/")[1] for f in run("2024-03-02 00:00:00").inputFiles()}
    second = datetime(2024, 3, 2)
    assert len(rows) == 42 and rows[1] == ("y", DAY, second) and rows[50] == ("x", second, second) and rows[2] == ("old2", DAY, DAY)
    deliver(spark, source, [(51, "z")], schema)  # started again: goes on with the third trigger
    after = run("2024-03-03 00:00:00")
    rows = {r.id: (r.name, r.first_seen_at, r.last_seen_at) for r in after.collect()}
    assert len(rows) == 42 and rows[51] == ("z", second, datetime(2024, 3, 3)) and rows[1] == ("y", DAY, second)
    files = {f.split("/merged/")[1] for f in after.inputFiles()}
    assert len(before - files) == 1 and len(files - before) == 1 and files - before == {f for f in files if f.startswith("version=2/")}
    snapshot = jobs.BucketedSnapshot(spark, path, stored.schema, 8)
    again = spark.createDataFrame([(51, "z")], schema)
    snapshot.merge(again, 2, "2024-03-03 00:00:00")  # a repeated trigger
    snapshot.drop_old()
    assert {r.id: (r.name, r.first_seen_at, r.last_seen_at) for r in snapshot.read().collect()} == rows
    assert len(snapshot.read().inputFiles()) <= 8


SCORES = "at timestamp, score double"


def test_windows_over_triggers(spark, tmp_path):
    """A window is told once, when the watermark has passed it; what comes later for it is dropped."""
    minutes = lambda k: DAY + timedelta(minutes=k)
    for rows in ([(minutes(5), 1.0), (minutes(70), 4.0)], [(minutes(10), 3.0), (minutes(200), 8.0)], [(minutes(201), 2.0)], [(minutes(20), 100.0), (minutes(75), None)], [(minutes(900), 1.0)]):
        deliver(spark, f"{tmp_path}/in", rows, SCORES)
    got = jobs.append_all(jobs.stream_score_windows(followed(spark, f"{tmp_path}/in", SCORES), "1 hour", "1 hour"), "windows").collect()
    assert sorted((r.window_start, r.avg_score, r.n) for r in got) == [(minutes(0), 2.0, 2), (minutes(60), 4.0, 1), (minutes(180), 5.0, 2)]


KEYED = "at timestamp, run_id long, judge string"


def test_duplicates_over_triggers(spark, tmp_path):
    """A key is told once as long as it is remembered."""
    for rows in ([(hours(0), 1, "a"), (hours(0), 1, "a"), (hours(0), 2, "a")], [(hours(1), 1, "a"), (hours(1), 1, "b")], [(hours(50), 9, "z")], [(hours(50), 9, "z")], [(hours(51), 1, "a")]):
        deliver(spark, f"{tmp_path}/in", rows, KEYED)
    got = jobs.append_all(jobs.stream_dedupe_scores(followed(spark, f"{tmp_path}/in", KEYED), ["run_id", "judge"], "2 hours"), "scores").collect()
    assert sorted((r.run_id, r.judge, r["at"]) for r in got) == [(1, "a", hours(0)), (1, "a", hours(51)), (1, "b", hours(1)), (2, "a", hours(0)), (9, "z", hours(50))]
