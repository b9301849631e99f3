"""Event logs as Structured Streaming jobs (T1-T6); each has a batch twin among the operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from quillspark.operators.integrity import merge_snapshot
from quillspark.operators.iterations import Convergence
from quillspark.storage import exists, matching, new_path, remove


def stream_run_state(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """``(run_id, started_at, status, finished_at)`` of each session of a run, once it is over; append mode.

    ``events`` is ``(run_id, at, status)``. A session is over when no event came for ``gap``, and no earlier one can
    come any more; its last status counts, of equal times the later one in the alphabet. Events more than ``late``
    behind the latest seen are dropped, so the state holds open sessions only.
    """
    spans = F.session_window("at", gap)
    last = events.withWatermark("at", late).groupBy("run_id", spans.alias("w")).agg(F.max(F.struct("at", "status")).alias("_l"))
    final = F.col("_l.status").isin("done", "failed")
    return last.select("run_id", F.col("w.start").alias("started_at"), F.col("_l.status").alias("status"), F.when(final, F.col("_l.at")).alias("finished_at"))


def stream_score_windows(scores: DataFrame, length: str, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Mean score and count of each window of ``at``, once no row can come for it any more.

    Rows more than ``late`` behind the latest seen are dropped, which bounds the state.
    """
    spans = F.window("at", length, slide) if slide else F.window("at", length)
    grouped = scores.withWatermark("at", late).groupBy(spans.alias("w")).agg(F.avg("score").alias("avg_score"), F.count("score").alias("n"))
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "avg_score", "n")


def stream_dedupe_scores(scores: DataFrame, keys: list[str], within: str) -> DataFrame:
    """The first row of each key; a key is forgotten ``within`` after it was seen."""
    return scores.withWatermark("at", within).dropDuplicatesWithinWatermark(keys)


STOP = "session_id string, stop_round long, reason string"
_HELD = (
    "session_id string, n long, first double, last long, recent array<double>, ended boolean, latest long, "
    "early_rounds array<long>, early_scores array<double>, early_at array<long>"
)


class ConvergenceOfSessions(StatefulProcessor):
    """The batch rule (W2) over rounds that may come out of order: one row a session, when it should stop.

    A round whose number follows is judged at once. One that comes before its predecessor waits in a list, until that
    comes or the watermark says that it cannot come any more. An ended session keeps a mark; the mark, or the state
    of a session without news, goes after ``forget``, by event time. A key is a bucket of sessions, as each call of the
    state costs far more than a round: a trigger reads and writes the list of a bucket that it touches once.
    """

    def __init__(self, cfg: Convergence, forget_ms: int):
        self.cfg, self.forget_ms = cfg, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", _HELD)
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: dict[str, list[tuple[int, float, int]]] = {}
        for some in rows:
            when = some["at"].astype("datetime64[ms]").astype("int64")
            for session, r, s, t in zip(some["session_id"], some["round"], some["weighted_score"], when, strict=True):
                new.setdefault(session, []).append((int(r), float(s), int(t)))
        yield from self.go_on(new, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        # One timer does all that is due; those of earlier plans find nothing.
        if self.due.exists() and self.due.get()[0] <= passed:
            yield from self.go_on({}, passed)

    def go_on(self, new: dict[str, list[tuple[int, float, int]]], passed: int | None) -> Iterator[pd.DataFrame]:
        """Judge the sessions of a bucket that have news or, after ``passed``, wait for what cannot come; plan the next time."""
        held, out = {row[0]: tuple(row[1:]) for row in self.held.get()}, []
        for session in new if passed is None else [s for s, state in held.items() if any(t <= passed for t in state[-1])]:
            held[session], stop = self.judge(held.get(session, (0, 0.0, 0, [], False, 0, [], [], [])), new.get(session, []), passed)
            if stop:
                out.append((session, *stop))
        if passed is not None:
            held = {session: state for session, state in held.items() if state[5] + self.forget_ms > passed}
        if held:
            self.held.put([(session, *state) for session, state in held.items()])
            due = min(min([state[5] + self.forget_ms, *state[-1]]) for state in held.values())
            if not self.due.exists() or self.due.get()[0] != due:
                self.due.update((due,))
                self.handle.registerTimer(due)
        else:
            self.held.clear()
            self.due.clear()
        if out:
            yield pd.DataFrame(out, columns=["session_id", "stop_round", "reason"])

    def judge(self, state: tuple, new: list[tuple[int, float, int]], passed: int | None) -> tuple[tuple, tuple[int, str] | None]:
        """Rounds in order, as far as none is missing before them, or all before ``passed``: the next state, and the end if any."""
        cfg, stop = self.cfg, None
        n, first, last, recent, ended, latest, *early = state
        recent, latest = list(recent), max([latest, *(t for _, _, t in new)])
        waiting = sorted([*new, *zip(*early, strict=True)])
        done = 0
        while done < len(waiting) and not ended:
            at, score, when = waiting[done]
            if at > last + 1 and not (passed is not None and when <= passed):
                break
            done += 1
            if at <= last:
                continue  # a repeated round, or one that was given up
            n, first, last = n + 1, score if n == 0 else first, at
            recent = [*recent, score][-cfg.window :]
            steps = [abs(b - a) for a, b in zip(recent, recent[1:], strict=False)]
            reason = None
            if n >= 2 and score - first >= cfg.delta:
                reason = "delta"
            elif n >= 2 and cfg.absolute is not None and score >= cfg.absolute:
                reason = "absolute"
            elif n >= max(2, cfg.window) and max(steps) < cfg.epsilon:
                reason = "stagnation"
            elif n >= max(2, cfg.max_rounds):
                reason = "max_rounds"
            if reason:
                ended, stop = True, (at, reason)
        left = [] if ended else waiting[done:]
        rest = [[w[k] for w in left] for k in range(3)]
        return (n, float(first), last, [] if ended else [float(s) for s in recent], ended, latest, *rest), stop

    def close(self) -> None:
        pass


def stream_convergence(rounds: DataFrame, cfg: Convergence = Convergence(), late: str = "1 hour", forget_ms: int = 7 * 86_400_000, buckets: int = 2048) -> DataFrame:
    """T4: one row a session, when it should stop, over ``(session_id, round, weighted_score, at)``; append mode.

    Rounds may come up to ``late`` out of order; see :class:`ConvergenceOfSessions`. The state is in RocksDB, a list
    for each of ``buckets`` of sessions' hashes, and a session's part is dropped ``forget_ms`` of event time after its
    last round.
    """
    # Lists and timers of a bucket are separate column families of a RocksDB store.
    rounds.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    some = rounds.select(F.col("session_id").cast("string").alias("session_id"), F.col("round").cast("long").alias("round"), F.col("weighted_score").cast("double").alias("weighted_score"), F.col("at").cast("timestamp").alias("at"))
    dealt = some.withWatermark("at", late).withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int"))
    return dealt.groupBy("bucket").transformWithStateInPandas(ConvergenceOfSessions(cfg, forget_ms), STOP, "append", "EventTime")


def stream_budget(costs: DataFrame, group: str, limit: float, gap: str, late: str = "1 hour") -> DataFrame:
    """T5: ``(group, started_at, ended_at, cost_usd)`` of each spending session that has passed the limit; append mode.

    ``costs`` is ``(group, at, cost_usd)``. A session ends when nothing was spent for ``gap``; it is told once no
    earlier cost can come any more, and its state is dropped. Costs more than ``late`` behind the latest seen are
    dropped.
    """
    spans = F.session_window("at", gap)
    spent = costs.withWatermark("at", late).groupBy(group, spans.alias("w")).agg(F.round(F.sum("cost_usd"), 9).alias("cost_usd"))
    return spent.where(F.col("cost_usd") > limit).select(group, F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "cost_usd")


def append_all(stream: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Run a stream in append mode over what is there, and return all it has put out.

    With a ``path``, the next run goes on where the last one under it ended.
    """
    spark, path = stream.sparkSession, path or new_path(stream.sparkSession, name)
    query = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    query.option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def update_all(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Run a stream in update mode over what is there, and return each key's last row.

    A trigger's rows are written under its number, so a repeated trigger replaces what it wrote.
    """
    spark, path = stream.sparkSession, new_path(stream.sparkSession, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_trigger", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/out/{number}")

    query = stream.writeStream.foreachBatch(keep).outputMode("update").trigger(availableNow=True)
    query.option("checkpointLocation", f"{path}/state").start().awaitTermination()
    schema = stream.withColumn("_trigger", F.lit(0).cast("long")).schema
    found = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/out")
    rest = [c for c in stream.columns if c not in keys]
    last = found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_trigger").alias("_l"))
    return last.select(*keys, *[F.col(f"_l.{c}").alias(c) for c in rest])


class BucketedSnapshot:
    """A snapshot table in buckets of its key's hash, at a path; a merge rewrites the buckets that it touches.

    ``path`` holds ``merged``, a version a trigger of the buckets it touched, and ``state``, the stream's checkpoint.
    A bucket's rows are those of its last version. A trigger that is run again writes the same version again, so a
    stream may end anywhere and go on in another session.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, buckets: int = 64, key: str = "id"):
        self.spark, self.path, self.schema, self.buckets, self.key = spark, path.rstrip("/"), schema, buckets, key

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def start(self, rows: DataFrame) -> None:
        """The snapshot before the first trigger; where there is one, it stays."""
        if not exists(self.spark, f"{self.path}/merged/version=-1/_SUCCESS"):
            self._write(rows, -1)

    def _write(self, rows: DataFrame, version: int) -> None:
        dealt = rows.select(*self.schema.names).withColumn("bucket", self.bucket()).repartition("bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/merged/version={version}")

    def versions(self, below: int | None = None) -> dict[int, int]:
        """The version that holds each bucket: names of folders, at most one a bucket and trigger."""
        last: dict[int, int] = {}
        for at in matching(self.spark, f"{self.path}/merged/version=*/bucket=*"):
            version, bucket = (int(part.rsplit("=", 1)[1]) for part in at.rsplit("/", 2)[1:])
            if (below is None or version < below) and version >= last.get(bucket, version):
                last[bucket] = version
        return last

    def read(self, below: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows of the last versions, of all buckets or some; no other files are read."""
        held = self.versions(below)
        paths = [f"{self.path}/merged/version={v}/bucket={b}" for b, v in held.items() if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def merge(self, batch: DataFrame, number: int, now: str) -> None:
        """Merge a trigger's rows (Q5) into the buckets of their keys."""
        batch = batch.persist()
        touched = [r["bucket"] for r in batch.select(self.bucket().alias("bucket")).distinct().collect()]  # at most one a bucket
        if touched:
            self._write(merge_snapshot(self.read(number, touched), batch, now, self.key), number)
        batch.unpersist()

    def drop_old(self) -> None:
        """Delete the versions of buckets that a later one replaces; while no trigger runs."""
        held = self.versions()
        for at in matching(self.spark, f"{self.path}/merged/version=*/bucket=*"):
            version, bucket = (int(part.rsplit("=", 1)[1]) for part in at.rsplit("/", 2)[1:])
            if version < held[bucket]:
                remove(self.spark, at)


def stream_merge_snapshot(new: DataFrame, stored: DataFrame, now: str, path: str, buckets: int = 64) -> DataFrame:
    """Newly scanned rows merged into the snapshot at ``path``, trigger by trigger; the snapshot after the last.

    ``stored`` is the snapshot to begin with, where ``path`` has none yet. A trigger reads and writes only the buckets
    of its rows' keys; a stream that is started again at the same path goes on after its last trigger.
    """
    snapshot = BucketedSnapshot(new.sparkSession, path, stored.schema, buckets)
    snapshot.start(stored)
    query = new.writeStream.foreachBatch(lambda batch, number: snapshot.merge(batch, number, now)).outputMode("append").trigger(availableNow=True)
    query.option("checkpointLocation", f"{snapshot.path}/state").start().awaitTermination()
    return snapshot.read()


def follow(spark: SparkSession, path: str) -> DataFrame:
    """A table's files as a stream, with the schema that they have now; naive times are UTC.

    Spark follows folders, so a table that is one file is followed by its name in the folder above.
    """
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        stream = reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    else:
        stream = reader.parquet(path)
    naive = [f.name for f in schema if f.dataType.typeName() == "timestamp_ntz"]
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else stream
