"""Revision rounds: convergence (W2, W3), sessions (A14), latest states (W8, W10), listings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Convergence:
    """When a session stops: rounds at most, gain over the first score, flat rounds, a score to reach."""

    max_rounds: int = 5
    delta: float = 0.15
    window: int = 3
    epsilon: float = 0.02
    absolute: float | None = None


def real_rounds(iterations: DataFrame) -> DataFrame:
    """Without the placeholder rows of round 0."""
    return iterations.where("round > 0")


def check_convergence(iterations: DataFrame, cfg: Convergence = Convergence()) -> DataFrame:
    """The reason, if any, to stop after each round, from the rounds up to it.

    One window a session gives the first score, the largest of the last ``window - 1`` steps and the
    number of rounds. The rules' order is delta, absolute, stagnation, max_rounds; a first round never
    stops.
    """
    by_round = Window.partitionBy("session_id").orderBy("round")
    step = F.abs(F.col("weighted_score") - F.lag("weighted_score").over(by_round))
    recent = by_round.rowsBetween(-(cfg.window - 2), 0)
    seen = (
        iterations.withColumn("_n", F.row_number().over(by_round))
        .withColumn("_first", F.first("weighted_score").over(by_round))
        .withColumn("_step", step)
        .withColumn("_largest", F.max("_step").over(recent))
    )
    reason = stop_reason(F.col("weighted_score"), F.col("_first"), F.col("_largest"), F.col("_n"), cfg)
    return seen.withColumn("reason", reason).drop("_n", "_first", "_step", "_largest")


def stop_reason(score: Column, first: Column, largest: Column, n: Column, cfg: Convergence) -> Column:
    """W2's rule for a session's ``n``-th round, from its score, the first score and the largest recent step."""
    reason = F.when(n < 2, None).when(score - first >= cfg.delta, "delta")
    if cfg.absolute is not None:
        reason = reason.when(score >= cfg.absolute, "absolute")
    return reason.when((n >= cfg.window) & (largest < cfg.epsilon), "stagnation").when(n >= cfg.max_rounds, "max_rounds")


def next_round(state: DataFrame | None, scored: DataFrame, number: int, cfg: Convergence = Convergence()) -> DataFrame:
    """W2 a round at a time: ``scored`` ``(session_id, weighted_score, ...)`` with ``round``, ``reason``, ``first`` and ``steps``.

    ``state`` is what this gave for the round before (None in round 1): a session's first and last score and its
    last ``window - 1`` steps, so that a round costs the same however many came before it. Both have a row a session, so
    neither is broadcast.
    """
    if state is None:
        known = scored.withColumns({"first": F.col("weighted_score"), "steps": F.array().cast("array<double>")})
    else:
        before = state.select("session_id", "first", F.col("weighted_score").alias("_last"), F.col("steps").alias("_steps"))
        steps = F.concat("_steps", F.array(F.abs(F.col("weighted_score") - F.col("_last"))))
        kept = F.slice(steps, F.greatest(F.size(steps) - (cfg.window - 2), F.lit(1)), cfg.window - 1)
        known = scored.hint("merge").join(before, "session_id").withColumn("steps", kept).drop("_last", "_steps")
    reason = stop_reason(F.col("weighted_score"), F.col("first"), F.array_max("steps"), F.lit(number), cfg)
    return known.withColumns({"round": F.lit(number), "reason": reason})


def stop_round(iterations: DataFrame, cfg: Convergence = Convergence()) -> DataFrame:
    """The first stopping round of each session and why; sessions that go on have none."""
    stops = check_convergence(iterations, cfg).where("reason is not null")
    return stops.groupBy("session_id").agg(F.min("round").alias("stop_round"), F.min_by("reason", "round").alias("reason"))


def session_summary(iterations: DataFrame, cfg: Convergence = Convergence()) -> DataFrame:
    """Start, rounds, best score and status of each session: failed before converged before running."""
    whole = iterations.groupBy("session_id").agg(
        F.min("started_at").alias("started_at"),
        F.count("*").alias("n_rounds"),
        F.max_by("weighted_score", "round").alias("last_score"),
        F.bool_or(F.col("revise_mode") == "failed").alias("_failed"),
    )
    status = F.when(F.col("_failed"), "failed").when(F.col("reason").isNotNull(), "converged").otherwise("running")
    return whole.join(stop_round(iterations, cfg), "session_id", "left").select("session_id", "started_at", "n_rounds", "last_score", "reason", status.alias("status"))


def latest_iteration(iterations: DataFrame) -> DataFrame:
    """Each prompt's latest iteration, by start and then by id."""
    return newest_iterations(iterations, 1)


def newest_iterations(iterations: DataFrame, n: int) -> DataFrame:
    """L3: the ``n`` newest iterations of each prompt."""
    newest = Window.partitionBy("prompt_id").orderBy(F.desc("started_at"), F.desc("id"))
    return iterations.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n).drop("_r")


def session_rounds(iterations: DataFrame, session_id: str) -> DataFrame:
    """L2: a session's rounds in order."""
    return iterations.where(F.col("session_id") == session_id).orderBy("round")


def latest_run_state(events: DataFrame) -> DataFrame:
    """Each run's last status; ``finished_at`` where that is a final one.

    ``events`` is ``(run_id, status, at)``; of equal times the status later in the alphabet wins.
    """
    last = events.groupBy("run_id").agg(F.max(F.struct("at", "status")).alias("_l"))
    final = F.col("_l.status").isin("done", "failed")
    return last.select("run_id", F.col("_l.status").alias("status"), F.when(final, F.col("_l.at")).alias("finished_at"))
