"""Aggregations over scores, outputs and feedback (A1-A18) and the joins that feed them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scores_with_runs(scores: DataFrame, runs: DataFrame) -> DataFrame:
    """Each score with the prompt and version its run was of; prompt runs only."""
    of = runs.where("target_kind = 'prompt'").select("run_id", F.col("target_id").alias("prompt_id"), F.col("target_version").alias("version"))
    return scores.join(of, "run_id")


def avg_score_by_run(scores: DataFrame) -> DataFrame:
    """A1: mean score of each run; null scores are ignored, and a run of nulls has a null mean."""
    return scores.groupBy("run_id").agg(F.avg("score").alias("avg_score"))


def avg_score_by_version(scores: DataFrame, runs: DataFrame) -> DataFrame:
    """A2: mean score of each prompt version."""
    return scores_with_runs(scores, runs).groupBy("prompt_id", "version").agg(F.avg("score").alias("avg_score"))


def run_metrics(outputs: DataFrame) -> DataFrame:
    """A3 / A4 / A5: token roll-up by run; a failed case counts as zero tokens."""
    ok = F.col("error").isNull()
    total = lambda c: F.sum(F.when(ok, F.coalesce(F.col(c), F.lit(0))).otherwise(0))
    return outputs.groupBy("run_id").agg(
        F.count("*").alias("n_cases"),
        F.count_if(~ok).alias("n_errors"),
        total("input_tokens").alias("input_tokens"),
        total("output_tokens").alias("output_tokens"),
    )


def round_score(rounds: DataFrame, scores: DataFrame, on: str) -> DataFrame:
    """Mean score of each round, 0.0 for a round without scores."""
    return rounds.join(scores.groupBy(on).agg(F.avg("score").alias("_avg")), on, "left").select(on, F.coalesce("_avg", F.lit(0.0)).alias("round_score"))


def worst_critique(feedback: DataFrame, limit: int = 400) -> DataFrame:
    """Critique of each run's worst-rated case that has one, cut to ``limit`` characters."""
    said = feedback.where(F.length(F.trim("critique")) > 0)
    cut = F.when(F.length("c") <= limit, F.col("c")).otherwise(F.concat(F.substring("c", 1, limit - 1), F.lit("…")))
    return said.groupBy("run_id").agg(F.min_by("critique", F.struct("rating", "case_index", "id")).alias("c")).select("run_id", cut.alias("critique"))


def enrichment_estimate(prompts: DataFrame, per_call: float = 0.002) -> DataFrame:
    """A10: enrichment calls by project, and their cost: unsure sites, unresolved messages, missing purposes."""
    return prompts.groupBy("project").agg(
        F.count_if(F.col("confidence") != "high").alias("n_check"),
        F.count_if(F.col("template_kind") == "unresolved").alias("n_resolve"),
        F.count_if(F.coalesce(F.trim("purpose"), F.lit("")) == "").alias("n_purpose"),
    ).withColumn("cost_usd", (F.col("n_check") + F.col("n_resolve") + F.col("n_purpose")) * F.lit(per_call))


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """Feedback rows of each run by rating."""
    return feedback.groupBy("run_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("rating") == 1).alias("n_up"),
        F.count_if(F.col("rating") == 0).alias("n_neutral"),
        F.count_if(F.col("rating") == -1).alias("n_down"),
    )


def over_budget(runs: DataFrame, group: str, limit: float) -> DataFrame:
    """Groups of runs whose cost passes the limit."""
    return runs.groupBy(group).agg(F.sum("cost_usd").alias("cost_usd")).where(F.col("cost_usd") > limit)


def usd(input_tokens: Column, output_tokens: Column, usd_in: Column, usd_out: Column) -> Column:
    """Cost of tokens at prices for a thousand in and out."""
    return input_tokens * usd_in / F.lit(1000.0) + output_tokens * usd_out / F.lit(1000.0)


def price_usage(outputs: DataFrame, price_book: DataFrame) -> DataFrame:
    """Cost by the price book; a model that it lacks has a null cost and ``priced`` false.

    The book has one row a model offered anywhere, some hundreds, and is broadcast.
    """
    joined = outputs.join(F.broadcast(price_book), ["provider", "model"], "left")
    cost = usd(F.col("input_tokens"), F.col("output_tokens"), F.col("usd_in"), F.col("usd_out"))
    return joined.select(*outputs.columns, cost.alias("cost_usd"), F.col("usd_in").isNotNull().alias("priced"))


def price_mismatch(outputs: DataFrame, price_book: DataFrame) -> DataFrame:
    """Unpriced pairs of provider and model, with another provider that prices the model."""
    unpriced = outputs.select("provider", "model").distinct().join(F.broadcast(price_book), ["provider", "model"], "left_anti")
    other = price_book.groupBy("model").agg(F.min("provider").alias("priced_by"))
    return unpriced.join(F.broadcast(other), "model", "left").select("provider", "model", "priced_by")


def weakest_dimensions(per_dim: DataFrame, k: int = 2) -> DataFrame:
    """The ``k`` dimensions of each session that cost most, ``(1 - mean) * weight``; perfect ones are left out.

    ``per_dim`` is ``(session_id, dimension, weight, score)``.
    """
    mean = per_dim.groupBy("session_id", "dimension", "weight").agg(F.avg("score").alias("mean"))
    # Rounded, so that equal impacts tie whatever order their scores were added in.
    hurt = mean.withColumn("impact", F.round((1 - F.col("mean")) * F.col("weight"), 9)).where("impact > 0")
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("impact"), "dimension"))
    return hurt.withColumn("rank", rank).where(F.col("rank") <= k).select("session_id", "dimension", "impact", "rank")


def price_images(requests: DataFrame, image_price_book: DataFrame) -> DataFrame:
    """Cost of ``n`` images by model, size and quality; null where the book lacks them or ``n`` is below 1.

    The book is a fixed table of some rows and is broadcast.
    """
    joined = requests.join(F.broadcast(image_price_book), ["model", "size", "quality"], "left")
    return joined.withColumn("cost_usd", F.when(F.col("n") >= 1, F.col("usd_each") * F.col("n"))).drop("usd_each")


def pipeline_run_metrics(outputs: DataFrame) -> DataFrame:
    """A4: tokens of each pipeline run over its nodes and cases; a failed case counts as zero tokens.

    ``outputs`` has ``run_id``, ``node``, ``case_index``, ``error`` and token counts. ``n_cases`` counts
    cases, not their nodes: nodes first, so both counts come from one more grouping of a run's cases.
    """
    ok = F.col("error").isNull()
    total = lambda c: F.sum(F.when(ok, F.coalesce(F.col(c), F.lit(0))).otherwise(0)).alias(c)
    by_case = outputs.groupBy("run_id", "case_index").agg(
        F.bool_or(~ok).alias("_failed"), F.count("*").alias("_n"), total("input_tokens"), total("output_tokens")
    )
    return by_case.groupBy("run_id").agg(
        F.count("*").alias("n_cases"), F.count_if("_failed").alias("n_failed"), F.sum("_n").alias("n_outputs"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
    )


def round_cost(costs: DataFrame) -> DataFrame:
    """A5: cost of each revision round; unpriced calls count as zero and are counted."""
    return costs.groupBy("session_id", "round").agg(
        F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 9).alias("cost_usd"), F.count_if(F.col("cost_usd").isNull()).alias("n_unpriced")
    )


def pipeline_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(pipeline_id, n_nodes, n_edges, n_entries, n_exits)``; self-loops are no edges.

    One union of node and edge ends, so a pipeline's counts take two groupings and no join.
    """
    own = edges.where("src <> dst").select("pipeline_id", "src", "dst").distinct()
    one, none = F.lit(1), F.lit(0)
    marks = (
        nodes.select("pipeline_id", F.col("prompt_id").alias("node"), one.alias("known"), none.alias("outs"), none.alias("ins"))
        .unionByName(own.select("pipeline_id", F.col("src").alias("node"), none.alias("known"), one.alias("outs"), none.alias("ins")))
        .unionByName(own.select("pipeline_id", F.col("dst").alias("node"), none.alias("known"), none.alias("outs"), one.alias("ins")))
    )
    by_node = marks.groupBy("pipeline_id", "node").agg(F.max("known").alias("known"), F.sum("outs").alias("outs"), F.sum("ins").alias("ins"))
    return by_node.groupBy("pipeline_id").agg(
        F.sum("known").alias("n_nodes"),
        F.sum("outs").alias("n_edges"),
        F.count_if((F.col("known") == 1) & (F.col("ins") == 0)).alias("n_entries"),
        F.count_if((F.col("known") == 1) & (F.col("outs") == 0)).alias("n_exits"),
    )


def scan_summary(**tables: DataFrame) -> DataFrame:
    """Rows of each table by project, one column a table; a project that a table lacks counts 0."""
    names = list(tables)
    whole = None
    for name, df in tables.items():
        part = df.select("project", F.lit(name).alias("_t"))
        whole = part if whole is None else whole.unionByName(part)
    return whole.groupBy("project").agg(*[F.count_if(F.col("_t") == n).alias(f"n_{n}") for n in names])


def prompt_cost_estimate(texts: DataFrame, price_book: DataFrame) -> DataFrame:
    """Cost of running each prompt once: ``(id, tokens_in, tokens_out, cost_usd, status)``.

    ``texts`` is ``(id, text, provider, model)``, with the head version's text, or else the scanned one. A
    prompt without text or price has a null cost and says so.
    """
    from quillspark.functions import text as X

    sized = texts.withColumn("tokens_in", F.when(F.length("text") > 0, X.token_estimate(F.col("text")))).withColumn(
        "tokens_out", X.output_estimate(F.col("tokens_in"))
    )
    sized = sized.withColumn("tokens_out", F.when(F.col("tokens_in").isNotNull(), F.col("tokens_out")))
    priced = sized.join(F.broadcast(price_book), ["provider", "model"], "left")
    cost = F.col("tokens_in") * F.col("usd_in") / F.lit(1000.0) + F.col("tokens_out") * F.col("usd_out") / F.lit(1000.0)
    status = F.when(F.col("tokens_in").isNull(), "no_template").when(F.col("usd_in").isNull(), "unpriced").otherwise("ok")
    return priced.select("id", "tokens_in", "tokens_out", cost.alias("cost_usd"), status.alias("status"))
