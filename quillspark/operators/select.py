"""Projections, filters and listings (P1-P8, L1, L4, L5) and prompt joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def list_prompts(prompts: DataFrame, name: str | None = None, order: str = "id") -> DataFrame:
    """Prompts in order, optionally of one name."""
    return (prompts if name is None else prompts.where(F.col("name") == name)).orderBy(order)


def score_listing(scores: DataFrame) -> DataFrame:
    """L4: scores by run, case, kind and judge; the sort is by ranges, so no task sees all rows."""
    return scores.orderBy("run_id", "case_index", "judge_kind", "judge_name")


def feedback_listing(feedback: DataFrame) -> DataFrame:
    """L4: feedback of each run in the order it came."""
    return feedback.orderBy("run_id", "id")


def version_listing(versions: DataFrame) -> DataFrame:
    """L4: versions of each prompt, ascending."""
    return versions.orderBy("prompt_id", "version")


def rows_for(df: DataFrame, run_id: int) -> DataFrame:
    """A run's rows; the filter reaches the scan."""
    return df.where(F.col("run_id") == run_id)


def prompt_summary(prompts: DataFrame, latest: DataFrame) -> DataFrame:
    """What a list of prompts shows, with the latest version."""
    return prompts.join(latest, "id", "left").select("id", "name", "provider", "file", "line", "purpose", "confidence", F.coalesce("latest_version", F.lit(0)).alias("latest_version"))


def template_text(messages: Column) -> Column:
    """A prompt's messages as one text, joined by line feeds; null messages give ''."""
    return F.coalesce(F.array_join(F.transform(messages, lambda m: F.coalesce(m["template_text"], F.lit(""))), "\n"), F.lit(""))


def revise_messages(messages: Column, text: Column) -> Column:
    """Messages with a new text for the first system message, or else for the first of all."""
    at = F.array_position(F.transform(messages, lambda m: m["role"]), "system")
    spot = F.when(at > 0, at - 1).otherwise(F.lit(0))
    return F.transform(messages, lambda m, i: F.when(i == spot, m.withField("template_text", text)).otherwise(m))


def needs(prompts: DataFrame) -> DataFrame:
    """P5: which enrichments each prompt needs."""
    return prompts.select(
        "id",
        (F.col("confidence") != "high").alias("needs_check"),
        (F.col("template_kind") == "unresolved").alias("needs_resolve"),
        (F.coalesce(F.trim("purpose"), F.lit("")) == "").alias("needs_purpose"),
    )


def resolve_prompt_refs(refs: DataFrame, prompts: DataFrame) -> DataFrame:
    """The prompt that each reference means: the one of that id, else the first of that name."""
    by_id = prompts.select(F.col("id").cast("string").alias("ref"), F.col("id").alias("_by_id"))
    by_name = prompts.groupBy(F.col("name").alias("ref")).agg(F.min("id").alias("_by_name"))
    return refs.join(by_id, "ref", "left").join(by_name, "ref", "left").select("ref", F.coalesce("_by_id", "_by_name").alias("prompt_id"))


def newest_runs(runs: DataFrame, limit: int = 50, target_id: int | None = None) -> DataFrame:
    """L1: newest runs first; the limit is held within 1 and 200."""
    of = runs if target_id is None else runs.where(F.col("target_id") == target_id)
    return of.orderBy(F.desc("started_at"), F.desc("run_id")).limit(max(1, min(200, limit)))


def first_cases(cases: DataFrame, n: int) -> DataFrame:
    """The first ``n`` cases of each prompt."""
    return cases.withColumn("_r", F.row_number().over(Window.partitionBy("prompt_id").orderBy("case_id"))).where(F.col("_r") <= n).drop("_r")


def pipeline_of_prompt(nodes: DataFrame) -> DataFrame:
    """The first pipeline that contains each prompt."""
    return nodes.groupBy("prompt_id").agg(F.min("pipeline_id").alias("pipeline_id"))


def missing_nodes(nodes: DataFrame, prompts: DataFrame) -> DataFrame:
    """Pipeline nodes without a prompt."""
    return nodes.join(prompts.select(F.col("id").alias("prompt_id")), "prompt_id", "left_anti")


def pipeline_site_index(nodes: DataFrame, prompts: DataFrame) -> DataFrame:
    """Names of each pipeline's prompts, as sorted ``id=name``; nodes without a prompt are left out."""
    joined = nodes.join(prompts.select(F.col("id").alias("prompt_id"), "name"), "prompt_id")
    entry = F.concat(F.lpad(F.col("prompt_id").cast("string"), 12, "0"), F.lit("="), F.col("name"))
    return joined.groupBy("pipeline_id").agg(F.array_join(F.array_sort(F.collect_set(entry)), ";").alias("sites"))


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are known."""
    known = nodes.select("id")
    return edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """Of edges with the same ends and kind, the surest; of equals, the first detector's."""
    rank = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    best = Window.partitionBy("src", "dst", "kind").orderBy(rank, "detector", "confidence")
    return edges.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def file_anchor(sites: DataFrame) -> DataFrame:
    """The first site of each file."""
    return sites.groupBy("file").agg(F.min_by("id", F.struct("line", "id")).alias("anchor"))
