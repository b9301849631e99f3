"""Judging and feedback: dimensions (J9, A7, A8), replies (X13, X14, P9), feedback (J10, W7), impact (J11, W9), pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as X

#: The dimensions, with weights, where neither prompt nor project names its own.
DEFAULT_DIMENSIONS: tuple[tuple[str, float], ...] = (("accuracy", 0.40), ("relevance", 0.30), ("safety", 0.15), ("format", 0.15))
NO_RATIONALE = "(critic did not provide a rationale)"


def _valid_lists(dims: DataFrame, key: str, name: str) -> DataFrame:
    """Each key's dimensions as one list; a list with any bad entry is no list. A list is a rubric of some entries."""
    good = F.coalesce((F.trim("dimension") != "") & F.col("weight").between(0, 1), F.lit(False))
    lists = dims.groupBy(key).agg(F.bool_and(good).alias("_ok"), F.collect_list(F.struct("dimension", "weight")).alias(name))
    return lists.where("_ok").drop("_ok")


def active_dimensions(prompts: DataFrame, project_dims: DataFrame, prompt_dims: DataFrame) -> DataFrame:
    """``(prompt_id, dimension, weight)``: the prompt's own list, else its project's, else the default.

    ``prompts`` is ``(prompt_id, project)``. Lists replace each other whole; one with a blank name or a
    weight outside 0 to 1 counts as absent.
    """
    default = F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(w).alias("weight")) for d, w in DEFAULT_DIMENSIONS])
    listed = prompts.join(_valid_lists(prompt_dims, "prompt_id", "_own"), "prompt_id", "left").join(
        _valid_lists(project_dims, "project", "_project"), "project", "left"
    )
    return listed.select("prompt_id", F.inline(F.coalesce("_own", "_project", default)))


def rubric(dims: Sequence[tuple[str, float]]) -> Column:
    """One row a dimension, for a rubric that all rows share."""
    return F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(float(w)).alias("weight")) for d, w in dims]))


def _text_field(tree: Column, name: str) -> Column:
    """A field of a variant, if it is a string."""
    return X.bound(F.try_variant_get(tree, f"$.{name}", "variant"), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))


def judge_replies(replies: DataFrame, dims: DataFrame | Sequence[tuple[str, float]], keys: list[str], on: list[str] | None = None) -> DataFrame:
    """``(*keys, dimension, weight, score, critique)`` of each reply.

    A dimension that a reply lacks has score 0, others in it are ignored, and a reply without a JSON
    object is all zeros. A critique that is no string is ''. ``dims`` is a table joined by the columns
    ``on``, or the pairs of name and weight that judge every reply.
    """
    said = _text_field(F.try_parse_json("_o"), "critique")
    read = replies.withColumn("_o", X.json_object(F.col("reply"))).withColumn("critique", F.coalesce(said, F.lit("")))
    if on:
        each = read.join(dims, on).withColumn("_raw", F.expr("get_json_object(_o, concat('$[\\'', dimension, '\\']'))"))
    else:  # fixed paths are parsed once, not for each row
        raw = [F.struct(F.lit(d).alias("dimension"), F.lit(float(w)).alias("weight"), F.get_json_object("_o", f"$['{d}']").alias("_raw")) for d, w in dims]
        each = read.select("*", F.inline(F.array(*raw)))
    return each.select(*keys, "dimension", "weight", X.score(F.col("_raw")).alias("score"), "critique")


def weighted_total(per_dim: DataFrame, keys: list[str]) -> DataFrame:
    """The weighted sum of a case's scores, held within 0 and 1."""
    total = F.round(F.sum(F.col("score") * F.col("weight")), 9)
    return per_dim.groupBy(*keys).agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)).alias("weighted_total"))


def round_per_dim(rounds: DataFrame, dims: Sequence[tuple[str, float]], per_dim: DataFrame, key: str) -> DataFrame:
    """Mean score of each active dimension in each round, 0.0 where no case has one."""
    means = per_dim.groupBy(key, "dimension").agg(F.avg("score").alias("_mean"))
    wanted = rounds.select(key).distinct().select(key, rubric(dims)).drop("weight")
    return wanted.join(means, [key, "dimension"], "left").select(key, "dimension", F.coalesce("_mean", F.lit(0.0)).alias("mean"))


def worst_cases(scored: DataFrame, key: str, k: int = 2) -> DataFrame:
    """Each round's ``k`` worst cases that have a critique; of equal scores the first case."""
    worst = Window.partitionBy(key).orderBy("weighted_total", "case_index")
    said = scored.where(F.length("critique") > 0)
    return said.withColumn("rank", F.row_number().over(worst)).where(F.col("rank") <= k).select(key, "rank", "case_index", "critique")


def feedback_view(scored: DataFrame, thumbs: DataFrame, notes: DataFrame, keys: list[str]) -> DataFrame:
    """Judge scores, thumbs and notes side by side, whichever exist.

    ``shown_as`` says where the critic sees a case: thumbs-down cases in one block, notes without a
    thumb in the other.
    """
    both = scored.join(thumbs, keys, "full_outer").join(notes, keys, "full_outer")
    shown = F.when(F.col("thumb") == "down", "thumbs_down").when(F.col("thumb").isNull() & (F.length("note") > 0), "note")
    return both.withColumn("shown_as", shown)


def assess_status(pre: DataFrame, post: DataFrame, epsilon: float = 0.02) -> DataFrame:
    """How each node's score moved: improved, regressed, verified (within ``epsilon``) or unverified.

    Both frames are ``(node, score)``. Nodes without a score before are left out.
    """
    if epsilon < 0:
        raise ValueError(f"epsilon is below zero: {epsilon}")
    moved = F.col("_post") - F.col("score")
    status = F.when(F.col("_post").isNull(), "unverified").when(moved > epsilon, "improved").when(moved < -epsilon, "regressed").otherwise("verified")
    return pre.join(post.withColumnRenamed("score", "_post"), "node", "left").select("node", status.alias("status"))


def latest_downstream(events: DataFrame) -> DataFrame:
    """``(iteration_id, statuses)``: a map from each node to its latest status.

    ``events`` is ``(iteration_id, node, status, at)``; of equal times the status later in the alphabet wins.
    """
    last = events.groupBy("iteration_id", "node").agg(F.max(F.struct("at", "status"))["status"].alias("status"))
    entries = F.array_sort(F.collect_list(F.struct("node", "status")))
    return last.groupBy("iteration_id").agg(F.map_from_entries(entries).alias("statuses"))


def unverified_nodes(statuses: Column) -> Column:
    """A status map's nodes that are still unverified, sorted."""
    return F.array_sort(F.map_keys(F.map_filter(statuses, lambda _, s: s == "unverified")))


def pair_outputs(outputs: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """Outputs beside responses; ``side`` is ``both``, ``output`` or ``response``."""
    left = outputs.withColumn("_l", F.lit(True))
    right = responses.withColumn("_r", F.lit(True))
    side = F.when(F.col("_l").isNull(), "response").when(F.col("_r").isNull(), "output").otherwise("both")
    return left.join(right, keys, "full_outer").withColumn("side", side).drop("_l", "_r")


def judge_view(outputs: DataFrame, keys: list[str]) -> DataFrame:
    """What the judge may see of an output, as JSON: text, else error; costs and tokens are withheld."""
    seen = F.to_json(F.struct("text", "error"))
    return outputs.select(*keys, F.when(F.col("text").isNull() & F.col("error").isNull(), "(no output)").otherwise(seen).alias("shown"))


def critic_reply(reply: Column) -> Column:
    """``(template, rationale, status)``: a reply without a usable template has a status other than ``ok``."""

    def told(said: Column) -> Column:
        template = F.when(F.trim(said["template"]) != "", said["template"])
        status = F.when(~said["parsed"], "unparseable").when(template.isNull(), "no_template").otherwise("ok")
        rationale = F.when(template.isNotNull(), F.coalesce(F.nullif(F.trim(said["why"]), F.lit("")), F.lit(NO_RATIONALE)))
        return F.struct(template.alias("template"), rationale.alias("rationale"), status.alias("status"))

    def fields(tree: Column) -> Column:
        return F.struct(_text_field(tree, "revised_template").alias("template"), _text_field(tree, "rationale").alias("why"), tree.isNotNull().alias("parsed"))

    return X.bound(X.bound(F.try_parse_json(X.json_object(reply)), fields), told)


def rationale_text(mode: Column, instruction: Column, rationale: Column) -> Column:
    """A guided revision shows the user's instruction before the critic's reasons."""
    guided = (mode == "guided") & instruction.isNotNull()
    return F.when(guided, F.concat(F.lit("User instruction: "), instruction, F.lit("\nCritic: "), rationale)).otherwise(rationale)


def score_rows(judged: DataFrame, judge_name: str) -> DataFrame:
    """Judged cases as score rows; an empty critique is null."""
    return judged.select(
        "run_id", "case_index", F.lit("llm").alias("judge_kind"), F.lit(judge_name).alias("judge_name"),
        F.col("weighted_total").alias("score"), F.nullif("critique", F.lit("")).alias("critique"),
    )


def feedback_block(weak: DataFrame, worst: DataFrame, thumbs_down: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """What a critic reads of each round: weak dimensions, worst critiques, thumbs-down, other notes.

    Inputs are ``(key, rank, line)``; lines are in rank order, and a part without lines is left out.
    """
    parts = [("Weak dimensions", weak), ("Worst cases", worst), ("Thumbs down", thumbs_down), ("Notes", notes)]
    lines = [df.select(key, F.lit(i).alias("part"), F.lit(title).alias("title"), F.col("rank").cast("long").alias("rank"), "line") for i, (title, df) in enumerate(parts)]
    whole = lines[0]
    for more in lines[1:]:
        whole = whole.unionByName(more)
    block = whole.groupBy(key, "part", "title").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: F.concat(F.lit("- "), x["line"])), "\n").alias("text")
    )
    said = F.array_sort(F.collect_list(F.struct("part", F.concat("title", F.lit(":\n"), "text").alias("text"))))
    return block.groupBy(key).agg(F.array_join(F.transform(said, lambda x: x["text"]), "\n\n").alias("block"))
