"""Jobs that call a model (U1-U4, U6, U8-U11): calls happen in ``mapInArrow``, everything else is relational."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as X
from quillspark.operators import cases as C
from quillspark.operators.iterations import Convergence, next_round
from quillspark.operators.judging import DEFAULT_DIMENSIONS, critic_reply, feedback_block, judge_replies, judge_view, weighted_total, worst_cases
from quillspark.operators.graph import topo_levels
from quillspark.operators.scores import weakest_dimensions
from quillspark.storage import materialise, materialise_at

MODES = ("node", "segment", "end_to_end")
#: Bytes of rows that are answered, and leave a worker, together; an incoming batch may hold far more.
SLICE = 1 << 20


class ChatBackend(Protocol):
    """A picklable client; one is used for all rows of a partition."""

    def chat(self, prompt: str, temperature: float, max_tokens: int) -> str: ...


@dataclass(frozen=True)
class EchoBackend:
    """Answers without a model: the prompt behind a prefix; fails where the prompt has ``fail_on``."""

    prefix: str = "echo: "
    fail_on: str | None = None

    def chat(self, prompt: str, temperature: float, max_tokens: int) -> str:
        if self.fail_on is not None and self.fail_on in prompt:
            raise RuntimeError("refused")
        return self.prefix + prompt


@dataclass(frozen=True)
class ScoringBackend:
    """Answers without a model: a judge's reply whose scores follow from the prompt's length."""

    dimensions: tuple[str, ...] = ("accuracy", "relevance", "safety", "format")

    def chat(self, prompt: str, temperature: float, max_tokens: int) -> str:
        return json.dumps({d: (len(prompt) + i) % 5 / 4 for i, d in enumerate(self.dimensions)} | {"critique": f"length {len(prompt)}"})


def call_model(df: DataFrame, prompt: Column, backend: ChatBackend, temperature: float = 0.0, max_tokens: int = 512) -> DataFrame:
    """``df`` with ``reply`` and ``error``; a call that fails leaves its message and fails no other row.

    Calls cost far more than rows, so callers repartition where partitions are few. A null prompt is not sent.
    """
    sent = df.withColumn("_prompt", prompt)
    schema = df.withColumn("reply", F.lit(None).cast("string")).withColumn("error", F.lit(None).cast("string")).schema

    def one(text: str | None) -> tuple[str | None, str | None]:
        if text is None:
            return None, "no prompt"
        try:
            return backend.chat(text, temperature, max_tokens), None
        except Exception as e:  # any failure of a backend is that row's result
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, batch.num_rows * SLICE // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                said = [one(t) for t in part.column("_prompt").to_pylist()]
                columns = {c: part.column(c) for c in part.schema.names if c != "_prompt"}
                columns |= {"reply": pa.array([s[0] for s in said], pa.string()), "error": pa.array([s[1] for s in said], pa.string())}
                yield pa.RecordBatch.from_pydict(columns)

    return sent.mapInArrow(run, schema)


def run_prompts(matrix: DataFrame, backend: ChatBackend, keys: list[str]) -> DataFrame:
    """``(*keys, text, error, input_tokens, output_tokens)`` of each template filled with a case's inputs."""
    filled = matrix.select(*keys, X.render(F.col("template"), F.col("inputs")).alias("_sent"))
    said = call_model(filled, F.col("_sent"), backend)
    ok = F.col("error").isNull()
    return said.select(
        *keys, F.col("reply").alias("text"), "error",
        F.when(ok, X.token_estimate(F.col("_sent"))).otherwise(0).alias("input_tokens"),
        F.when(ok, X.token_estimate(F.col("reply"))).otherwise(0).alias("output_tokens"),
    )


def select_nodes(prompts: DataFrame, requests: DataFrame) -> DataFrame:
    """The rows of ``prompts`` that each request runs: its node, its segment, or the whole pipeline.

    ``requests`` is ``(pipeline_id, mode, node, segment)``, one a pipeline, as :func:`validate_runs` passes them. An
    unknown mode, a missing selector, and a node that its pipeline lacks are a ``ValueError``.
    """
    mode = F.col("mode")
    segment = F.when((mode == "segment") & (F.size("segment") > 0), F.col("segment"))
    wanted = requests.withColumn("_wanted", F.when((mode == "node") & F.col("node").isNotNull(), F.array("node")).otherwise(segment))
    bad = wanted.where(mode.isNull() | ~mode.isin(*MODES) | ((mode != "end_to_end") & F.col("_wanted").isNull())).first()
    if bad is not None:
        raise ValueError(f"pipeline {bad['pipeline_id']}: mode {bad['mode']} is unknown or lacks its selector")
    named = wanted.select("pipeline_id", F.explode("_wanted").alias("node")).distinct()
    unknown = named.join(prompts, ["pipeline_id", "node"], "left_anti").first()
    if unknown is not None:
        raise ValueError(f"node {unknown['node']} is not in pipeline {unknown['pipeline_id']}")
    whole = wanted.where("mode = 'end_to_end'").select("pipeline_id").distinct()
    return prompts.join(whole, "pipeline_id", "left_semi").unionByName(prompts.join(named, ["pipeline_id", "node"], "left_semi"))


def run_pipelines(prompts: DataFrame, edges: DataFrame, cases: DataFrame, backend: ChatBackend, requests: DataFrame | None = None) -> DataFrame:
    """``(pipeline_id, node, case_index, text, error)``: each case through its pipeline, outputs passed along edges.

    With ``requests`` (see :func:`select_nodes`) only pipelines asked for run, whole, or one node, or a segment whose
    nodes get outputs along the edges inside it; all nodes also read the case's own inputs.

    ``prompts`` is ``(pipeline_id, node, template)``, ``edges`` ``(src, dst, via, pos)`` between them, ``cases``
    ``(pipeline_id, case_index, inputs)``. A node and a case in two pipelines need ids of their own. One job
    a topological level runs that level of all pipelines; a case ends at its first failing level. A cycle
    is an error.
    """
    if requests is not None:
        prompts = materialise(select_nodes(prompts, requests), "selected")
        inside = prompts.select("node").distinct()
        edges = edges.join(inside.withColumnRenamed("node", "src"), "src", "left_semi").join(inside.withColumnRenamed("node", "dst"), "dst", "left_semi")
    levels = materialise(topo_levels(edges), "levels")
    if not levels.where("level is null").isEmpty():
        raise ValueError("a pipeline has a cycle")
    placed = prompts.join(levels, "node", "left").withColumn("level", F.coalesce("level", F.lit(0)))
    last = placed.agg(F.max("level")).first()[0]
    spark, paths, done = prompts.sparkSession, [], None
    case = ["pipeline_id", "case_index"]
    for level in range((last or 0) + 1):
        live = cases if done is None else cases.join(done.where("error is not null").select(*case).distinct(), case, "left_anti")
        matrix = placed.where(F.col("level") == level).select("pipeline_id", "node", "template").join(live, "pipeline_id")
        if done is not None:
            inputs = C.node_inputs(matrix.select("node", "case_index", "inputs"), edges, done.select("node", "case_index", "text"))
            matrix = matrix.drop("inputs").join(inputs, ["node", "case_index"])
        out, path = materialise_at(run_prompts(matrix, backend, ["pipeline_id", "node", "case_index"]).drop("input_tokens", "output_tokens"), "level")
        paths.append(path)
        done = spark.read.schema(out.schema).parquet(*paths)
    return done


def validate_runs(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(run_id, errors)``: what is wrong with each request, '' if nothing.

    ``requests`` is ``(run_id, pipeline_id, mode, node, segment)``, ``nodes`` ``(pipeline_id, node)``.
    """
    asked = requests.select("run_id", "pipeline_id", F.explode(F.array_union(F.coalesce("segment", F.array().cast("array<long>")), F.filter(F.array("node"), lambda n: n.isNotNull()))).alias("node"))
    unknown = asked.join(nodes, ["pipeline_id", "node"], "left_anti").groupBy("run_id").agg(F.count("*").alias("_u"))
    some = F.coalesce(F.size("segment"), F.lit(0)) > 0
    mode = F.col("mode")
    errors = F.concat_ws(
        ";",
        F.when(mode.isNull() | ~mode.isin(*MODES), "unknown mode"),
        F.when((mode == "node") & F.col("node").isNull(), "node mode needs a node"),
        F.when((mode == "node") & some, "node mode takes no segment"),
        F.when((mode == "segment") & ~F.coalesce(some, F.lit(False)), "segment mode needs a segment"),
        F.when((mode == "end_to_end") & (some | F.col("node").isNotNull()), "end_to_end takes neither"),
        F.when(F.col("_u") > 0, "unknown node"),
    )
    return requests.join(unknown, "run_id", "left").select("run_id", errors.alias("errors"))


def _weights(dims: Sequence[tuple], *names: str) -> str:
    return json.dumps([dict(zip(names, d)) for d in dims], ensure_ascii=False)


def judge_prompt(dims: Sequence[tuple[str, float] | tuple[str, float, str]], shown: Column, purpose: Column | None = None, reference: Column | None = None) -> Column:
    """What a judge reads: the purpose, the dimensions (with weight and rubric), the output, a reference if any, the ask."""
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("Purpose of the prompt: "), F.coalesce(purpose if purpose is not None else F.lit(None), F.lit("(not stated)"))),
        F.lit("Score the output from 0 to 1 on each of these dimensions:"),
        F.lit(_weights(dims, "name", "weight", "rubric")),
        F.lit("Output:"),
        F.coalesce(shown, F.lit("(no output)")),
        *([] if reference is None else [F.concat(F.lit("Reference, to hold the output against:\n\n"), reference)]),
        F.lit(f'Reply with one JSON object: a number for each of {", ".join(d[0] for d in dims)}, and a text "critique".'),
    )


def critic_prompt(template: Column, block: Column, instruction: Column, dims: Sequence[tuple[str, float]] = DEFAULT_DIMENSIONS, name: Column | None = None, purpose: Column | None = None) -> Column:
    """What a critic reads: name, purpose, template, feedback, weights, the user's instruction if any, the ask."""
    said = lambda c, label: F.concat(F.lit(f"{label}: "), F.coalesce(c if c is not None else F.lit(None), F.lit("(not stated)")))
    return F.concat_ws(
        "\n\n",
        F.lit("Improve the template by the feedback."),
        said(name, "Name"),
        said(purpose, "Purpose"),
        F.concat(F.lit("Template: "), template),
        F.concat(F.lit("Feedback:\n"), F.coalesce(F.nullif(block, F.lit("")), F.lit("(none this round)"))),
        F.lit(f"Weights: {_weights(dims, 'name', 'weight')}"),
        F.concat(F.lit("Instruction, to be followed: "), instruction),
        F.lit('Reply with one JSON object with "revised_template" and "rationale".'),
    )


def judge_outputs(outputs: DataFrame, dims: Sequence[tuple[str, float]], backend: ChatBackend, keys: list[str]) -> DataFrame:
    """U4: ``(*keys, weighted_total, critique)``; an output without text, or a failed call, scores 0.

    ``outputs`` is ``(*keys, text, error)``; the judge sees what P9 shows, and the columns ``purpose`` and
    ``reference`` where there are any.
    """
    return weighted_total(judge_dimensions(outputs, dims, backend, keys), [*keys, "critique"]).select(*keys, "weighted_total", "critique")


def judge_dimensions(outputs: DataFrame, dims: Sequence[tuple[str, float]], backend: ChatBackend, keys: list[str]) -> DataFrame:
    """U4 before A8: ``(*keys, dimension, weight, score, critique)``."""
    more = [c for c in ("purpose", "reference") if c in outputs.columns]
    shown = judge_view(outputs, [*keys, *more])
    col = lambda c: F.col(c) if c in more else None
    said = call_model(shown, judge_prompt(dims, F.col("shown"), col("purpose"), col("reference")), backend, 0.0, 512)
    return judge_replies(said, [d[:2] for d in dims], keys)


def revise(requests: DataFrame, backend: ChatBackend, dims: Sequence[tuple[str, float]] = DEFAULT_DIMENSIONS) -> DataFrame:
    """``(prompt_id, template, rationale, status)`` of each request.

    ``requests`` is ``(prompt_id, mode, template, block, instruction)``, with ``name`` and ``purpose`` where there are
    any. Manual revisions take the instruction as the new template, without a call; guided and manual ones without it have a status.
    """
    lacks = F.coalesce(F.trim("instruction"), F.lit("")) == ""
    bad = (F.col("mode") != "auto") & lacks
    by_hand = requests.where((F.col("mode") == "manual") | bad).select(
        "prompt_id", F.when(~bad, F.col("instruction")).alias("template"), F.when(~bad, F.lit("manual edit")).alias("rationale"), F.when(bad, "no_instruction").otherwise("ok").alias("status")
    )
    calls = requests.where((F.col("mode") != "manual") & ~bad)
    hint = F.when(F.col("mode") == "guided", F.col("instruction"))
    col = lambda c: F.col(c) if c in requests.columns else None
    said = call_model(calls, critic_prompt(F.col("template"), F.col("block"), hint, dims, col("name"), col("purpose")), backend, 0.0, 2048)
    said = said.withColumn("_read", critic_reply(F.col("reply")))
    read = F.col("_read")
    guided = F.when(hint.isNotNull(), F.concat(F.lit("User instruction: "), hint, F.lit("\nCritic: "), read["rationale"])).otherwise(read["rationale"])
    status = F.when(F.col("error").isNotNull(), "call_failed").otherwise(read["status"])
    return by_hand.unionByName(said.select("prompt_id", read["template"].alias("template"), F.when(read["template"].isNotNull(), guided).alias("rationale"), status.alias("status")))


def iterate_sessions(prompts: DataFrame, cases: DataFrame, dims: Sequence[tuple[str, float]], runner: ChatBackend, judge: ChatBackend, critic: ChatBackend, cfg: Convergence = Convergence(), notes: DataFrame | None = None) -> DataFrame:
    """U8: ``(session_id, round, template, weighted_score, revise_mode, reason)`` of all sessions together.

    ``prompts`` is ``(session_id, template)``, ``cases`` ``(session_id, case_index, inputs)``. Round 1 is the
    baseline; each later round revises, runs, judges and checks the convergence rule for every session
    that goes on. The critic reads what the judge said of the round before (U7) and users' ``notes`` ``(session_id,
    case_index, thumb, note)`` if given. A failed critic writes a ``failed`` round of score 0 and ends the session. A round is
    one table in the shared folder, so there are at most ``max_rounds`` of them whatever the rows; each round reads
    only the table before it, whose rows carry what the rule needs of earlier ones (``next_round``). All of its tables
    grow with the sessions, but their files are small enough to be taken for small tables: joins are merges, and
    nothing is broadcast through the driver.
    """
    spark, paths, judged, state = prompts.sparkSession, [], None, None
    live = materialise(prompts.select("session_id", "template", F.lit("auto").alias("revise_mode")), "baseline")
    for number in range(1, cfg.max_rounds + 1):
        if state is not None:
            going = state.where("reason is null and revise_mode <> 'failed'")
            asked = going.select(F.col("session_id").alias("prompt_id"), F.lit("auto").alias("mode"), "template", F.lit(None).cast("string").alias("instruction"))
            asked = asked.hint("merge").join(session_block(judged, notes).withColumnRenamed("session_id", "prompt_id"), "prompt_id", "left")
            made = revise(asked, critic, dims).select(F.col("prompt_id").alias("session_id"), "template", F.when(F.col("status") == "ok", "auto").otherwise("failed").alias("revise_mode"))
            live = materialise(made, "revised")
        good = live.where("revise_mode <> 'failed'")
        outputs = run_prompts(good.hint("merge").join(cases, "session_id"), runner, ["session_id", "case_index"])
        judged = materialise(judge_dimensions(outputs, dims, judge, ["session_id", "case_index"]), "judged")
        mean = weighted_total(judged, ["session_id", "case_index"]).groupBy("session_id").agg(F.round(F.avg("weighted_total"), 9).alias("weighted_score"))
        scored = live.hint("merge").join(mean, "session_id", "left").select("session_id", "template", F.coalesce("weighted_score", F.lit(0.0)).alias("weighted_score"), "revise_mode")
        state, path = materialise_at(next_round(state, scored, number, cfg), "round")
        paths.append(path)
        if state.isEmpty():
            break
    return spark.read.schema(state.schema).parquet(*paths).select("session_id", "round", "template", "weighted_score", "revise_mode", "reason")


def session_block(judged: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """U7 for the sessions of one round: ``(session_id, block)``.

    ``judged`` is ``(session_id, case_index, dimension, weight, score, critique)``, ``notes`` ``(session_id,
    case_index, thumb, note)``.
    """
    line = lambda df, text: df.select("session_id", F.col("rank").cast("long").alias("rank"), text.alias("line"))
    case = lambda said: F.concat(F.lit("case "), F.col("case_index").cast("string"), F.lit(": "), said)
    weak = line(weakest_dimensions(judged.select("session_id", "dimension", "weight", "score")), F.col("dimension"))
    totals = weighted_total(judged, ["session_id", "case_index", "critique"])
    worst = line(worst_cases(totals, "session_id"), case(F.col("critique")))
    if notes is None:
        notes = judged.sparkSession.createDataFrame([], "session_id long, case_index long, thumb string, note string")
    ranked = notes.withColumn("rank", F.col("case_index"))
    down = line(ranked.where("thumb = 'down'"), case(F.coalesce(F.nullif("note", F.lit("")), F.lit("(no note)"))))
    other = line(ranked.where("thumb is null and length(note) > 0"), case(F.col("note")))
    return feedback_block(weak, worst, down, other, "session_id")


def enrich_sites(sites: DataFrame, backend: ChatBackend) -> DataFrame:
    """Sites confirmed and given a purpose by a model: ``(id, confidence, purpose)``.

    Sites of high confidence with a purpose are not sent. Of the others, a verdict of false drops the
    site; a verdict's confidence high or medium makes it high, low medium, none leaves it.
    """
    doubtful = (F.col("confidence") != "high") | (F.coalesce(F.trim("purpose"), F.lit("")) == "")
    doubtful = F.coalesce(doubtful, F.lit(True))
    kept = sites.where(~doubtful).select("id", "confidence", "purpose")
    ask = F.concat_ws("\n\n", F.lit('Is this a prompt for a model, and what for? Reply with one JSON object with "is_prompt", "confidence" and "purpose".'), F.col("text"))
    said = call_model(sites.where(doubtful).select("id", "confidence", "purpose", "text"), ask, backend, 0.0, 512)
    field = lambda k: F.get_json_object(X.json_object(F.col("reply")), f"$.{k}")
    sure = F.lower(field("confidence"))
    confidence = F.when(F.col("confidence") == "high", "high").when(sure.isin("high", "medium"), "high").when(sure == "low", "medium").otherwise(F.col("confidence"))
    confirmed = said.where((F.col("confidence") == "high") | F.coalesce(F.lower(field("is_prompt")) != "false", F.lit(True)))
    purpose = F.coalesce(F.nullif(F.trim("purpose"), F.lit("")), F.nullif(F.trim(field("purpose")), F.lit("")))
    return kept.unionByName(confirmed.select("id", confidence.alias("confidence"), purpose.alias("purpose")))


def expand_cases_llm(seeds: DataFrame, backend: ChatBackend, n: int, shapes: DataFrame | None = None) -> DataFrame:
    """Exactly ``n`` new cases a site: those a model lists, filled up by boundary cases (Q9).

    With ``shapes`` ``(site, function, args, doc)``, as K9 finds them, the model also reads how the site's code takes
    its inputs; a site without one is asked as before.
    """
    sent = F.concat(F.lit(f"Write {n} more cases as a JSON array. Seed: "), C.canonical_json(F.col("inputs")))
    if shapes is not None:
        seeds = seeds.join(shapes, "site", "left")
        around = F.concat(F.lit("\n\nTaken by "), "function", F.lit("("), F.array_join("args", ", "), F.lit(")"), F.coalesce(F.concat(F.lit(": "), F.nullif("doc", F.lit(""))), F.lit("")))
        sent = F.concat(sent, F.coalesce(around, F.lit("")))
    said = call_model(seeds.select("site", F.to_json("inputs").alias("_seed"), sent.alias("_ask")), F.col("_ask"), backend, 0.7, 2048)
    listed = said.select("site", F.from_json("_seed", "map<string,string>").alias("seed"), F.posexplode(C.json_objects(F.col("reply"))).alias("pos", "item"))
    return C.expand_cases(seeds.select("site", "inputs"), listed.select("site", "pos", C.case_inputs(F.col("item"), F.col("seed")).alias("inputs")), n)


def generate_cases(mode: str, seeds: DataFrame, mined: DataFrame, backend: ChatBackend, n: int, shapes: DataFrame | None = None) -> DataFrame:
    """``(site, k, case_id, origin)`` by mode.

    ``seed`` takes the stored cases, ``fixtures`` the mined ones, ``expand`` a model's, and ``context`` a model's that has
    read the sites' ``shapes`` (K9); that mode needs them.
    """
    if mode not in ("seed", "fixtures", "expand", "context"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "context" and shapes is None:
        raise ValueError("mode context needs shapes")
    if mode in ("expand", "context"):
        return expand_cases_llm(seeds, backend, n, shapes if mode == "context" else None)
    of = (seeds.withColumn("pos", F.lit(0)) if mode == "seed" else mined).withColumn("case_id", C.case_id(F.col("site"), F.col("inputs")))
    once = of.groupBy("site", "case_id").agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("site").orderBy("pos", "case_id")) - 1
    return once.withColumn("k", rank).where(F.col("k") < n).select("site", "k", "case_id", F.lit(mode).alias("origin"))
