"""Queries of sources and sinks, streams, and jobs that call a model (with the backends that need none)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import inference, judging
from quillspark.plans.registry import register
from quillspark.sources import tables, tree
from quillspark.storage import new_path
from quillspark.streaming import jobs

# Sources and sinks -------------------------------------------------------------------------------


def _written_outputs(fx) -> str:
    """Outputs as JSON lines, a bucket of runs a folder, with every 7th case's line broken."""
    path = new_path(fx.spark, "outputs")
    bucket = fx.outputs.withColumn("case_index", F.col("run_id") * 10 + F.col("case_index")).withColumn("run_id", F.col("run_id") % 8)
    tables.write_outputs(bucket.where("case_index % 7 <> 0").select("run_id", "case_index", "text", "error", "input_tokens", "output_tokens"), path)
    broken = bucket.where("case_index % 7 = 0").select("run_id", F.concat(F.lit('{"case_index": '), F.col("case_index").cast("string"), F.lit(', "text"')).alias("value"))
    broken.write.mode("append").partitionBy("run_id").text(path)
    return path


register(
    "s1_read_outputs",
    """select cast(run_id % 8 as varchar) as run_id, run_id * 10 + case_index as case_index, text, error, input_tokens, output_tokens from fx_outputs where (run_id * 10 + case_index) % 7 <> 0""",
)(lambda fx: tables.read_outputs(fx.spark, _written_outputs(fx))[0].select("run_id", "case_index", "text", "error", "input_tokens", "output_tokens"))
register(
    "s2_bad_lines",
    """select cast(run_id % 8 as varchar) as run_id, '{"case_index": ' || (run_id * 10 + case_index) || ', "text"' as line from fx_outputs where (run_id * 10 + case_index) % 7 = 0""",
)(lambda fx: tables.read_outputs(fx.spark, _written_outputs(fx))[1])


def _stored_cases(fx):
    path = new_path(fx.spark, "cases")
    case = fx.prompts.select(
        F.col("id").cast("string").alias("id"), F.col("project").cast("string").alias("prompt_site_id"), F.create_map(F.lit("q"), "name").alias("inputs"),
        F.lit(None).cast("string").alias("expected"), F.array(F.lit("t")).alias("tags"), F.lit("seed").alias("source"), F.lit(None).cast("string").alias("notes"),
    )
    case.where("id % 3 <> 0").write.json(path)
    tables.append_cases(case, path, tables.read_cases(fx.spark, path))
    return tables.read_cases(fx.spark, path)


register("s3_read_cases", "select cast(id as varchar) as id, cast(project as varchar) as prompt_site_id, name as q, 'seed' as source from fx_prompts")(
    lambda fx: _stored_cases(fx).select("id", "prompt_site_id", F.col("inputs")["q"].alias("q"), "source")
)


def _appended_cases(fx):
    """Three deliveries that overlap, the later ones with copies inside; ``notes`` tells which one a stored case is from."""
    path = new_path(fx.spark, "appended")
    case = lambda rows, n: rows.select(
        F.col("id").cast("string").alias("id"), F.lit("s").alias("prompt_site_id"), F.create_map(F.lit("q"), "name").alias("inputs"),
        F.lit(None).cast("string").alias("expected"), F.array(F.lit("t")).alias("tags"), F.lit("seed").alias("source"), F.lit(str(n)).alias("notes"),
    )
    for n, rows in enumerate((fx.prompts.where("id % 3 = 1"), fx.prompts.where("id % 3 > 0"), fx.prompts), 1):
        tables.append_cases(case(rows.unionByName(rows), n), path, tables.read_cases(fx.spark, path))
    return tables.read_cases(fx.spark, path).select("id", F.col("inputs")["q"].alias("q"), "notes")


register("s4_append_cases", "select cast(id as varchar) as id, name as q, case id % 3 when 1 then '1' when 2 then '2' else '3' end as notes from fx_prompts")(_appended_cases)


def _snapshots(fx):
    path = new_path(fx.spark, "scans")
    for scan in ("1", "2"):
        tables.write_snapshot(fx.prompts.where(f"id % {scan} = 0").select("id", "name"), path, scan)
    return tables.read_snapshot(fx.spark, path, "2")


register("s5_read_snapshot", "select id, name from fx_prompts where id % 2 = 0")(_snapshots)
def _landed(fx):
    root = new_path(fx.spark, "tree")
    tree.write_tree(fx.tree_files.select(F.concat_ws("/", "project", "file").alias("file"), "content"), root)
    return tree.load_corpus(fx.spark, [f"{root}/r{k}" for k in range(3)]).withColumn("project", F.substring_index("project", "/", -1))


register(
    "s6_load_corpus",
    "select project, file, case shape when 4 then 'config' when 1 then 'env' when 6 then 'env' else 'python' end as kind, content from fx_tree_files where shape in (0, 1, 4, 6, 7)",
)(_landed)
register(
    "s7_scan_to_json",
    """select project, '{"project":' || project || ',"prompts":[' || string_agg('{"id":' || id || ',"name":"' || name || '"}', ',' order by id) || ']}' as document from fx_prompts group by 1""",
)(lambda fx: tables.scan_to_json(fx.prompts.select("project", "id", "name")))


def _table_rows(fx):
    stored = tables.Tables(fx.spark, new_path(fx.spark, "tables"))
    rows = fx.scores.select(F.col("run_id").cast("string").alias("run_id"), F.col("case_index").cast("long").alias("case_index"), "judge_kind", "judge_name", "score", F.lit(None).cast("string").alias("critique"))
    stored.append("scores", rows.where("case_index % 2 = 0"))
    stored.append("scores", rows.where("case_index % 2 = 1"))
    return stored.read("scores").drop("critique")


register("s8_tables", "select cast(run_id as varchar) as run_id, case_index, judge_kind, judge_name, score from fx_scores")(_table_rows)

# Streams -----------------------------------------------------------------------------------------


def _events(fx):
    return jobs.follow(fx.spark, f"{fx.sf_dir}/events.parquet")


def _closed(fx, log, name):
    """``log`` (with a time ``at``) written as an event log with an entry long after all others, so that every session of it is over."""
    path = new_path(fx.spark, name)
    ends = log.agg(F.max("at").alias("at")).select(*[(F.col("at") + F.expr("interval 1000 days") if c == "at" else F.lit(None).cast(t)).alias(c) for c, t in log.dtypes])
    log.unionByName(ends).write.parquet(path)
    return jobs.follow(fx.spark, path)


_STATE = "case event_type when 'signup' then 'running' when 'purchase' then 'done' when 'error' then 'failed' end"
register(
    "t1_stream_run_state",
    f"""with e as (select user_id as run_id, ts, {_STATE} as status from events where {_STATE} is not null),
         b as (select *, case when ts - lag(ts) over (partition by run_id order by ts) < interval 1 day then 0 else 1 end as new from e),
         s as (select *, sum(new) over (partition by run_id order by ts rows unbounded preceding) as k from b)
       select run_id, min(ts) as started_at, arg_max(status, (ts, status)) as status, case when arg_max(status, (ts, status)) in ('done', 'failed') then max(ts) end as finished_at from s group by run_id, k""",
)(
    lambda fx: jobs.append_all(
        jobs.stream_run_state(_closed(fx, fx.events.select(F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("at"), F.expr(_STATE).alias("status")).where("status is not null"), "states"), "1 day"), "run-state"
    ).select("run_id", "status", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("started_at", "finished_at")])
)
register(
    "t2_stream_score_windows",
    """with w as (select time_bucket(interval 1 hour, ts) as window_start, avg(value) as avg_score, count(value) as n from events group by 1)
       select window_start, window_start + interval 1 hour as window_end, avg_score, n from w where window_start + interval 1 hour <= (select max(ts) from events) - interval 1 hour""",
)(
    lambda fx: jobs.append_all(jobs.stream_score_windows(_events(fx).select(F.col("ts").alias("at"), F.col("value").alias("score")), "1 hour"), "windows").withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    )
)
register("t3_stream_dedupe", "select distinct user_id, event_type from events")(
    lambda fx: jobs.append_all(jobs.stream_dedupe_scores(_events(fx).select(F.col("ts").alias("at"), "user_id", "event_type"), ["user_id", "event_type"], "1000 days").drop("at"), "dedupe")
)
_CONVERGE = """with i as (select o_orderkey, concat(o_custkey, '-', year(o_orderdate)) as session_id, row_number() over (partition by o_custkey, year(o_orderdate) order by o_orderdate, o_orderkey) as round,
                  floor((floor(o_totalprice) % 1000) / 250) / 4 as s from orders),
     s as (select *, s - first_value(s) over w as gain, abs(s - lag(s) over w) as step, row_number() over w as n from i window w as (partition by session_id order by round)),
     c as (select *, max(step) over (partition by session_id order by round rows between 1 preceding and current row) as largest from s),
     d as (select *, case when n < 2 then null when gain >= 0.15 then 'delta' when n >= 3 and largest < 0.02 then 'stagnation' when n >= 5 then 'max_rounds' end as reason from c)
     select session_id, min(round) as stop_round, arg_min(reason, round) as reason from d where reason is not null group by 1"""


def _rounds_stream(fx):
    """The revision rounds, written as an event log and followed."""
    path = new_path(fx.spark, "rounds")
    fx.iterations.select("session_id", "round", F.col("weighted_score").cast("double").alias("weighted_score"), F.col("started_at").cast("timestamp").alias("at")).write.parquet(path)
    return jobs.follow(fx.spark, path)


register("t4_stream_convergence", _CONVERGE)(lambda fx: jobs.append_all(jobs.stream_convergence(_rounds_stream(fx)), "convergence"))
register(
    "t5_stream_budget",
    """with b as (select *, case when o_orderdate - lag(o_orderdate) over (partition by o_custkey order by o_orderdate) <= interval 200 days then 0 else 1 end as new from orders),
         s as (select *, sum(new) over (partition by o_custkey order by o_orderdate rows unbounded preceding) as k from b)
       select o_custkey as target_id, min(o_orderdate) as started_at, max(o_orderdate) + interval 200 days as ended_at, round(sum(o_totalprice), 2) as cost_usd from s group by o_custkey, k having sum(o_totalprice) > 1000000""",
)(
    lambda fx: jobs.append_all(
        jobs.stream_budget(
            _closed(fx, fx.orders.select(F.col("o_custkey").alias("target_id"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_totalprice").alias("cost_usd")), "costs"), "target_id", 1e6, "200 days"
        ),
        "budget",
    ).select("target_id", F.round("cost_usd", 2).alias("cost_usd"), *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("started_at", "ended_at")])
)


def _merged_stream(fx):
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp")
    stored = fx.prompts.where("id % 3 <> 0").select("id", "name", stamp.alias("first_seen_at"), stamp.alias("last_seen_at"))
    new = jobs.follow(fx.spark, f"{fx.sf_dir}/customer.parquet").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("id"), F.concat(F.lit("NEW_"), F.col("c_custkey").cast("string")).alias("name"))
    return jobs.stream_merge_snapshot(new, stored, "2024-02-02 00:00:00", new_path(fx.spark, "merge"))


register(
    "t6_stream_merge_snapshot",
    """select id, case when id % 4 <> 0 then 'NEW_' || id else name end as name, case when id % 3 <> 0 then '2024-01-01' else '2024-02-02' end as first_seen, case when id % 4 <> 0 then '2024-02-02' else '2024-01-01' end as last_seen
       from fx_prompts where id % 3 <> 0 or id % 4 <> 0""",
)(
    lambda fx: _merged_stream(fx).select(
        "id", "name", F.date_format("first_seen_at", "yyyy-MM-dd").alias("first_seen"), F.date_format("last_seen_at", "yyyy-MM-dd").alias("last_seen")
    )
)

# Calls of a model --------------------------------------------------------------------------------


def _matrix(fx):
    values = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source", F.lit("body"), "body")
    return fx.cases.select("case_id", "template", values.alias("inputs"))


_SENT = "'Summarise ' || lang || ' text from ' || source || ': ' || body || ' {missing}'"
_RAN = f"""r as (select case_id, {_SENT} as sent, case when contains({_SENT}, 'the') then null else 'echo: ' || {_SENT} end as text from fx_cases)"""
_BACKEND = inference.EchoBackend(fail_on="the")
register(
    "u1_run_prompts",
    f"""with {_RAN} select case_id, text, case when text is null then 'RuntimeError: refused' end as error, cast(case when text is null then 0 else greatest(1, floor(length(sent) / 4)) end as bigint) as input_tokens,
       cast(case when text is null then 0 else greatest(1, floor(length(text) / 4)) end as bigint) as output_tokens from r""",
)(lambda fx: inference.run_prompts(_matrix(fx), _BACKEND, ["case_id"]))
_NL2 = "chr(10) || chr(10)"


def _judge_sql(dims: str, names: str, shown: str) -> str:
    """What a judge reads, in SQL."""
    return f"""concat_ws({_NL2}, 'Purpose of the prompt: (not stated)', 'Score the output from 0 to 1 on each of these dimensions:', '{dims}', 'Output:', {shown},
      'Reply with one JSON object: a number for each of {names}, and a text "critique".')"""


_DEFAULT_DIMS = '[{"name": "accuracy", "weight": 0.4}, {"name": "relevance", "weight": 0.3}, {"name": "safety", "weight": 0.15}, {"name": "format", "weight": 0.15}]'
_DEFAULT_NAMES = "accuracy, relevance, safety, format"
_SHOWN = "case when text is not null then cast(json_object('text', text) as varchar) else cast(json_object('error', 'RuntimeError: refused') as varchar) end"
register(
    "u4_judge_outputs",
    f"""with {_RAN}, n as (select case_id, length({_judge_sql(_DEFAULT_DIMS, _DEFAULT_NAMES, _SHOWN)}) as n from r)
       select case_id, round((n % 5) / 4.0::double * 0.4::double + ((n + 1) % 5) / 4.0::double * 0.3::double + ((n + 2) % 5) / 4.0::double * 0.15::double + ((n + 3) % 5) / 4.0::double * 0.15::double, 9) as weighted_total, 'length ' || n as critique from n""",
)(lambda fx: inference.judge_outputs(inference.run_prompts(_matrix(fx), _BACKEND, ["case_id"]), judging.DEFAULT_DIMENSIONS, inference.ScoringBackend(), ["case_id"]))
register(
    "u3_validate_runs",
    """with q as (select id as run_id, id % 97 as pipeline_id, case id % 4 when 0 then 'node' when 1 then 'segment' when 2 then 'end_to_end' else 'all' end as mode, case when id % 3 = 0 then id end as node, case when id % 5 = 0 then [id, id + 1] end as seg from fx_prompts),
         a as (select run_id, pipeline_id, node as n from q where node is not null union select run_id, pipeline_id, unnest(seg) from q), u as (select distinct run_id from a where not exists (select 1 from fx_nodes x where x.pipeline_id = a.pipeline_id and x.prompt_id = a.n))
       select q.run_id, concat_ws(';', case when mode = 'all' then 'unknown mode' end, case when mode = 'node' and node is null then 'node mode needs a node' end, case when mode = 'node' and seg is not null then 'node mode takes no segment' end,
         case when mode = 'segment' and seg is null then 'segment mode needs a segment' end, case when mode = 'end_to_end' and (seg is not null or node is not null) then 'end_to_end takes neither' end, case when u.run_id is not null then 'unknown node' end) as errors
       from q left join u on u.run_id = q.run_id""",
)(
    lambda fx: inference.validate_runs(
        fx.prompts.selectExpr(
            "id as run_id", "id % 97 as pipeline_id", "case id % 4 when 0 then 'node' when 1 then 'segment' when 2 then 'end_to_end' else 'all' end as mode",
            "case when id % 3 = 0 then id end as node", "case when id % 5 = 0 then array(id, id + 1) end as segment",
        ),
        fx.nodes.withColumnRenamed("prompt_id", "node"),
    )
)
register(
    "u6_revise",
    """select id as prompt_id, case id % 3 when 0 then case when id % 2 = 0 then 'hint ' || id end when 1 then 'T' || id end as template,
         case id % 3 when 0 then case when id % 2 = 0 then 'manual edit' end when 1 then 'why' end as rationale, case id % 3 when 0 then case when id % 2 = 0 then 'ok' else 'no_instruction' end when 1 then 'ok' else 'unparseable' end as status from fx_prompts""",
)(
    lambda fx: inference.revise(
        fx.prompts.selectExpr(
            "id as prompt_id", "case id % 3 when 0 then 'manual' else 'auto' end as mode",
            """case id % 3 when 1 then concat('x {"revised_template": "T', id, '", "rationale": "why"}') else 'x' end as template""", "'' as block", "case when id % 2 = 0 then concat('hint ', id) end as instruction",
        ),
        _LastObject(),
    )
)


def _piped(fx):
    """Every prompt as the first of three nodes of a pipeline of its own."""
    return fx.prompts.select((F.col("id") * 4).alias("id"), "name")


_LINE = "with recursive p(pipeline_id, node, case_index, text) as (select id, id, 0, 'echo: start ' || name from (select id * 4 as id, name from fx_prompts) f union all select p.pipeline_id, p.node + 1, p.case_index, 'echo: next ' || p.text from p where p.node % 4 < 2)"
register("u2_run_pipelines", f"{_LINE} select node, case_index, text, null::varchar as error from p")(
    lambda fx: (
        lambda ids: inference.run_pipelines(
            ids.selectExpr("pipe as pipeline_id", "node", "case when node % 4 = 0 then 'start {name}' else 'next {before}' end as template"),
            ids.where("node % 4 > 0").selectExpr("node - 1 as src", "node as dst", "'before' as via", "0 as pos"),
            _piped(fx).select(F.col("id").alias("pipeline_id"), F.lit(0).alias("case_index"), F.create_map(F.lit("name"), "name").alias("inputs")),
            inference.EchoBackend(),
        ).select("node", "case_index", "text", "error")
    )(_piped(fx).select(F.col("id").alias("pipe"), F.explode(F.sequence("id", F.col("id") + 2)).alias("node")))
)
_MODES = "case id % 12 when 0 then 'node' when 4 then 'segment' else 'end_to_end' end"
register(
    "u2_run_modes",
    f"""with recursive q as (select id, name, {_MODES} as mode from (select id * 4 as id, name from fx_prompts) f),
         n as (select q.*, id + k as node, k from q cross join (values (0), (1), (2)) v(k) where mode = 'end_to_end' or (mode = 'node' and k = 1) or (mode = 'segment' and k > 0)),
         p(id, node, k, text) as (select id, node, k, case when k = 0 then 'echo: start ' || name else 'echo: next {{before}}' end from n where k = 0 or (mode <> 'end_to_end' and k = 1)
           union all select p.id, n.node, n.k, 'echo: next ' || p.text from p join n on n.id = p.id and n.k = p.k + 1)
       select id as pipeline_id, node, text from p""",
)(
    lambda fx: (
        lambda ids: inference.run_pipelines(
            ids.selectExpr("pipe as pipeline_id", "node", "case when node % 4 = 0 then 'start {name}' else 'next {before}' end as template"),
            ids.where("node % 4 > 0").selectExpr("node - 1 as src", "node as dst", "'before' as via", "0 as pos"),
            _piped(fx).select(F.col("id").alias("pipeline_id"), F.lit(0).alias("case_index"), F.create_map(F.lit("name"), "name").alias("inputs")),
            inference.EchoBackend(),
            _piped(fx).selectExpr(
                "id as pipeline_id", f"{_MODES} as mode", "case when id % 12 = 0 then id + 1 end as node", "case when id % 12 = 4 then array(id + 1, id + 2) end as segment"
            ),
        ).select("pipeline_id", "node", "text")
    )(_piped(fx).select(F.col("id").alias("pipe"), F.explode(F.sequence("id", F.col("id") + 2)).alias("node")))
)
register(
    "u8_iterate_sessions",
    """with r as (select prompt_id as session_id, cast(n as int) as round, template || repeat(' Again.', n - 1) as template from fx_prompt_versions cross join (values (1), (2), (3), (4), (5)) v(n) where version = 1),
         k as (select id as session_id, cast(id as varchar) as question from fx_feedback),
         j as (select r.session_id, round, length(""" + _judge_sql(_DEFAULT_DIMS, _DEFAULT_NAMES, """'{"text":"echo: ' || replace(template, '{question}', question) || '"}'""") + """) as n
               from r join k on k.session_id = r.session_id),
         m as (select session_id, round, round(avg(round(n % 5 / 4.0::double * 0.4::double + (n + 1) % 5 / 4.0::double * 0.3::double + (n + 2) % 5 / 4.0::double * 0.15::double + (n + 3) % 5 / 4.0::double * 0.15::double, 9)), 9) as score from j group by 1, 2),
         c as (select r.session_id, r.round, r.template, coalesce(m.score, 0.0::double) as weighted_score from r left join m on m.session_id = r.session_id and m.round = r.round),
         w as (select *, first_value(weighted_score) over p as first_score, abs(weighted_score - lag(weighted_score) over p) as step from c window p as (partition by session_id order by round)),
         d as (select *, case when round < 2 then null when weighted_score - first_score >= 0.15 then 'delta'
                 when round >= 3 and max(step) over (partition by session_id order by round rows between 1 preceding and current row) < 0.02 then 'stagnation' when round >= 5 then 'max_rounds' end as reason from w),
         e as (select session_id, min(round) as stop from d where reason is not null group by 1)
       select d.session_id, d.round, d.template, d.weighted_score, 'auto' as revise_mode, d.reason from d join e on e.session_id = d.session_id where d.round <= e.stop""",
)(
    lambda fx: inference.iterate_sessions(
        fx.prompt_versions.where("version = 1").select(F.col("prompt_id").alias("session_id"), "template"),
        fx.feedback.select((F.col("run_id") / 2).cast("long").alias("session_id"), "case_index", F.create_map(F.lit("question"), F.col("id").cast("string")).alias("inputs")),
        judging.DEFAULT_DIMENSIONS, inference.EchoBackend(), inference.ScoringBackend(), _Longer(),
    )
)
register(
    "x26_prompt_texts",
    "select run_id, case_index, "
    + _judge_sql(
        '[{"name": "accuracy", "weight": 0.5, "rubric": "right"}, {"name": "relevance", "weight": 0.5, "rubric": "to the point"}]', "accuracy, relevance",
        "coalesce(text, '(no output)'), 'Reference, to hold the output against:' || chr(10) || chr(10) || model",
    ).replace("(not stated)", "' || provider || '")
    + """ as judge,
         concat_ws(chr(10) || chr(10), 'Improve the template by the feedback.', 'Name: ' || provider, 'Purpose: ' || coalesce(text, '(not stated)'), 'Template: ' || provider, 'Feedback:' || chr(10) || case when case_index % 2 = 0 then 'seen by ' || model else '(none this round)' end,
           'Weights: """
    + _DEFAULT_DIMS
    + """', 'Instruction, to be followed: ' || error, 'Reply with one JSON object with "revised_template" and "rationale".') as critic
       from fx_outputs""",
)(
    lambda fx: fx.outputs.select(
        "run_id", "case_index",
        inference.judge_prompt([("accuracy", 0.5, "right"), ("relevance", 0.5, "to the point")], F.col("text"), F.col("provider"), F.col("model")).alias("judge"),
        inference.critic_prompt(
            F.col("provider"), F.when(F.col("case_index") % 2 == 0, F.concat(F.lit("seen by "), "model")).otherwise(""), F.col("error"), name=F.col("provider"), purpose=F.col("text")
        ).alias("critic"),
    )
)
register(
    "u9_enrich_sites",
    """select id, case when confidence = 'high' then 'high' when id % 2 = 0 then 'high' else 'medium' end as confidence, coalesce(nullif(trim(purpose), ''), 'p' || id) as purpose from fx_prompts where confidence = 'high' or id % 7 <> 1""",
)(
    lambda fx: inference.enrich_sites(
        fx.prompts.select("id", "confidence", "purpose", F.expr("""concat('{"is_prompt": ', id % 7 <> 1, ', "confidence": "', case when id % 2 = 0 then 'high' else 'low' end, '", "purpose": "p', id, '"}')""").alias("text")),
        _LastObject(),
    )
)
register(
    "u10_expand_cases_llm",
    """with s as (select id as site, name as q from fx_prompts), m as (select site, t.k, case when t.k = 0 then 'echo' when t.k = 1 then '' when t.k = 2 then 'a' end as v, case when t.k = 0 then 'model' else 'boundary' end as origin from s cross join (values (0), (1), (2)) t(k))
       select site, k, substr(sha1(concat(cast(site as varchar), chr(0), case when k = 0 then '{"q":"new"}' when k = 1 then '{"q":"a"}' else '{"q":"   "}' end)), 1, 12) as case_id, origin from m""",
)(lambda fx: inference.expand_cases_llm(fx.prompts.select(F.col("id").alias("site"), F.create_map(F.lit("q"), "name").alias("inputs")), _OneCase(), 3))
register(
    "u11_generate_cases",
    """select id as site, 0 as k, substr(sha1(concat(cast(id as varchar), chr(0), '{"q":"', name, '"}')), 1, 12) as case_id, 'seed' as origin from fx_prompts""",
)(
    lambda fx: (lambda s: inference.generate_cases("seed", s, s, _OneCase(), 3))(fx.prompts.select(F.col("id").alias("site"), F.create_map(F.lit("q"), "name").alias("inputs")))
)


register(
    "u11_context_cases",
    """with s as (select id as site, name as q, case when id % 2 = 0 then 'f' || id end as f from fx_prompts),
         m as (select *, '{"q":"' || case when f is not null then f || '(q: str, n)' || case when site % 4 = 0 then ': Asks.' else '' end else 'none' end || '"}' as found from s)
       select site, t.k, substr(sha1(concat(cast(site as varchar), chr(0), case when t.k = 0 then found else '{"q":"a"}' end)), 1, 12) as case_id, case when t.k = 0 then 'model' else 'boundary' end as origin
       from m cross join (values (0), (1)) t(k)""",
)(
    lambda fx: (
        lambda s: inference.generate_cases(
            "context", s, s, _Shape(), 2,
            fx.prompts.where("id % 2 = 0").select(
                F.col("id").alias("site"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("function"), F.array(F.lit("q: str"), F.lit("n")).alias("args"), F.when(F.col("id") % 4 == 0, "Asks.").otherwise("").alias("doc")
            ),
        )
    )(fx.prompts.select(F.col("id").alias("site"), F.create_map(F.lit("q"), "name").alias("inputs")))
)


class _Shape:
    """A backend that lists one case: the function that its prompt names."""

    def chat(self, prompt: str, temperature: float, max_tokens: int) -> str:
        return inference.json.dumps([{"inputs": {"q": prompt.split("Taken by ", 1)[1] if "Taken by " in prompt else "none"}}])


class _LastObject:
    """A backend that answers with the JSON object of its prompt's last lines."""

    def chat(self, prompt: str, temperature: float, max_tokens: int) -> str:
        at = max(prompt.find('{"revised'), prompt.find('{"is_prompt": '))
        return prompt[at : prompt.find("}", at) + 1] if at >= 0 else "nothing"


class _Longer:
    """A critic that puts one more sentence behind the template."""

    def chat(self, prompt: str, temperature: float, max_tokens: int) -> str:
        template = prompt.split("Template: ", 1)[1].split("\n\n", 1)[0]
        return inference.json.dumps({"revised_template": f"{template} Again.", "rationale": "longer"})


class _OneCase:
    """A backend that lists one case."""

    def chat(self, prompt: str, temperature: float, max_tokens: int) -> str:
        return '[{"inputs": {"q": "new"}}]'
