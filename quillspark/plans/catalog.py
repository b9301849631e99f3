"""The registered queries of the prompt-operations library, each with SQL for an independent engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.fixtures import Fixtures
from quillspark.functions import text as X
from quillspark.operators import graph, integrity, iterations, scores, select, versions
from quillspark.plans.registry import oracle_sql, queries, register
from quillspark.sources.prices import price_book, price_book_sql

__all__ = ["oracle_sql", "queries"]

# Projections and filters -------------------------------------------------------------------------

register("p1_list_prompts", "select id, name, provider, confidence from fx_prompts where name = 'prompt_7'")(
    lambda fx: select.list_prompts(fx.prompts, "prompt_7").select("id", "name", "provider", "confidence")
)
register("p2_run_rows", "select run_id, case_index, judge_kind, judge_name, score from fx_scores where run_id = 7")(
    lambda fx: select.rows_for(fx.scores, 7)
)
register(
    "p3_prompt_summary",
    """select p.id, p.name, p.provider, p.file, p.line, p.purpose, p.confidence, cast(coalesce(v.v, 0) as bigint) as latest_version
       from fx_prompts p left join (select prompt_id, max(version) as v from fx_prompt_versions group by 1) v on v.prompt_id = p.id""",
)(lambda fx: select.prompt_summary(fx.prompts, versions.latest_version(fx.prompts, fx.prompt_versions)))


def _messages(fx: Fixtures) -> DataFrame:
    message = lambda role, text: F.struct(F.lit(role).alias("role"), F.col(text).alias("template_text"))
    order = F.when(F.col("id") % 2 == 0, F.array(message("system", "system_text"), message("user", "user_text")))
    return fx.prompts.withColumn("messages", order.otherwise(F.array(message("user", "user_text"), message("system", "system_text"))))


register(
    "p4_template_text",
    "select id, case when id % 2 = 0 then concat(system_text, chr(10), user_text) else concat(user_text, chr(10), system_text) end as template_text from fx_prompts",
)(lambda fx: _messages(fx).select("id", select.template_text(F.col("messages")).alias("template_text")))
register(
    "p5_needs",
    """select id, confidence <> 'high' as needs_check, template_kind = 'unresolved' as needs_resolve, purpose is null or trim(purpose) = '' as needs_purpose from fx_prompts""",
)(lambda fx: select.needs(fx.prompts))
register("p6_real_rounds", "select id, session_id, round from fx_iterations where round > 0")(
    lambda fx: iterations.real_rounds(fx.iterations).select("id", "session_id", "round")
)
register(
    "p7_resolve_refs",
    """with refs as (select distinct case when id % 2 = 0 then cast(id as varchar) else name end as ref from fx_prompts union select 'nobody')
       select r.ref, coalesce(a.id, b.id) as prompt_id from refs r left join fx_prompts a on cast(a.id as varchar) = r.ref
       left join (select name, min(id) as id from fx_prompts group by 1) b on b.name = r.ref""",
)(
    lambda fx: select.resolve_prompt_refs(
        fx.prompts.select(F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).otherwise(F.col("name")).alias("ref"))
        .union(fx.spark.range(1).select(F.lit("nobody")))
        .distinct(),
        fx.prompts,
    )
)
register(
    "p8_revise_messages",
    "select id, case when id % 2 = 0 then concat('NEW', chr(10), user_text) else concat(user_text, chr(10), 'NEW') end as template_text from fx_prompts",
)(lambda fx: _messages(fx).select("id", select.template_text(select.revise_messages(F.col("messages"), F.lit("NEW"))).alias("template_text")))

# Joins -------------------------------------------------------------------------------------------

register(
    "j1_scores_with_runs",
    "select s.run_id, s.case_index, s.judge_kind, s.judge_name, s.score, r.target_id as prompt_id, r.target_version as version from fx_scores s join fx_runs r on r.run_id = s.run_id",
)(lambda fx: scores.scores_with_runs(fx.scores, fx.runs))
register(
    "j4_pipeline_site_index",
    """select pipeline_id, string_agg(e, ';' order by e) as sites from (
         select distinct n.pipeline_id, concat(lpad(cast(n.prompt_id as varchar), 12, '0'), '=', p.name) as e from fx_nodes n join fx_prompts p on p.id = n.prompt_id) t
       group by pipeline_id""",
)(lambda fx: select.pipeline_site_index(fx.nodes, fx.prompts))
register("j5_missing_nodes", "select prompt_id, pipeline_id from fx_nodes n where not exists (select 1 from fx_prompts p where p.id = n.prompt_id)")(
    lambda fx: select.missing_nodes(fx.nodes, fx.prompts)
)
register(
    "j6_price_usage",
    f"""with pb as ({price_book_sql()}) select o.*, o.input_tokens * pb.usd_in / 1000.0::double + o.output_tokens * pb.usd_out / 1000.0::double as cost_usd, pb.usd_in is not null as priced
       from fx_outputs o left join pb on pb.provider = o.provider and pb.model = o.model""",
)(lambda fx: scores.price_usage(fx.outputs, price_book(fx.spark)))
register(
    "s9_prices_of_runs",
    f"""with pb as ({price_book_sql()}) select pb.provider, pb.model, usd_in, usd_out, count(o.run_id) as outputs from pb left join fx_outputs o on o.provider = pb.provider and o.model = pb.model group by all""",
)(
    lambda fx: price_book(fx.spark)
    .join(fx.outputs.groupBy("provider", "model").agg(F.count("run_id").alias("_n")), ["provider", "model"], "left")
    .select("provider", "model", "usd_in", "usd_out", F.coalesce("_n", F.lit(0)).alias("outputs"))
)
register(
    "x16_roles",
    """select event_id as id, case event_type when 'signup' then 'user' when 'purchase' then 'assistant' when 'error' then 'tool' when 'view' then 'system' else 'click' end as role from events""",
)(
    lambda fx: fx.events.select(
        F.col("event_id").alias("id"), X.role(F.expr("case event_type when 'signup' then 'Human' when 'purchase' then 'ai' when 'error' then 'function' when 'view' then 'SYSTEM' else event_type end")).alias("role")
    )
)
register(
    "j8_price_mismatch",
    f"""with pb as ({price_book_sql()}), u as (select distinct provider, model from fx_outputs)
       select u.provider, u.model, (select min(provider) from pb where pb.model = u.model) as priced_by from u
       where not exists (select 1 from pb where pb.provider = u.provider and pb.model = u.model)""",
)(lambda fx: scores.price_mismatch(fx.outputs, price_book(fx.spark)))
register("j12_pipeline_of_prompt", "select prompt_id, min(pipeline_id) as pipeline_id from fx_nodes group by 1")(lambda fx: select.pipeline_of_prompt(fx.nodes))
register(
    "j13_valid_edges",
    "select src, dst, kind, confidence, detector from fx_edges where src in (select id from fx_prompts where id % 3 <> 0) and dst in (select id from fx_prompts where id % 3 <> 0)",
)(lambda fx: select.valid_edges(fx.edges, fx.prompts.where("id % 3 <> 0")))

# Aggregations ------------------------------------------------------------------------------------

register("a1_avg_score_by_run", "select run_id, avg(score) as avg_score from fx_scores group by 1")(lambda fx: scores.avg_score_by_run(fx.scores))
register(
    "a2_avg_score_by_version",
    "select r.target_id as prompt_id, r.target_version as version, avg(s.score) as avg_score from fx_scores s join fx_runs r on r.run_id = s.run_id group by 1, 2",
)(lambda fx: scores.avg_score_by_version(fx.scores, fx.runs))
register(
    "a3_run_metrics",
    """select run_id, count(*) as n_cases, count(error) as n_errors, cast(sum(case when error is null then input_tokens else 0 end) as bigint) as input_tokens,
       cast(sum(case when error is null then output_tokens else 0 end) as bigint) as output_tokens from fx_outputs group by 1""",
)(lambda fx: scores.run_metrics(fx.outputs))
register(
    "a6_round_score",
    "select r.run_id, coalesce(avg(s.score), 0) as round_score from fx_runs r left join fx_scores s on s.run_id = r.run_id group by 1",
)(lambda fx: scores.round_score(fx.runs, fx.scores, "run_id"))
register(
    "a9_worst_critique",
    """select run_id, case when length(critique) <= 12 then critique else concat(substr(critique, 1, 11), '…') end as critique from (
         select *, row_number() over (partition by run_id order by rating, case_index, id) as k from fx_feedback where length(trim(critique)) > 0) t where k = 1""",
)(lambda fx: scores.worst_critique(fx.feedback, 12))
register(
    "a10_enrichment_estimate",
    """select *, (n_check + n_resolve + n_purpose) * 0.002::double as cost_usd from (
         select project, count(*) filter (confidence <> 'high') as n_check, count(*) filter (template_kind = 'unresolved') as n_resolve,
         count(*) filter (coalesce(trim(purpose), '') = '') as n_purpose from fx_prompts group by 1) t""",
)(lambda fx: scores.enrichment_estimate(fx.prompts))
register(
    "a13_latest_version",
    "select p.id, cast(coalesce(max(v.version), 0) as bigint) as latest_version from fx_prompts p left join fx_prompt_versions v on v.prompt_id = p.id group by 1",
)(lambda fx: versions.latest_version(fx.prompts, fx.prompt_versions))
register(
    "a15_feedback_summary",
    "select run_id, count(*) as n, count(*) filter (rating = 1) as n_up, count(*) filter (rating = 0) as n_neutral, count(*) filter (rating = -1) as n_down from fx_feedback group by 1",
)(lambda fx: scores.feedback_summary(fx.feedback))
register("a17_over_budget", "select target_id, sum(cost_usd) as cost_usd from fx_runs group by 1 having sum(cost_usd) > 1")(
    lambda fx: scores.over_budget(fx.runs, "target_id", 1.0)
)

# Windows and limits ------------------------------------------------------------------------------

_CONVERGE = """with s as (select *, weighted_score - first_value(weighted_score) over w as gain, abs(weighted_score - lag(weighted_score) over w) as step, row_number() over w as n
                  from fx_iterations window w as (partition by session_id order by round)),
     c as (select *, max(step) over (partition by session_id order by round rows between 1 preceding and current row) as largest from s),
     d as (select *, case when n < 2 then null when gain >= 0.15 then 'delta' when n >= 3 and largest < 0.02 then 'stagnation' when n >= 5 then 'max_rounds' end as reason from c),
     st as (select session_id, min(round) as stop_round, arg_min(reason, round) as reason from d where reason is not null group by 1)"""

register("w1_head_versions", "select * from fx_prompt_versions v where version = (select max(version) from fx_prompt_versions x where x.prompt_id = v.prompt_id)")(
    lambda fx: versions.head_versions(fx.prompt_versions)
)
register("w2_convergence", f"{_CONVERGE} select session_id, round, reason from d")(
    lambda fx: iterations.check_convergence(fx.iterations).select("session_id", "round", "reason")
)
register("w3_stop_round", f"{_CONVERGE} select * from st")(lambda fx: iterations.stop_round(fx.iterations))
register(
    "a14_session_summary",
    f"""{_CONVERGE}, g as (select session_id, min(started_at) as started_at, count(*) as n_rounds, arg_max(weighted_score, round) as last_score, bool_or(revise_mode = 'failed') as failed
        from fx_iterations group by 1)
     select g.session_id, g.started_at, g.n_rounds, g.last_score, st.reason, case when failed then 'failed' when reason is not null then 'converged' else 'running' end as status
     from g left join st on st.session_id = g.session_id""",
)(lambda fx: iterations.session_summary(fx.iterations))
register(
    "w4_dedupe_edges",
    """select src, dst, kind, confidence, detector from (select *, row_number() over (partition by src, dst, kind
         order by case confidence when 'high' then 0 when 'medium' then 1 else 2 end, detector) as k from fx_edges) t where k = 1""",
)(lambda fx: select.dedupe_edges(fx.edges))


def _dims(fx: Fixtures) -> DataFrame:
    weight = F.when(F.col("judge_kind") == "llm", 0.5).when(F.col("judge_kind") == "rule", 0.3).otherwise(0.2)
    return fx.scores.where("score is not null").select(F.col("run_id").alias("session_id"), F.col("judge_kind").alias("dimension"), weight.alias("weight"), "score")


register(
    "w6_weakest_dimensions",
    """select session_id, dimension, impact, cast(rank as int) as rank from (
         select *, row_number() over (partition by session_id order by impact desc, dimension) as rank from (
           select run_id as session_id, judge_kind as dimension, round((1 - avg(score)) * max(case judge_kind when 'llm' then 0.5::double when 'rule' then 0.3::double else 0.2::double end), 9) as impact
           from fx_scores where score is not null group by 1, 2) a where impact > 0) t where rank <= 2""",
)(lambda fx: scores.weakest_dimensions(_dims(fx)))
register(
    "w8_latest_run_state",
    """select user_id as run_id, arg_max(status, (ts, status)) as status, case when arg_max(status, (ts, status)) in ('done', 'failed') then max(ts) end as finished_at from (
         select user_id, ts, case event_type when 'signup' then 'running' when 'purchase' then 'done' when 'error' then 'failed' end as status from events
         where event_type in ('signup', 'purchase', 'error')) t group by 1""",
)(lambda fx: iterations.latest_run_state(run_events(fx.events)))
register("w10_latest_iteration", "select id, prompt_id, session_id from (select *, row_number() over (partition by prompt_id order by started_at desc, id desc) as k from fx_iterations) t where k = 1")(
    lambda fx: iterations.latest_iteration(fx.iterations).select("id", "prompt_id", "session_id")
)
register(
    "w11_version_history",
    """with a as (select r.target_id as prompt_id, r.target_version as version, avg(s.score) as avg_score from fx_scores s join fx_runs r on r.run_id = s.run_id group by 1, 2)
       select v.prompt_id, v.version, v.created_at, v.created_by, a.avg_score, a.avg_score - lag(a.avg_score) over (partition by v.prompt_id order by v.version) as change
       from fx_prompt_versions v left join a on a.prompt_id = v.prompt_id and a.version = v.version""",
)(lambda fx: versions.version_history(fx.prompt_versions, fx.scores, fx.runs))
register(
    "w12_allocate_versions",
    """select f.prompt_id, f.id, cast(coalesce(h.v, 0) + row_number() over (partition by f.prompt_id order by f.id) as bigint) as version
       from (select id, run_id as prompt_id from fx_feedback) f left join (select prompt_id, max(version) as v from fx_prompt_versions group by 1) h on h.prompt_id = f.prompt_id""",
)(lambda fx: versions.allocate_versions(fx.feedback.select("id", F.col("run_id").alias("prompt_id")), fx.prompt_versions, "id"))
register("w14_file_anchor", "select file, arg_min(id, (line, id)) as anchor from fx_prompts group by 1")(lambda fx: select.file_anchor(fx.prompts))
register("l1_newest_runs", "select * from fx_runs order by started_at desc, run_id desc limit 200")(lambda fx: select.newest_runs(fx.runs, 5000))
register("l2_session_rounds", "select id, session_id, round from fx_iterations where session_id = (select min(session_id) from fx_iterations)")(
    lambda fx: iterations.session_rounds(fx.iterations, fx.iterations.agg(F.min("session_id")).first()[0]).select("id", "session_id", "round")
)
register("l3_newest_iterations", "select id, prompt_id from (select *, row_number() over (partition by prompt_id order by started_at desc, id desc) as k from fx_iterations) t where k <= 3")(
    lambda fx: iterations.newest_iterations(fx.iterations, 3).select("id", "prompt_id")
)
register("l4_score_listing", "select run_id, case_index, judge_kind, judge_name, score from fx_scores order by 1, 2, 3, 4")(lambda fx: select.score_listing(fx.scores))
register("l4_feedback_listing", "select id, run_id, case_index, rating, critique, created_at from fx_feedback order by run_id, id")(lambda fx: select.feedback_listing(fx.feedback))
register("l4_version_listing", "select prompt_id, version, created_by, template from fx_prompt_versions order by 1, 2")(
    lambda fx: select.version_listing(fx.prompt_versions).select("prompt_id", "version", "created_by", "template")
)
register("l5_first_cases", "select case_id, prompt_id from (select *, row_number() over (partition by prompt_id order by case_id) as k from fx_cases) t where k <= 5")(
    lambda fx: select.first_cases(fx.cases, 5).select("case_id", "prompt_id")
)

# Set operations and integrity --------------------------------------------------------------------

register("q1_fresh_cases", "select distinct run_id as id from fx_feedback where run_id not in (select run_id from fx_runs)")(
    lambda fx: integrity.fresh_cases(fx.feedback.select(F.col("run_id").alias("id")), fx.runs.select(F.col("run_id").alias("id")))
)
register(
    "q2_add_evidence",
    """select run_id, rating, arg_min(id, (created_at, id)) as id, min(created_at) as created_at from fx_feedback group by 1, 2""",
)(
    lambda fx: (lambda f: integrity.add_evidence(f.where("id % 2 = 0"), f.where("id % 2 = 1"), ["run_id", "rating"], "created_at"))(
        fx.feedback.select("run_id", "rating", "id", "created_at")
    )
)
register("q3_key_violations", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")(
    lambda fx: integrity.key_violations(fx.lineitem, ["l_orderkey", "l_linenumber"])
)
register(
    "q4_domain_violations",
    """select * from (select run_id, status, cost_usd, concat_ws(',', case when status is null or status not in ('done', 'running') then 'status' end,
         case when not (cost_usd between 0 and 0.3) then 'cost_usd' end) as violations from fx_runs) t where violations <> ''""",
)(lambda fx: integrity.domain_violations(fx.runs.select("run_id", "status", "cost_usd"), {"status": ["done", "running"]}, {"cost_usd": (0, 0.3)}))


def _scans(fx: Fixtures) -> tuple[DataFrame, DataFrame]:
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    old = fx.prompts.where("id % 3 <> 0").select("id", "name", stamp.alias("first_seen_at"), stamp.alias("last_seen_at"))
    return old, fx.prompts.where("id % 4 <> 0").select("id", F.upper("name").alias("name"))


register(
    "q5_merge_snapshot",
    """with o as (select id, name from fx_prompts where id % 3 <> 0), n as (select id, upper(name) as name from fx_prompts where id % 4 <> 0)
       select coalesce(n.id, o.id) as id, coalesce(n.name, o.name) as name, case when o.id is null then 'inserted' when n.id is null then 'kept' else 'updated' end as action,
       case when o.id is null then '2024-02-02' else '2024-01-01' end as first_seen, case when n.id is null then '2024-01-01' else '2024-02-02' end as last_seen
       from o full join n on n.id = o.id""",
)(
    lambda fx: integrity.merge_snapshot(*_scans(fx), "2024-02-02 00:00:00").select(
        "id", "name", "action", F.date_format("first_seen_at", "yyyy-MM-dd").alias("first_seen"), F.date_format("last_seen_at", "yyyy-MM-dd").alias("last_seen")
    )
)
register("q6_orphans", "select id from fx_prompts where id % 3 <> 0 and id % 4 = 0")(lambda fx: integrity.orphans(*_scans(fx)))
register("q7_cascade_delete", "select prompt_id, version from fx_prompt_versions where prompt_id in (select id from fx_prompts where id % 3 <> 0)")(
    lambda fx: integrity.cascade_delete(fx.prompt_versions, fx.prompts.where("id % 3 <> 0"), "prompt_id").select("prompt_id", "version")
)
register("q10_fk_violations", "select id, run_id from fx_feedback where run_id not in (select run_id from fx_runs)")(
    lambda fx: integrity.fk_violations(fx.feedback, fx.runs, "run_id", "run_id").select("id", "run_id")
)
register(
    "a16_merge_report",
    """with o as (select id from fx_prompts where id % 3 <> 0), n as (select id from fx_prompts where id % 4 <> 0)
       select case when o.id is null then 'inserted' when n.id is null then 'kept' else 'updated' end as action, count(*) as n from o full join n on n.id = o.id group by 1
       union all select 'removed', count(*) from o where id not in (select id from n)""",
)(lambda fx: (lambda s: integrity.merge_report(integrity.merge_snapshot(*s, "2024-02-02 00:00:00"), integrity.orphans(*s)))(_scans(fx)))

# Text --------------------------------------------------------------------------------------------

register(
    "x1_render",
    """select case_id, 'Summarise ' || lang || ' text from ' || source || ': ' || body || ' {missing}' as rendered from fx_cases""",
)(
    lambda fx: fx.cases.select(
        "case_id", X.render(F.col("template"), F.create_map(*[x for c in ("lang", "source", "body") for x in (F.lit(c), F.col(c))])).alias("rendered")
    )
)
register("x2_variables", "select case_id, 'lang,source,body,missing' as names from fx_cases")(
    lambda fx: fx.cases.select("case_id", F.array_join(X.variables(F.col("template")), ",").alias("names"))
)
register("x3_template_kind", "select prompt_id, version, case when regexp_matches(template, '\\{\\{.*?\\}\\}|\\{%\\s*\\w+') then 'jinja2' else 'literal' end as kind from fx_prompt_versions")(
    lambda fx: fx.prompt_versions.select("prompt_id", "version", X.template_kind(F.col("template")).alias("kind"))
)
register(
    "x4_slug",
    "select case_id, coalesce(nullif(regexp_replace(regexp_replace(body, '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'anonymous') as slug from fx_cases",
)(lambda fx: fx.cases.select("case_id", X.slug(F.col("body")).alias("slug")))
register(
    "x7_token_estimate",
    "select case_id, cast(greatest(1, floor(length(body) / 4)) as bigint) as tokens, cast(least(1024, greatest(64, floor(length(body) / 4))) as bigint) as out_tokens from fx_cases",
)(lambda fx: fx.cases.select("case_id", X.token_estimate(F.col("body")).alias("tokens")).withColumn("out_tokens", X.output_estimate(F.col("tokens"))))
register(
    "x9_preview",
    "select case_id, case when length(b) <= 40 then b else concat(substr(b, 1, 39), '…') end as preview from (select case_id, replace(body, chr(10), '⏎') as b from fx_cases) t",
)(lambda fx: fx.cases.select("case_id", X.preview(F.col("body"), 40).alias("preview")))
register(
    "x10_json_object",
    """select case_id, case when case_id % 5 in (0, 1, 2) then regexp_extract(reply, '(?s)\\{.*\\}') end as object from fx_judge_replies""",
)(lambda fx: fx.judge_replies.select("case_id", X.json_object(F.col("reply")).alias("object")))
register(
    "x12_score",
    """select case_id, case case_id % 5 when 0 then least(1.0::double, greatest(0, quality)) when 1 then 0.75::double when 2 then 0.25::double else 0.0::double end as accuracy,
         case case_id % 5 when 0 then 0.5::double when 1 then toxic::double else 0.0::double end as relevance, case case_id % 5 when 0 then 1.0::double else 0.0::double end as safety
       from (select doc_id as case_id, quality, toxic from labels) t""",
)(
    lambda fx: fx.judge_replies.withColumn("o", X.json_object(F.col("reply"))).select(
        "case_id", *[X.score(F.get_json_object("o", f"$.{d}")).alias(d) for d in ("accuracy", "relevance", "safety")]
    )
)
register("x22_response_format", "select id, case when confidence in ('text', 'json') then confidence end as format, lower(provider) as role from fx_prompts")(
    lambda fx: fx.prompts.select("id", X.response_format(F.col("confidence")).alias("format"), X.role(F.col("provider")).alias("role"))
)

# Versions ----------------------------------------------------------------------------------------

register("v1_versions_of", "select prompt_id, version, template from fx_prompt_versions where prompt_id = 7")(
    lambda fx: versions.versions_of(fx.prompt_versions, 7).select("prompt_id", "version", "template")
)
register(
    "v2_record_versions",
    """select f.prompt_id, f.id, n as version, case when n > 1 then n - 1 end as parent_version, 'human' as created_by from (
         select f.id, f.prompt_id, cast(coalesce(h.v, 0) + row_number() over (partition by f.prompt_id order by f.id) as bigint) as n
         from (select id, run_id as prompt_id from fx_feedback) f left join (select prompt_id, max(version) as v from fx_prompt_versions group by 1) h on h.prompt_id = f.prompt_id) f""",
)(lambda fx: versions.record_versions(fx.feedback.select("id", F.col("run_id").alias("prompt_id")), fx.prompt_versions, "id"))
register(
    "v3_rollback",
    """select r.id as prompt_id, case when t.template is not null then h.v + 1 end as version, case when t.template is not null then 2::bigint end as parent_version, t.template,
         case when t.template is not null then 'rollback to v2' end as note, case when t.template is null then 'no such version' end as error
       from fx_prompts r left join fx_prompt_versions t on t.prompt_id = r.id and t.version = 2 left join (select prompt_id, max(version) as v from fx_prompt_versions group by 1) h on h.prompt_id = r.id""",
)(lambda fx: versions.rollback(fx.prompts.select(F.col("id").alias("prompt_id"), F.lit(2).cast("long").alias("to_version")), fx.prompt_versions))
register(
    "v4_version_line_changes",
    """with p as (select prompt_id, version - 1 as old, version as new from fx_prompt_versions where version > 1),
         l as (select p.prompt_id, p.old, p.new, unnest(['Be brief v' || p.new || '.', 'Answer {question} for {{ user }}']) as line from p),
         o as (select p.prompt_id, p.old, p.new, unnest(['Be brief v' || p.old || '.', 'Answer {question} for {{ user }}']) as line from p)
       select coalesce(l.prompt_id, o.prompt_id) as prompt_id, coalesce(l.old, o.old) as old, coalesce(l.new, o.new) as new, coalesce(l.line, o.line) as line, 1 as nth,
         case when o.line is null then 'added' when l.line is null then 'removed' else 'kept' end as change
       from l full join o on l.prompt_id = o.prompt_id and l.old = o.old and l.new = o.new and l.line = o.line""",
)(
    lambda fx: versions.version_line_changes(
        fx.prompt_versions.where("version > 1").select("prompt_id", (F.col("version") - 1).alias("old"), F.col("version").alias("new")), fx.prompt_versions
    )
)
register(
    "v5_fork_versions",
    """select r.run_id, r.target_id as prompt_id, r.target_version as parent_version, concat('iterate from run ', r.run_id, ' (', coalesce(f.n, 0), ' feedback)') as note,
         cast(h.v + row_number() over (partition by r.target_id order by r.run_id) as bigint) as version
       from fx_runs r left join (select run_id, count(*) as n from fx_feedback group by 1) f on f.run_id = r.run_id
       join (select prompt_id, max(version) as v from fx_prompt_versions group by 1) h on h.prompt_id = r.target_id""",
)(lambda fx: versions.fork_versions(fx.runs, fx.feedback, fx.prompt_versions))

register(
    "x27_version_notes",
    "select prompt_id, version, 'revise from run ' || version || ' (' || coalesce(parent_version, 0) || ' feedback)' as made, 'rollback to v' || parent_version as undone from fx_prompt_versions",
)(
    lambda fx: fx.prompt_versions.select(
        "prompt_id", "version", versions.run_note(F.lit("revise"), F.col("version"), F.coalesce("parent_version", F.lit(0))).alias("made"),
        versions.rollback_note(F.col("parent_version")).alias("undone"),
    )
)

# Graphs ------------------------------------------------------------------------------------------

_REACH = "with recursive u(a, b) as (select src, dst from fx_edges union select dst, src from fx_edges), r(n, m) as (select a, a from u union select r.n, u.b from r join u on u.a = r.m), c as (select n as node, min(m) as component from r group by 1)"
register("g1_components", f"{_REACH} select * from c")(lambda fx: graph.components(fx.edges))
register(
    "g2_build_pipelines",
    f"""{_REACH}, e as (select distinct src, dst from fx_edges where src <> dst)
       select c.component, substr(sha1(string_agg(cast(node as varchar), '|' order by cast(node as varchar))), 1, 12) as pipeline_id,
         coalesce((select p.name from fx_prompts p where p.id = min(node) filter (node not in (select dst from e))), 'pipeline_' || substr(cast(c.component as varchar), 1, 6)) || '_pipeline' as name,
         string_agg(cast(node as varchar), ',' order by node) as nodes, count(*) as n_nodes, (select count(*) from e join c x on x.node = e.src where x.component = c.component) as n_edges,
         string_agg(cast(node as varchar), ',' order by node) filter (node not in (select dst from e)) as entries,
         string_agg(cast(node as varchar), ',' order by node) filter (node not in (select src from e)) as exits from c group by c.component""",
)(lambda fx: graph.build_pipelines(fx.edges, fx.prompts.select("id", "name")))
register(
    "g3_topo_levels",
    """with recursive e as (select distinct src, dst from fx_edges), l(node, level) as (
         select node, 0 from (select src as node from e union select dst from e) x where node not in (select dst from e)
         union select e.dst, l.level + 1 from l join e on e.src = l.node)
       select node, max(level) as level from l group by 1""",
)(lambda fx: graph.topo_levels(fx.edges))
register(
    "g4_downstream_impact",
    """with recursive e as (select distinct src, dst, kind from fx_edges), s as (select distinct src as start from e),
         w(start, node, distance, kind) as (select s.start, e.dst, 1, e.kind from s join e on e.src = s.start
           union select w.start, e.dst, w.distance + 1, k.kind from w join e on e.src = w.node, lateral (select w.kind union select e.kind) k(kind)),
         d as (select start, node, min(distance) as distance from w group by 1, 2)
       select d.start, d.node, d.distance, string_agg(distinct w.kind, ',' order by w.kind) as kinds from d join w on w.start = d.start and w.node = d.node and w.distance = d.distance group by 1, 2, 3""",
)(lambda fx: graph.downstream_impact(fx.edges, fx.edges.select(F.col("src").alias("start")).distinct()))


def run_events(events: DataFrame) -> DataFrame:
    """Status events of runs out of the general event table."""
    status = F.when(F.col("event_type") == "signup", "running").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed")
    return events.select(F.col("user_id").alias("run_id"), F.col("ts").alias("at"), status.alias("status")).where("status is not null")


from quillspark.plans import code, evaluation, jobs  # noqa: E402, F401  registers its queries here
