"""Queries of judging, cases, inventory rules and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import cases, graph, inventory, judging, scores, versions
from quillspark.plans.registry import register
from quillspark.sources.prices import image_price_book, image_price_book_sql, price_book, price_book_sql

# Judging -----------------------------------------------------------------------------------------

register(
    "j3_pair_outputs",
    """select coalesce(o.run_id, f.run_id) as run_id, coalesce(o.case_index, f.case_index) as case_index,
       case when o.run_id is null then 'response' when f.run_id is null then 'output' else 'both' end as side
       from fx_outputs o full join fx_feedback f on f.run_id = o.run_id and f.case_index = o.case_index""",
)(
    lambda fx: judging.pair_outputs(
        fx.outputs.select("run_id", F.col("case_index").cast("long").alias("case_index")), fx.feedback.select("run_id", "case_index"), ["run_id", "case_index"]
    )
)
register(
    "j7_price_images",
    f"""with pb as ({image_price_book_sql()}), r as (select p_partkey as id, case when p_size % 2 = 0 then 'dall-e-3' else 'dall-e-2' end as model,
         case p_partkey % 3 when 0 then '1024x1024' when 1 then '512x512' else '1024x1792' end as size, case when p_partkey % 2 = 0 then 'hd' else 'standard' end as quality, p_partkey % 4 as n from part)
       select r.*, case when n >= 1 then usd_each * n end as cost_usd from r left join pb on pb.model = r.model and pb.size = r.size and pb.quality = r.quality""",
)(
    lambda fx: scores.price_images(
        fx.part.select(
            F.col("p_partkey").alias("id"),
            F.when(F.col("p_size") % 2 == 0, "dall-e-3").otherwise("dall-e-2").alias("model"),
            F.element_at(F.array(F.lit("1024x1024"), F.lit("512x512"), F.lit("1024x1792")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("size"),
            F.when(F.col("p_partkey") % 2 == 0, "hd").otherwise("standard").alias("quality"),
            (F.col("p_partkey") % 4).alias("n"),
        ),
        image_price_book(fx.spark),
    )
)
_DEFAULTS = "(values ('accuracy', 0.4::double), ('relevance', 0.3::double), ('safety', 0.15::double), ('format', 0.15::double)) d(dimension, weight)"
register(
    "j9_active_dimensions",
    f"""with own as (select id as prompt_id, 'tone' as dimension, 0.5::double as weight from fx_prompts where id % 7 = 0
         union all select id, 'length', case when id % 2 = 0 then 0.5::double else 1.5::double end from fx_prompts where id % 7 = 0),
       ok as (select prompt_id from own group by 1 having bool_and(weight between 0 and 1))
       select prompt_id, dimension, weight from own where prompt_id in (select prompt_id from ok)
       union all select id, 'clarity', 1.0::double from fx_prompts where project % 3 = 0 and id not in (select prompt_id from ok)
       union all select id, d.dimension, d.weight from fx_prompts, {_DEFAULTS} where project % 3 <> 0 and id not in (select prompt_id from ok)""",
)(
    lambda fx: (
        lambda own: judging.active_dimensions(
            fx.prompts.select(F.col("id").alias("prompt_id"), "project"),
            fx.prompts.where("project % 3 = 0").select("project").distinct().select("project", F.lit("clarity").alias("dimension"), F.lit(1.0).alias("weight")),
            own.select("prompt_id", F.lit("tone").alias("dimension"), F.lit(0.5).alias("weight")).unionByName(
                own.select("prompt_id", F.lit("length").alias("dimension"), F.when(F.col("prompt_id") % 2 == 0, 0.5).otherwise(1.5).alias("weight"))
            ),
        )
    )(fx.prompts.where("id % 7 = 0").select(F.col("id").alias("prompt_id")))
)
_JUDGED = f"""j as (select doc_id as case_id, d.dimension, d.weight, case doc_id % 5
         when 0 then case d.dimension when 'accuracy' then least(1.0::double, greatest(0, quality)) when 'relevance' then 0.5::double when 'safety' then 1.0::double else 0.0::double end
         when 1 then case d.dimension when 'accuracy' then 0.75::double when 'relevance' then toxic::double when 'format' then 1.0::double else 0.0::double end
         when 2 then case d.dimension when 'accuracy' then 0.25::double else 0.0::double end else 0.0::double end as score,
         case doc_id % 5 when 0 then concat('c', doc_id) when 2 then 'low' else '' end as critique from labels, {_DEFAULTS})"""
register("x13_judge_replies", f"with {_JUDGED} select case_id, dimension, weight, score, critique from j")(
    lambda fx: judging.judge_replies(fx.judge_replies, judging.DEFAULT_DIMENSIONS, ["case_id"])
)
register("a8_weighted_total", f"with {_JUDGED} select case_id, round(sum(score * weight), 9) as weighted_total from j group by 1")(
    lambda fx: judging.weighted_total(judging.judge_replies(fx.judge_replies, judging.DEFAULT_DIMENSIONS, ["case_id"]), ["case_id"])
)
register(
    "u5_score_rows",
    f"""with {_JUDGED} select case_id as run_id, 0 as case_index, 'llm' as judge_kind, 'rubric' as judge_name, round(sum(score * weight), 9) as score, nullif(max(critique), '') as critique from j group by 1""",
)(
    lambda fx: judging.score_rows(
        judging.weighted_total(judging.judge_replies(fx.judge_replies, judging.DEFAULT_DIMENSIONS, ["case_id"]), ["case_id", "critique"]).select(
            F.col("case_id").alias("run_id"), F.lit(0).alias("case_index"), "weighted_total", "critique"
        ),
        "rubric",
    )
)
register(
    "a7_round_per_dim",
    """select r.run_id, k.dimension, coalesce(avg(s.score), 0) as mean from fx_runs r cross join (values ('rule'), ('llm'), ('style')) k(dimension)
       left join fx_scores s on s.run_id = r.run_id and s.judge_kind = k.dimension group by 1, 2""",
)(
    lambda fx: judging.round_per_dim(
        fx.runs, [("rule", 1), ("llm", 1), ("style", 1)], fx.scores.withColumnRenamed("judge_kind", "dimension"), "run_id"
    )
)
register(
    "w7_worst_cases",
    """select round_id, cast(k as int) as rank, case_index, critique from (select run_id % 50 as round_id, id as case_index, critique,
         row_number() over (partition by run_id % 50 order by rating, id) as k from fx_feedback where length(critique) > 0) t where k <= 2""",
)(
    lambda fx: judging.worst_cases(
        fx.feedback.select((F.col("run_id") % 50).alias("round_id"), F.col("id").alias("case_index"), F.col("rating").alias("weighted_total"), "critique"), "round_id"
    )
)
register(
    "j10_feedback_view",
    """with s as (select run_id, case_index, max(score) as score from fx_scores group by 1, 2), t as (select run_id, case_index, case when rating = 1 then 'up' else 'down' end as thumb from fx_feedback where rating <> 0),
         n as (select run_id, case_index, 'see ' || id as note from fx_feedback where id % 3 = 0), k as (select run_id, case_index from s union select run_id, case_index from t union select run_id, case_index from n)
       select k.run_id, k.case_index, s.score, t.thumb, n.note, case when t.thumb = 'down' then 'thumbs_down' when t.thumb is null and length(n.note) > 0 then 'note' end as shown_as
       from k left join s on s.run_id = k.run_id and s.case_index = k.case_index left join t on t.run_id = k.run_id and t.case_index = k.case_index left join n on n.run_id = k.run_id and n.case_index = k.case_index""",
)(
    lambda fx: judging.feedback_view(
        fx.scores.groupBy("run_id", F.col("case_index").cast("long").alias("case_index")).agg(F.max("score").alias("score")),
        fx.feedback.where("rating <> 0").select("run_id", "case_index", F.when(F.col("rating") == 1, "up").otherwise("down").alias("thumb")),
        fx.feedback.where("id % 3 = 0").select("run_id", "case_index", F.concat(F.lit("see "), F.col("id").cast("string")).alias("note")),
        ["run_id", "case_index"],
    )
)
register(
    "j11_assess_status",
    """with a as (select prompt_id as node, round, weighted_score from fx_iterations), p as (select node, arg_min(weighted_score, (round, weighted_score)) as score from a where round = 1 group by 1),
         q as (select node, arg_min(weighted_score, (round, weighted_score)) as score from a where round = 2 group by 1)
       select p.node, case when q.score is null then 'unverified' when q.score - p.score > 0.02 then 'improved' when q.score - p.score < -0.02 then 'regressed' else 'verified' end as status from p left join q on q.node = p.node""",
)(
    lambda fx: judging.assess_status(
        *[fx.iterations.where(f"round = {r}").groupBy(F.col("prompt_id").alias("node")).agg(F.min("weighted_score").alias("score")) for r in (1, 2)]
    )
)
_STATUS = "case event_type when 'signup' then 'verified' when 'purchase' then 'improved' when 'error' then 'regressed' else 'unverified' end"
_LATEST = f"""l as (select user_id as iteration_id, event_id % 5 as node, arg_max({_STATUS}, (ts, {_STATUS})) as status from events group by 1, 2)"""


def _statuses(fx):
    kind = F.col("event_type")
    status = F.when(kind == "signup", "verified").when(kind == "purchase", "improved").when(kind == "error", "regressed").otherwise("unverified")
    return judging.latest_downstream(
        fx.events.select(F.col("user_id").alias("iteration_id"), (F.col("event_id") % 5).alias("node"), status.alias("status"), F.col("ts").alias("at"))
    )


register("w9_latest_downstream", f"with {_LATEST} select iteration_id, string_agg(node || '=' || status, ';' order by node) as statuses from l group by 1")(
    lambda fx: _statuses(fx).select(
        "iteration_id", F.array_join(F.transform(F.map_entries("statuses"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])), ";").alias("statuses")
    )
)
register(
    "g9_unverified_nodes",
    f"with {_LATEST} select iteration_id, coalesce(string_agg(cast(node as varchar), ',' order by node) filter (status = 'unverified'), '') as nodes from l group by 1",
)(lambda fx: _statuses(fx).select("iteration_id", F.array_join(judging.unverified_nodes(F.col("statuses")), ",").alias("nodes")))
register(
    "p9_judge_view",
    """select run_id, case_index, case when text is not null then '{"text":"' || text || '"}' else '{"error":"' || error || '"}' end as shown from fx_outputs""",
)(lambda fx: judging.judge_view(fx.outputs, ["run_id", "case_index"]))
register(
    "x14_critic_reply",
    """select doc_id as id, case when doc_id % 4 < 2 then 'new ' || doc_id end as template, case doc_id % 4 when 0 then 'why' when 1 then '(critic did not provide a rationale)' end as rationale,
       case doc_id % 4 when 2 then 'no_template' when 3 then 'unparseable' else 'ok' end as status from labels""",
)(
    lambda fx: fx.labels.select(
        F.col("doc_id").alias("id"),
        judging.critic_reply(
            F.expr("""case doc_id % 4 when 0 then concat('ok {"revised_template": "new ', doc_id, '", "rationale": " why "}') when 1 then concat('```json {"revised_template": "new ', doc_id, '"}```')
                      when 2 then '{"revised_template": 7}' else 'sorry' end""")
        ).alias("r"),
    ).select("id", "r.*")
)
register(
    "x25_rationale",
    "select id, case when id % 2 = 0 then 'User instruction: shorter' || chr(10) || 'Critic: ' || file else file end as rationale from fx_prompts",
)(lambda fx: fx.prompts.select("id", judging.rationale_text(F.when(F.col("id") % 2 == 0, "guided").otherwise("auto"), F.lit("shorter"), F.col("file")).alias("rationale")))
register(
    "u7_feedback_block",
    """with w as (select run_id % 50 as k, id, rating, row_number() over (partition by run_id % 50 order by rating, id) as rank, critique from fx_feedback where length(critique) > 0),
         p as (select k, 1 as part, 'Worst cases' as title, rank, 'case ' || id as line from w where rank <= 2 union all select run_id % 50, 2, 'Thumbs down', id, 'case ' || id from fx_feedback where rating = -1
           union all select run_id % 50, 3, 'Notes', id, 'note ' || id from fx_feedback where rating = 0),
         b as (select k, part, title || ':' || chr(10) || string_agg('- ' || line, chr(10) order by rank, line) as t from p group by k, part, title)
       select k as round_id, string_agg(t, chr(10) || chr(10) order by part) as block from b group by 1""",
)(
    lambda fx: (
        lambda f: judging.feedback_block(
            f.where("false").select("round_id", F.lit(0).alias("rank"), F.lit("").alias("line")),
            judging.worst_cases(f.withColumnRenamed("id", "case_index").withColumnRenamed("rating", "weighted_total"), "round_id").select(
                "round_id", "rank", F.concat(F.lit("case "), F.col("case_index").cast("string")).alias("line")
            ),
            f.where("rating = -1").select("round_id", F.col("id").alias("rank"), F.concat(F.lit("case "), F.col("id").cast("string")).alias("line")),
            f.where("rating = 0").select("round_id", F.col("id").alias("rank"), F.concat(F.lit("note "), F.col("id").cast("string")).alias("line")),
            "round_id",
        )
    )(fx.feedback.select((F.col("run_id") % 50).alias("round_id"), "id", "rating", "critique"))
)

# Cases -------------------------------------------------------------------------------------------

register(
    "j2_run_matrix",
    """with t as (select id as target_id, id % 1000 as dataset_id from fx_prompts), i as (select run_id as target_id, case_index, critique as body from fx_feedback where critique is not null)
       select i.target_id, i.case_index, i.body from i where i.target_id in (select target_id from t)
       union all select t.target_id, c.case_id, c.body from t join fx_cases c on c.case_id % 1000 = t.dataset_id where t.target_id not in (select target_id from i)""",
)(
    lambda fx: cases.run_matrix(
        fx.prompts.select(F.col("id").alias("target_id"), (F.col("id") % 1000).alias("dataset_id")),
        fx.cases.select((F.col("case_id") % 1000).alias("dataset_id"), F.col("case_id").alias("case_index"), "body"),
        fx.feedback.where("critique is not null").select(F.col("run_id").alias("target_id"), "case_index", F.col("critique").alias("body")),
    )
)
register(
    "j14_node_inputs",
    """with c as (select id as node, name from fx_prompts), e as (select dst as node, src, kind, row_number() over (order by src, dst, kind, detector, confidence) as pos from fx_edges),
         o as (select e.node, coalesce(case when kind = 'variable' then 'seed' end, cast(src as varchar)) as name, pos, src, p.file as text from e join fx_prompts p on p.id = e.src),
         l as (select node, name, arg_max(text, (pos, src)) as text from o group by 1, 2),
         a as (select node, 'seed' as k, name as v from c union all select node, 'lang', 'en' from c),
         m as (select node, k, v from a where not exists (select 1 from l where l.node = a.node and l.name = a.k) union all select l.node, l.name, l.text from l join c on c.node = l.node)
       select node, string_agg(k || '=' || v, ';' order by k, v) as inputs from m group by 1""",
)(
    lambda fx: cases.node_inputs(
        fx.prompts.select(F.col("id").alias("node"), F.lit(0).alias("case_index"), F.create_map(F.lit("seed"), "name", F.lit("lang"), F.lit("en")).alias("inputs")),
        fx.edges.select(
            "src", "dst", F.when(F.col("kind") == "variable", "seed").alias("via"), F.struct("src", "dst", "kind", "detector", "confidence").alias("pos")
        ),
        fx.prompts.select(F.col("id").alias("node"), F.lit(0).alias("case_index"), F.col("file").alias("text")),
    ).select("node", F.array_join(F.array_sort(F.transform(F.map_entries("inputs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("inputs"))
)
register(
    "x5_site_id",
    "select id, substr(sha1(concat(file, ':', line, ':', coalesce(cast(case when id % 2 = 0 then id end as varchar), '?'), ':', system_text, '|', user_text)), 1, 12) as site_id from fx_prompts",
)(
    lambda fx: fx.prompts.select(
        "id", cases.site_id(F.col("file"), F.col("line"), F.when(F.col("id") % 2 == 0, F.col("id")), F.array("system_text", "user_text")).alias("site_id")
    )
)
register(
    "x6_case_id",
    """select id, substr(sha1(concat(cast(id as varchar), chr(0), '{"a":"', name, '","b":"', file, '"}')), 1, 12) as case_id from fx_prompts""",
)(lambda fx: fx.prompts.select("id", cases.case_id(F.col("id"), F.create_map(F.lit("b"), "file", F.lit("a"), "name")).alias("case_id")))
register(
    "x24_pipeline_id",
    "select pipeline_id as k, substr(sha1(string_agg(n, '|' order by n)), 1, 12) as pipeline_id from (select distinct pipeline_id, cast(prompt_id as varchar) as n from fx_nodes) t group by 1",
)(lambda fx: fx.nodes.groupBy(F.col("pipeline_id").alias("k")).agg(cases.pipeline_id(F.collect_set(F.col("prompt_id").cast("string"))).alias("pipeline_id")))
_LISTS = """case doc_id % 4 when 0 then concat('here: [{"inputs": {"q": "q', doc_id, '"}, "tags": ["x"]}, 3, {"q": "bare", "notes": "n"}] done')
            when 1 then concat('[{"inputs": {"q": "dup"}}, {"inputs": {"q": "dup"}}, {"inputs": {"lang": "l', doc_id, '"}}]') when 2 then '[]' else 'none' end"""
register(
    "x11_json_objects",
    """select doc_id as id, case doc_id % 4 when 0 then 2 when 1 then 3 when 2 then 0 end as n,
       case doc_id % 4 when 0 then concat('{"inputs":{"q":"q', doc_id, '"},"tags":["x"]}') when 1 then '{"inputs":{"q":"dup"}}' end as first from labels""",
)(
    lambda fx: fx.labels.select(F.col("doc_id").alias("id"), cases.json_objects(F.expr(_LISTS)).alias("o")).select(
        "id", F.when(F.col("o").isNotNull(), F.size("o")).alias("n"), F.try_element_at("o", F.lit(1)).alias("first")
    )
)


def _found(fx):
    seed = F.create_map(F.lit("lang"), F.lit("en"), F.lit("q"), F.lit("dup"))
    listed = fx.labels.select(F.col("doc_id").alias("site"), F.posexplode(cases.json_objects(F.expr(_LISTS))).alias("pos", "item"))
    return listed.select("site", "pos", cases.case_inputs(F.col("item"), seed).alias("inputs"))


_FOUND = """f as (select doc_id as site, i.pos, case when doc_id % 4 = 0 then case i.pos when 0 then 'q' || doc_id else 'bare' end else 'dup' end as q,
         case when doc_id % 4 = 1 and i.pos = 2 then 'l' || doc_id else 'en' end as lang from labels, (values (0), (1), (2)) i(pos) where doc_id % 4 = 1 or (doc_id % 4 = 0 and i.pos < 2))"""
register("x23_case_inputs", f"with {_FOUND} select site, pos, 'lang=' || lang || ';q=' || q as inputs from f")(
    lambda fx: _found(fx).select(
        "site", "pos", F.array_join(F.array_sort(F.transform(F.map_entries("inputs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("inputs")
    )
)
_CASE_ID = """substr(sha1(concat(cast(site as varchar), chr(0), '{"lang":"', lang, '","q":"', q, '"}')), 1, 12)"""
register(
    "q9_expand_cases",
    f"""with {_FOUND}, h as (select site, {_CASE_ID} as case_id, min(pos) as pos from f where not (lang = 'en' and q = 'dup') group by 1, 2),
         m as (select site, case_id, row_number() over (partition by site order by pos) - 1 as k from h), n as (select site, count(*) as n from m group by 1),
         p as (select l.doc_id as site, t.k, case t.k % 4 when 0 then '' when 1 then 'a' when 2 then '   ' else repeat('x', 4000) end as lang, 'dup' as q from labels l cross join (values (0), (1), (2)) t(k)
           left join n on n.site = l.doc_id where t.k >= coalesce(n.n, 0))
       select site, cast(k as int) as k, case_id, 'model' as origin from m where k < 3 union all select site, k, {_CASE_ID}, 'boundary' from p""",
)(
    lambda fx: cases.expand_cases(
        fx.labels.select(F.col("doc_id").alias("site"), F.create_map(F.lit("lang"), F.lit("en"), F.lit("q"), F.lit("dup")).alias("inputs")), _found(fx), 3
    )
)
register(
    "x15_boundary_inputs",
    "select id, case id % 4 when 0 then '' when 1 then 'a' when 2 then '   ' else repeat('x', 4000) end as q, name as other from fx_prompts",
)(
    lambda fx: fx.prompts.select("id", cases.boundary_inputs(F.create_map(F.lit("q"), "file", F.lit("other"), "name"), F.lit("q"), F.col("id")).alias("m")).select(
        "id", F.col("m")["q"].alias("q"), F.col("m")["other"].alias("other")
    )
)

# Costs and counts --------------------------------------------------------------------------------

register(
    "a4_pipeline_run_metrics",
    """with o as (select run_id, case_index // 2 as case_index, error, case when error is null then input_tokens else 0 end as i, case when error is null then output_tokens else 0 end as u from fx_outputs),
         c as (select run_id, case_index, bool_or(error is not null) as failed, count(*) as n, sum(i) as i, sum(u) as u from o group by 1, 2)
       select run_id, count(*) as n_cases, count(*) filter (failed) as n_failed, cast(sum(n) as bigint) as n_outputs, cast(sum(i) as bigint) as input_tokens, cast(sum(u) as bigint) as output_tokens from c group by 1""",
)(
    lambda fx: scores.pipeline_run_metrics(
        fx.outputs.select("run_id", F.expr("case_index div 2").alias("case_index"), (F.col("case_index") % 2).alias("node"), "error", "input_tokens", "output_tokens")
    )
)
_COSTS = f"""pb as ({price_book_sql()}), c as (select i.session_id, i.round, o.input_tokens * pb.usd_in / 1000.0::double + o.output_tokens * pb.usd_out / 1000.0::double as cost_usd
         from fx_iterations i join fx_outputs o on o.run_id = i.id left join pb on pb.provider = o.provider and pb.model = o.model)"""
register("a5_round_cost", f"with {_COSTS} select session_id, round, round(sum(coalesce(cost_usd, 0)), 9) as cost_usd, count(*) filter (cost_usd is null) as n_unpriced from c group by 1, 2")(
    lambda fx: scores.round_cost(
        scores.price_usage(fx.outputs, price_book(fx.spark)).join(fx.iterations.select(F.col("id").alias("run_id"), "session_id", "round"), "run_id")
    )
)
register(
    "a11_pipeline_summary",
    """with e as (select distinct src % 97 as pipeline_id, src, dst from fx_edges where src <> dst)
       select n.pipeline_id, count(*) as n_nodes, (select count(*) from e where e.pipeline_id = n.pipeline_id) as n_edges,
         count(*) filter (not exists (select 1 from e where e.pipeline_id = n.pipeline_id and e.dst = n.prompt_id)) as n_entries,
         count(*) filter (not exists (select 1 from e where e.pipeline_id = n.pipeline_id and e.src = n.prompt_id)) as n_exits from fx_nodes n group by 1""",
)(lambda fx: scores.pipeline_summary(fx.nodes, fx.edges.withColumn("pipeline_id", F.col("src") % 97)))
register(
    "a12_scan_summary",
    """with t as (select project, 'prompts' as t from fx_prompts union all select c_custkey % 50, 'files' from customer union all select p_partkey % 60, 'warnings' from part)
       select project, count(*) filter (t = 'prompts') as n_prompts, count(*) filter (t = 'files') as n_files, count(*) filter (t = 'warnings') as n_warnings from t group by 1""",
)(
    lambda fx: scores.scan_summary(
        prompts=fx.prompts, files=fx.customer.select((F.col("c_custkey") % 50).alias("project")), warnings=fx.part.select((F.col("p_partkey") % 60).alias("project"))
    )
)
register(
    "a18_prompt_cost_estimate",
    f"""with pb as ({price_book_sql()}), h as (select prompt_id, arg_max(template, version) as template from fx_prompt_versions group by 1),
         t as (select p.id, coalesce(h.template, case when p.id % 5 > 0 then p.user_text end) as text, case when p.id % 3 = 0 then 'no-such' else 'gpt-4o' end as model from fx_prompts p left join h on h.prompt_id = p.id),
         s as (select t.*, cast(greatest(1, floor(length(text) / 4)) as bigint) as i, cast(least(1024, greatest(64, floor(length(text) / 4))) as bigint) as o from t)
       select id, case when text is not null then i end as tokens_in, case when text is not null then o end as tokens_out,
         case when text is not null then i * usd_in / 1000.0::double + o * usd_out / 1000.0::double end as cost_usd, case when text is null then 'no_template' when usd_in is null then 'unpriced' else 'ok' end as status
       from s left join pb on pb.provider = 'openai' and pb.model = s.model""",
)(
    lambda fx: scores.prompt_cost_estimate(
        fx.prompts.join(versions.head_versions(fx.prompt_versions).select(F.col("prompt_id").alias("id"), "template"), "id", "left").select(
            "id", F.coalesce("template", F.when(F.col("id") % 5 > 0, F.col("user_text"))).alias("text"), F.lit("openai").alias("provider"),
            F.when(F.col("id") % 3 == 0, "no-such").otherwise("gpt-4o").alias("model"),
        ),
        price_book(fx.spark),
    )
)

# Inventory rules ---------------------------------------------------------------------------------

register(
    "w5_chain_edges",
    """with f as (select l_orderkey as group_id, l_partkey % 5 as site, min(l_linenumber) as pos from lineitem group by 1, 2)
       select * from (select group_id, site as src, lead(site) over (partition by group_id order by pos, site) as dst from f) t where dst is not null""",
)(lambda fx: inventory.chain_edges(fx.lineitem.select(F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") % 5).alias("site"))))
register(
    "w13_enclosing_scope",
    """with s as (select p_partkey % 40 as file, p_partkey as qual, p_size as a, p_size + p_partkey % 30 as b from part), u as (select c_custkey % 40 as file, c_custkey as site, c_custkey % 60 as line from customer)
       select u.file, u.site, u.line, arg_min(s.qual, (b - a, -a, s.qual)) as scope from u left join s on s.file = u.file and u.line between a and b group by 1, 2, 3""",
)(
    lambda fx: inventory.enclosing_scope(
        fx.customer.select((F.col("c_custkey") % 40).alias("file"), F.col("c_custkey").alias("site"), (F.col("c_custkey") % 60).alias("line")),
        fx.part.select((F.col("p_partkey") % 40).alias("file"), F.col("p_partkey").alias("qual"), F.col("p_size").alias("line_start"), (F.col("p_size") + F.col("p_partkey") % 30).alias("line_end")),
    )
)
register(
    "w15_last_binding",
    """with u as (select run_id % 20 as file, rating as scope, case_index as name, id as "at", id as use_id from fx_feedback where id % 3 = 0), a as (select run_id % 20 as file, rating as scope, case_index as name, id as "at", run_id as value from fx_feedback where id % 3 = 1)
       select u.file, u.scope, u.name, u."at", u.use_id, (select arg_max(value, "at") from a where a.file = u.file and a.scope = u.scope and a.name = u.name and a."at" < u."at") as bound from u""",
)(
    lambda fx: (
        lambda f: inventory.last_binding(
            f.where("id % 3 = 0").select("file", "scope", "name", "at", F.col("id").alias("use_id")), f.where("id % 3 = 1").select("file", "scope", "name", "at", F.col("run_id").alias("value"))
        )
    )(fx.feedback.select((F.col("run_id") % 20).alias("file"), F.col("rating").alias("scope"), F.col("case_index").alias("name"), F.col("id").alias("at"), "id", "run_id"))
)
register("q8_all_edges", "select kind, count(*) as n from fx_edges group by 1")(
    lambda fx: inventory.all_edges(*[fx.edges.where(F.col("kind") == k) for k in ("variable", "function", "lc_pipe")]).groupBy("kind").agg(F.count("*").alias("n"))
)
register(
    "x17_names",
    f"""select id, regexp_matches(f, '{inventory.BUILDER_NAME}') as builder, regexp_matches(c, '{inventory.PROMPT_CONSTANT}') as constant from (
         select id, case id % 4 when 0 then 'build_' || name || '_messages' when 1 then 'get_prompt' when 2 then 'render_x_templates' else 'run' end as f,
           case id % 4 when 0 then 'SYSTEM_' || id when 1 then 'A' || id || '_RULES' when 2 then 'PROMPT' else 'x_PROMPT' end as c from fx_prompts) t""",
)(
    lambda fx: fx.prompts.selectExpr(
        "id", "case id % 4 when 0 then 'build_' || name || '_messages' when 1 then 'get_prompt' when 2 then 'render_x_templates' else 'run' end as f",
        "case id % 4 when 0 then 'SYSTEM_' || id when 1 then 'A' || id || '_RULES' when 2 then 'PROMPT' else 'x_PROMPT' end as c",
    ).select("id", inventory.is_builder(F.col("f")).alias("builder"), inventory.is_prompt_constant(F.col("c")).alias("constant"))
)
register(
    "x18_roles",
    """select id, case id % 4 when 0 then 'system' when 1 then 'assistant' when 2 then 'tool' else 'user' end as role, case when id % 6 in (0, 3) then 'anthropic' when id % 2 = 0 then 'openai' else 'unknown' end as provider from fx_prompts""",
)(
    lambda fx: fx.prompts.select(
        "id",
        inventory.constant_role(F.expr("case id % 4 when 0 then 'System_X' when 1 then 'ASSISTANT_Y' when 2 then 'TOOL' else 'MY_SYSTEM' end")).alias("role"),
        inventory.provider_of_imports(F.expr("filter(array(case when id % 2 = 0 then 'openai' end, case when id % 3 = 0 then 'anthropic' end, 'os'), x -> x is not null)")).alias("provider"),
    )
)
register(
    "x19_wrappers",
    "select id, id % 3 <> 2 as receiver, id % 2 = 0 as method, id % 5 in (0, 1) as messages from fx_prompts",
)(
    lambda fx: fx.prompts.select(
        "id",
        inventory.calls_a_model(F.expr("case id % 3 when 0 then 'self._LLM' when 1 then 'gpt4' else 'self.db' end")).alias("receiver"),
        inventory.is_wrapper_method(F.expr("case id % 4 when 0 then 'ainvoke' when 2 then '__call__' when 1 then 'Chat' else 'fetch' end")).alias("method"),
        inventory.is_message_list(F.expr("case id % 5 when 0 then 'my_Msgs' when 1 then 'history' when 2 then 'rows' when 3 then 'text' else 'q' end")).alias("messages"),
    )
)
register(
    "x21_call_confidence", "select id, case when id % 3 = 0 then 'medium' else 'high' end as confidence from fx_prompts"
)(lambda fx: fx.prompts.select("id", inventory.call_confidence(F.expr("case when id % 3 = 0 then array('unresolved') when id % 3 = 1 then array('unresolved', 'literal') else array('fstring') end")).alias("confidence")))
register(
    "x8_usd", "select run_id, case_index, input_tokens * 0.0025::double / 1000 + output_tokens * 0.01::double / 1000 as cost_usd from fx_outputs"
)(lambda fx: fx.outputs.select("run_id", "case_index", scores.usd(F.col("input_tokens"), F.col("output_tokens"), F.lit(0.0025), F.lit(0.01)).alias("cost_usd")))
register(
    "x20_key_provider",
    """select c_custkey as id, case c_custkey % 8 when 0 then 'openai' when 1 then 'openai' when 2 then 'anthropic' when 4 then 'langchain' when 5 then 'llamaindex' when 6 then 'dashscope' end as provider from customer""",
)(
    lambda fx: fx.customer.select(
        F.col("c_custkey").alias("id"),
        inventory.key_provider(
            F.expr(
                "case c_custkey % 8 when 0 then 'OPENAI_API_KEY' when 1 then 'OPENAI_ORG' when 2 then 'ANTHROPIC_API_KEY' when 3 then concat('MY_', c_mktsegment, '_ANTHROPIC_API_KEY') when 4 then 'LANGSMITH_API_KEY' when 5 then concat('LLAMAINDEX_', c_mktsegment) when 6 then 'DASHSCOPE_API_KEY' else c_mktsegment end"
            )
        ).alias("provider"),
    )
)
register(
    "k8_provider_evidence",
    """with l as (select c_custkey as id, concat('d', c_custkey, '/', case c_custkey % 3 when 0 then '.env' when 1 then 'config.yaml' else 'notes.txt' end) as file, c_custkey % 4 as k, c_custkey % 2 as c, c_custkey % 3 as s from customer)
       select file, case s when 0 then '.env' else 'config' end as source, case k when 0 then 'openai' else 'anthropic' end as provider, case k when 0 then 'OPENAI_API_KEY' else 'ANTHROPIC_API_KEY' end as key_var_name, 2 as line from l where s < 2 and k < 2
       union all select file, case s when 0 then '.env' else 'config' end, 'llamaindex', 'LLAMAINDEX_CACHE' || c, 3 from l where s < 2""",
)(
    lambda fx: inventory.provider_evidence(
        fx.config_files.select(F.concat(F.lit("d"), F.col("file_id").cast("string"), F.lit("/"), F.regexp_extract("file", "([^/]+)$", 1)).alias("file"), "content")
    )
)
register(
    "p10_list_evidence",
    """select event_id as id, case when event_type in ('openai', 'anthropic') then event_type else 'unknown' end as provider, case when event_id % 3 = 0 then 'code' when event_id % 3 = 1 then '.env' else 'config' end as source, ts as detected_at from events""",
)(
    lambda fx: inventory.list_evidence(
        fx.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("provider"), F.expr("case event_id % 3 when 0 then 'code' when 1 then '.env' else 'mail' end").alias("source"), F.col("ts").alias("detected_at"))
    )
)

# Graphs ------------------------------------------------------------------------------------------

_RING = "select src, dst from fx_edges union all select dst, src from fx_edges where src % 40 = 1 and detector = 1"


def _ringed(fx):
    plain = fx.edges.select("src", "dst")
    return plain.unionByName(fx.edges.where("src % 40 = 1 and detector = 1").select(F.col("dst").alias("src"), F.col("src").alias("dst")))


register(
    "g5_reachable_cycles",
    f"""with recursive e as ({_RING}), r(a, b) as (select src, dst from e union select r.a, e.dst from r join e on e.src = r.b), c as (select a from r where a = b)
       select start, start in (select a from c) or start in (select r.a from r where r.b in (select a from c)) as cyclic from (select distinct src as start from e) s""",
)(lambda fx: graph.reachable_cycles(_ringed(fx), _ringed(fx).select(F.col("src").alias("start")).distinct()))
register(
    "g6_dag_layers",
    """with recursive e as (select distinct src, dst from fx_edges), l(node, level) as (select node, 0 from (select src as node from e union select dst from e) x where node not in (select dst from e)
         union select e.dst, l.level + 1 from l join e on e.src = l.node)
       select node, max(level) as layer from l group by 1""",
)(lambda fx: graph.dag_layers(fx.edges))
register(
    "g7_segment_entries",
    """with s as (select distinct pipeline_id as run_id, prompt_id as node from fx_nodes), k as (select * from s where node % 50 = 3), o as (select * from s where run_id not in (select run_id from k))
       select run_id, node from k union select run_id, node from o where not exists (select 1 from fx_edges e join o p on p.node = e.src where e.dst = o.node and p.run_id = o.run_id and e.src <> e.dst)""",
)(lambda fx: graph.segment_entries(fx.nodes.select(F.col("pipeline_id").alias("run_id"), F.col("prompt_id").alias("node")), fx.edges, fx.nodes.select(F.col("prompt_id").alias("node")).where("node % 50 = 3")))
register(
    "g8_impact_status_map",
    """with recursive e as (select distinct src, dst from fx_edges), r(start, node) as (select src, dst from e union select r.start, e.dst from r join e on e.src = r.node),
         n as (select src as id from e union select dst from e), m as (select start, string_agg(cast(node as varchar), ',' order by node) as nodes from r where node <> start group by 1)
       select p.id as prompt_id, case when p.id in (select id from n) then coalesce(m.nodes, '') end as nodes from fx_prompts p left join m on m.start = p.id""",
)(
    lambda fx: graph.impact_status_map(
        fx.prompts.select(F.col("id").alias("prompt_id")),
        fx.nodes,
        graph.downstream_impact(fx.edges, fx.edges.select(F.col("src").alias("start")).distinct()),
    ).select("prompt_id", F.array_join(F.map_keys("statuses"), ",").alias("nodes"))
)
