"""Queries of the code-corpus jobs, over source files that fixtures derive from the customer table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import corpus
from quillspark.plans.registry import register
from quillspark.storage import exists, materialise_at


#: Facts and sites of a session and a data folder, which all queries of it start from.
_SHARED: dict[tuple, tuple[str, object]] = {}


def _shared(fx, what: str, make):
    """``make()``'s ``(path, value)``, made again if its table is gone."""
    key = (fx.spark.sparkContext.applicationId, fx.sf_dir, what)
    if key not in _SHARED or not exists(fx.spark, _SHARED[key][0]):
        _SHARED[key] = make()
    return _SHARED[key][1]


def _facts(fx) -> corpus.Facts:
    def make():
        facts = corpus.Facts(fx.code_files)
        return facts.path, facts

    return _shared(fx, "facts", make)


def _sites(fx):
    def make():
        sites, path = materialise_at(corpus.prompt_sites(_facts(fx)), "sites")
        return path, sites

    return _shared(fx, "sites", make)


def _with_sites(rule):
    def run(fx):
        return rule(_facts(fx), _sites(fx))

    return run


def _lines(df):
    """Edges by file and line, as call ids hold columns too."""
    at = lambda c: F.split(c, ":")[1].cast("int")
    return df.select(F.split("src", ":")[0].alias("file"), at("src").alias("src_line"), at("dst").alias("dst_line"), "kind", "confidence")


_F = "select file, file_id, shape from fx_code_files"
register(
    "k1_facts",
    """select file, n.fact, n.n from fx_code_files join (values (0, 'import', 1), (0, 'scope', 1), (0, 'call', 2), (0, 'assign', 2), (1, 'import', 1), (1, 'scope', 1), (1, 'call', 2), (1, 'assign', 3),
         (2, 'call', 3), (2, 'assign', 2), (2, 'pipe', 2), (3, 'warning', 1), (4, 'assign', 2), (4, 'dict', 2), (5, 'import', 1), (5, 'scope', 2), (5, 'call', 5), (5, 'assign', 2), (6, 'scope', 7), (6, 'call', 10), (6, 'assign', 2)) n(shape, fact, n) on n.shape = fx_code_files.shape""",
)(
    lambda fx: (lambda f: f._all.where("fact in ('import', 'scope', 'call', 'assign', 'pipe', 'warning') or (fact = 'dict' and not array_contains(items, 'role'))").groupBy("file", "fact").agg(F.count("*").alias("n")))(_facts(fx))
)
register(
    "k2_sdk_calls",
    "select file, case shape when 0 then 4 else 6 end as line, case shape when 0 then 'openai' else 'anthropic' end as provider from fx_code_files where shape in (0, 1)",
)(lambda fx: corpus.match_sdk_calls(_facts(fx)).select("file", "line", "provider"))
register(
    "k3_wrapper_calls",
    """select file, l.line, l.provider from fx_code_files join (values (0, 5, 'openai'), (2, 1, 'unknown'), (2, 1, 'unknown'), (5, 3, 'unknown'), (5, 5, 'unknown'), (6, 6, 'unknown'), (6, 8, 'unknown'), (6, 10, 'unknown')) l(shape, line, provider) on l.shape = fx_code_files.shape""",
)(lambda fx: (lambda f: corpus.match_wrapper_calls(f, corpus.match_sdk_calls(f)).select("file", "line", "provider"))(_facts(fx)))
register("k4_templates", "select file, case shape when 0 then 'SYSTEM_PROMPT' else 'build_x_messages' end as name, case shape when 0 then 'constant' else 'builder' end as origin from fx_code_files where shape in (0, 1)")(
    lambda fx: corpus.match_templates(_facts(fx)).select("file", "name", "origin")
)
register(
    "k5_prompt_sites",
    """select file, l.line, l.origin, l.confidence, l.n as n_messages from fx_code_files join (values (0, 2, 'constant', 'high', 1), (0, 4, 'sdk', 'high', 2), (0, 5, 'wrapper', 'high', 1), (1, 3, 'builder', 'medium', 1), (1, 6, 'sdk', 'high', 2),
         (2, 1, 'wrapper', 'high', 1), (2, 1, 'wrapper', 'high', 1), (5, 3, 'wrapper', 'high', 1), (5, 5, 'wrapper', 'high', 1), (6, 6, 'wrapper', 'high', 1), (6, 8, 'wrapper', 'high', 1), (6, 10, 'wrapper', 'high', 1)) l(shape, line, origin, confidence, n)
       on l.shape = fx_code_files.shape""",
)(lambda fx: _sites(fx).select("file", "line", "origin", "confidence", "n_messages"))


def _upgraded(facts):
    templates = corpus.match_templates(facts)
    said = corpus.site_messages(facts, templates).join(templates.where("origin = 'builder'").select("id", "file", "scope"), "id")
    return corpus.resolve_names(said, facts).select("file", "pos", "role", "kind", "text")


register("k6_upgrade_builders", "select file, 'user' as role, 'literal' as kind, 'calm ' || file_id as text from fx_code_files where shape = 1")(
    lambda fx: _upgraded(_facts(fx)).drop("pos")
)
register(
    "k6_helper_returns",
    """select file, pos, role, kind, case when kind = 'literal' and word <> 'ask' then word || file_id else word end as text from fx_helper_files join (values
         (0, 1, 'assistant', 'literal', 'Rules '), (0, 2, 'user', 'unresolved', 'q'), (1, 1, 'system', 'literal', 'Brief '), (1, 2, 'user', 'literal', 'ask'), (2, 1, 'user', 'unresolved', '_outer()'),
         (3, 1, 'user', 'unresolved', 'a'), (4, 1, 'system', 'fstring', '{q} twice'), (4, 2, 'user', 'literal', 'Late ')) v(shape, pos, role, kind, word) on v.shape = fx_helper_files.shape""",
)(lambda fx: _upgraded(corpus.Facts(fx.helper_files)))


def _links(facts, sites):
    return corpus.link_wrappers(facts, sites, corpus.match_templates(facts)).select(F.split("id", ":")[0].alias("file"), "builder")


register("k7_link_wrappers", "select file, file || ':build_x_messages' as builder from fx_code_files where shape = 1")(lambda fx: _links(_facts(fx), _sites(fx)))
register("k7_imported_builders", "select file, 's' || project || '/prompts.py:build_n_messages' as builder from fx_symbol_files where part = 6 and shape <> 1")(
    lambda fx: (lambda f: _links(f, corpus.prompt_sites(f)))(corpus.Facts(fx.symbol_files))
)


def _expression_texts(fx):
    facts = corpus.Facts(fx.expr_files)
    held = facts.of("assign").where("name like '%_PROMPT'").select("file", "name", F.col("value").alias("kind"), "text", F.array_join("items", ",").alias("vars"))
    said = facts.of("message").where("pos <> 0 and items is not null")
    return held.unionByName(said.select("file", F.concat(F.lit("message "), "pos").alias("name"), F.col("value").alias("kind"), "text", F.array_join("items", ",").alias("vars")))


register(
    "k1_expression_texts",
    """select file, 'X_PROMPT' as name, case shape when 1 then 'literal' when 3 then 'fstring' when 6 then 'jinja2' when 8 then 'call' else 'concat' end as kind,
         case shape when 0 then head || '{who}' || tail when 1 then head when 2 then head || '{user.name}{<expr>}' || tail when 3 then head || '{name}' || tail
           when 4 then head || tail || '{<expr>}{z}{z}{<expr>}' when 6 then head || '{{ user }}' else 'dedent' end as text,
         case shape when 0 then 'who' when 1 then '' when 2 then 'user.name' when 3 then 'name' when 4 then 'z' end as vars
       from fx_expr_files where shape not in (5, 7)
       union all select file, 'Y_PROMPT', 'concat', head || '{<expr>}', '' from fx_expr_files where shape = 8
       union all select file, 'message -1', 'fstring', head || chr(10) || chr(10) || '<image>' || chr(10) || chr(10) || 't{tail}', 'tail' from fx_expr_files where shape = 5
       union all select file, 'message 1', 'concat', tail || '{q}', 'q' from fx_expr_files where shape = 5""",
)(_expression_texts)
register("k6_upgraded_expressions", "select file, 'user' as role, 'concat' as kind, head || '{q}' as text from fx_expr_files where shape = 7")(lambda fx: _upgraded(corpus.Facts(fx.expr_files)).drop("pos"))
register(
    "k1_call_parameters",
    """select file, 'm' || file_id as model, -0.5::double as temperature, cast(file_id as bigint) as max_tokens, cast(null as double) as top_p, 'json_object' as response_format,
         'foo=[1, 2];max_output_tokens=' || file_id || ';stop=' || chr(39) || 'x' || chr(39) as extra from fx_expr_files where shape = 5""",
)(
    lambda fx: corpus.call_parameters(corpus.Facts(fx.expr_files))
    .where("model is not null")
    .select(F.split("id", ":")[0].alias("file"), "model", "temperature", "max_tokens", "top_p", "response_format", F.array_join(F.transform(F.map_entries("extra"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("extra"))
)
register(
    "k9_input_shapes",
    """select file, l.line, l.f as function, l.args, l.doc from fx_code_files join (values (0, 2, null, null, null), (0, 4, 'ask', 'q: str,n', ''), (0, 5, 'ask', 'q: str,n', ''), (1, 3, 'build_x_messages', 'q', ''), (1, 6, null, null, null),
         (2, 1, null, null, null), (2, 1, null, null, null), (5, 3, 'f', '', ''), (5, 5, 'g', 'v', ''), (6, 6, 'p', '', ''), (6, 8, 'q', '', ''), (6, 10, 'r', '', '')) l(shape, line, f, args, doc) on l.shape = fx_code_files.shape""",
)(
    lambda fx: _with_sites(corpus.input_shapes)(fx).select("file", "line", F.substring_index("function", ".", -1).alias("function"), F.array_join("args", ",").alias("args"), "doc")
)
register(
    "k10_mine_cases",
    """with d as (select split_part(file, '/', 1) as project, case l.line when 1 then '{"input": "v' || file_id || '", "n": "2"}' else l.text end as inputs, file, l.line from fx_code_files
           join (values (4, 1, ''), (0, 4, '{"role": "system", "content": "Hi"}'), (5, 3, '{"role": "user", "content": "1"}'), (5, 5, '{"role": "user", "content": "2"}')) l(shape, line, text) on l.shape = fx_code_files.shape),
         o as (select project, inputs, min((file, line)) as a from d group by 1, 2), r as (select *, row_number() over (partition by project order by a, inputs) as k from o)
       select project, s.site, inputs, a[1] as file, a[2] as line from r cross join (values ('s1'), ('s2')) s(site) where k <= 2""",
)(
    lambda fx: corpus.mine_cases(
        _facts(fx), fx.code_files.select(F.split("file", "/")[0].alias("project")).distinct().select("project", F.explode(F.array(F.lit("s1"), F.lit("s2"))).alias("site")), 2, None
    ).select("project", "site", "inputs", "file", "line")
)
register(
    "k10_json_cases",
    """with o as (select split_part(file, '/', 1) as project, file, case shape when 0 then '{"n":2,"question":"q' || file_id || '"}' else '{"id":' || file_id || ',"input":{"a":1}}' end as inputs from fx_json_files where shape in (0, 1)),
         r as (select *, row_number() over (partition by project order by file, inputs) as k from o)
       select project, 's' as site, inputs, file, 1 as line from r where k <= 3""",
)(
    lambda fx: corpus.mine_cases(
        _facts(fx), fx.json_files.select(F.split("file", "/")[0].alias("project")).distinct().withColumn("site", F.lit("s")), 3, files=fx.json_files
    ).select("project", "site", "inputs", "file", "line")
)
_EDGE = "select file, {0} as src_line, {1} as dst_line, '{2}' as kind, '{3}' as confidence from fx_code_files where shape = {4}"
register("d1_variable_edges", _EDGE.format(4, 5, "variable", "high", 0))(lambda fx: _lines(_with_sites(corpus.variable_edges)(fx)))
register("d2_function_edges", _EDGE.format(3, 5, "function", "high", 5))(lambda fx: _lines(_with_sites(corpus.function_edges)(fx)))
_PIPE = f"{_EDGE.format(1, 1, 'lc_pipe', 'high', 2)} and file_id % 2 = 1"  # the others have an unknown operand between
register("d3_pipe_edges", _PIPE)(lambda fx: _lines(_with_sites(corpus.pipe_edges)(fx)))
register("d4_engine_edges", _EDGE.format(3, 5, "query_engine", "low", 5))(lambda fx: _lines(_with_sites(corpus.engine_edges)(fx)))
_CHAIN = f"{_EDGE.format(6, 8, 'method_chain', 'low', 6)} union all {_EDGE.format(8, 10, 'method_chain', 'low', 6)}"
register("d5_method_chain_edges", _CHAIN)(lambda fx: _lines(_with_sites(corpus.method_chain_edges)(fx)))
_CROSS = "select file, 6 as src_line, 6 as dst_line, 'cross_file' as kind, 'medium' as confidence from fx_code_files where file_id % 14 = 6 and file_id + 350 <= (select max(file_id) from fx_code_files)"
register("d6_cross_file_edges", _CROSS)(lambda fx: _lines(_with_sites(corpus.cross_file_edges)(fx)))
register(
    "d6_imported_classes",
    "select 's' || project || '/app/agents/planner.py:3' as src, 's' || project || '/app/agents/engine.py:3' as dst from fx_symbol_files where part = 3 and shape <> 1",
)(
    lambda fx: (lambda f: corpus.cross_file_edges(f, corpus.prompt_sites(f)).select(*[F.array_join(F.slice(F.split(c, ":"), 1, 2), ":").alias(c) for c in ("src", "dst")]))(corpus.Facts(fx.symbol_files))
)
register(
    "d7_corpus_edges",
    " union all ".join([_EDGE.format(4, 5, "variable", "high", 0), _EDGE.format(3, 5, "function", "high", 5), _PIPE, _EDGE.format(3, 5, "query_engine", "low", 5), _CHAIN, _CROSS]),
)(lambda fx: _lines(_with_sites(corpus.corpus_edges)(fx)))
register("d7_warnings", "select file, 'W001-unparseable' as name from fx_code_files where shape = 3")(lambda fx: corpus.warnings(_facts(fx)).select("file", "name"))
