"""Tables of the prompt-operations data model, derived from the general test tables by plain SQL.

Every statement is accepted by Spark and DuckDB alike, so each registered query can be held against an
independent engine. On a real deployment these tables come from :mod:`quillspark.sources.tables`.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: View name -> SQL over the base tables and earlier views.
SQL: dict[str, str] = {
    "fx_runs": """
select o_orderkey as run_id, 'prompt' as target_kind, o_custkey as target_id,
  cast(floor((row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1) / 3) as bigint) + 1 as target_version,
  o_orderdate as started_at, case o_orderstatus when 'F' then 'done' when 'O' then 'running' else 'failed' end as status,
  floor(o_totalprice) / 1000000 as cost_usd
from orders""",
    "fx_prompt_versions": """
select target_id as prompt_id, target_version as version, min(started_at) as created_at,
  case when target_version > 1 then target_version - 1 end as parent_version,
  case when target_version % 2 = 1 then 'human' else 'iteration' end as created_by,
  concat('Be brief v', target_version, '. Answer {question} for {{ user }}') as template
from fx_runs group by target_id, target_version""",
    "fx_scores": """
select l_orderkey as run_id, l_linenumber as case_index,
  case l_returnflag when 'A' then 'rule' when 'N' then 'llm' else 'human' end as judge_kind,
  concat('j', l_suppkey % 3) as judge_name, case when min(l_tax) > 0 then max(l_discount) * 10 end as score
from lineitem group by 1, 2, 3, 4""",
    "fx_outputs": """
select l_orderkey as run_id, l_linenumber as case_index,
  case when max(l_quantity) <= 45 then concat('out-', max(l_partkey)) end as text,
  case when max(l_quantity) > 45 then 'RuntimeError: boom' end as error,
  cast(max(l_quantity) as bigint) as input_tokens, cast(min(l_quantity) as bigint) * 2 as output_tokens,
  case max(l_suppkey) % 4 when 0 then 'openai' when 1 then 'anthropic' else 'openai-compat' end as provider,
  case max(l_suppkey) % 4 when 0 then 'gpt-4o' when 1 then 'claude-sonnet-4-6' when 2 then 'deepseek-chat' else 'no-such-model' end as model
from lineitem group by 1, 2""",
    "fx_feedback": """
select event_id as id, event_id * 2 as run_id, 1 + event_id % 7 as case_index,
  case event_type when 'purchase' then 1 when 'error' then -1 else 0 end as rating,
  case when event_type = 'error' then props end as critique, ts as created_at
from events""",
    "fx_iterations": """
select o_orderkey as id, o_custkey as prompt_id, concat(o_custkey, '-', year(o_orderdate)) as session_id,
  row_number() over (partition by o_custkey, year(o_orderdate) order by o_orderdate, o_orderkey) as round,
  floor((floor(o_totalprice) % 1000) / 250) / 4 as weighted_score,
  case when o_orderpriority like '5%' then 'failed' else 'auto' end as revise_mode, o_orderdate as started_at
from orders""",
    "fx_edges": """
select src, dst, kind, confidence, detector from (
  select p_partkey as src, p_partkey * 2 + 1 as dst, case p_size % 3 when 0 then 'variable' when 1 then 'function' else 'lc_pipe' end as kind,
    case p_size % 2 when 0 then 'high' else 'medium' end as confidence, 1 as detector from part
  union all select p_partkey, p_partkey * 3 + 2, 'function', 'medium', 2 from part
  union all select p_partkey, p_partkey * 2 + 1, 'function', 'low', 3 from part where p_partkey % 5 = 0) e
where src % 7 <> 0 and dst < (select count(*) from part)""",
    "fx_cases": """
select doc_id as case_id, doc_id % 10 as prompt_id, lang, source, text as body,
  'Summarise {lang} text from {source}: {{ body }} {missing}' as template
from documents""",
    "fx_judge_replies": """
select doc_id as case_id, case doc_id % 5
  when 0 then concat('{"accuracy": ', quality, ', "relevance": "0.5", "safety": 1.2, "critique": "c', doc_id, '"}')
  when 1 then concat('```json {"accuracy": 0.75, "relevance": ', toxic, ', "format": true}```')
  when 2 then concat('Sure: {"accuracy": 0.25, "critique": "low"} thanks')
  when 3 then 'not json' else '[1, 2]' end as reply
from labels""",
    "fx_config_files": """
select concat('p', c_custkey % 50, '/', case c_custkey % 3 when 0 then '.env' when 1 then 'config.yaml' else 'notes.txt' end) as file, c_custkey as file_id,
  concat('# header', chr(10), case c_custkey % 4 when 0 then 'export OPENAI_API_KEY=x' when 1 then 'ANTHROPIC_API_KEY: env' when 2 then 'DB_URL=1' else '#OPENAI_API_KEY=x' end, chr(10), 'LLAMAINDEX_CACHE', c_custkey % 2, '=1', chr(10), 'LLAMAINDEX_CACHE', c_custkey % 2, '=2') as content
from customer""",
    "fx_prompts": """
select c_custkey as id, concat('prompt_', c_custkey % 400) as name,
  case c_custkey % 3 when 0 then 'openai' when 1 then 'anthropic' else 'unknown' end as provider,
  concat('p', c_custkey % 50, '/src/f', c_custkey, '.py') as file, cast(1 + c_custkey % 90 as int) as line,
  case when c_custkey % 4 = 0 then c_mktsegment end as purpose,
  case c_custkey % 3 when 0 then 'high' when 1 then 'medium' else 'low' end as confidence,
  case when c_custkey % 5 = 0 then 'unresolved' else 'literal' end as template_kind,
  concat('rules ', c_custkey) as system_text, concat('do {x} for ', c_custkey) as user_text,
  c_custkey % 50 as project
from customer""",
    "fx_code_files": r"""
select concat('p', c_custkey % 50, '/f', c_custkey, '.py') as file, c_custkey as file_id, c_custkey % 7 as shape, case c_custkey % 7
  when 0 then concat('import openai', chr(10), 'SYSTEM_PROMPT = "Be kind ', c_custkey, '"', chr(10), 'def ask(q: str, n=1):', chr(10), '    r = client.chat.completions.create(model="m", messages=[{"role": "system", "content": "Hi"}, {"role": "user", "content": q}])', chr(10),
    '    return self.llm.invoke(prompt="next", context=r)', chr(10))
  when 1 then concat('import anthropic', chr(10), 'TONE = "calm ', c_custkey, '"', chr(10), 'def build_x_messages(q):', chr(10), '    return [{"role": "user", "content": TONE}]', chr(10), 'ms = build_x_messages(1)', chr(10), 'out = client.messages.create(system="Sys", messages=ms)', chr(10))
  when 2 then concat('a = llm.invoke(prompt="a") |', case when c_custkey % 2 = 0 then ' x |' else '' end, ' llm.invoke(prompt="b")', chr(10), 'y = client.messages.create(messages=[1])', chr(10))
  when 3 then concat('def broken(:', chr(10), c_custkey)
  when 4 then concat('data = {"input": "v', c_custkey, '", "n": "2"}', chr(10), 'other = {"zzz": 1}', chr(10))
  when 5 then concat('from llama_index.core import X', chr(10), 'def f():', chr(10), '    return llm.chat(messages=[{"role": "user", "content": "1"}])', chr(10), 'def g(v):', chr(10), '    z = llm.chat(messages=[{"role": "user", "content": "2"}])', chr(10), '    return z', chr(10),
    'e = idx.as_query_engine()', chr(10), 'g(f())', chr(10))
  else concat('class C', c_custkey, ':', chr(10), '    def __init__(self, k: int):', chr(10), '        self.a = C', c_custkey, '()', chr(10), '        self.b = C', c_custkey + case when c_custkey % 14 = 6 then 350 else 7 end, '()', chr(10),
    '    def p(self):', chr(10), '        return self.llm.run(prompt="p")', chr(10), '    def q(self):', chr(10), '        return self.llm.run(prompt="q")', chr(10), '    def r(self):', chr(10), '        return self.llm.run(prompt="r")', chr(10),
    '    def go(self):', chr(10), '        self.p()', chr(10), '        if 1:', chr(10), '            self.q()', chr(10), '        self.r()', chr(10),
    '    def both(self):', chr(10), '        self.a.p()', chr(10), '        self.b.p()', chr(10)) end as content
from customer""",
    "fx_helper_files": r"""
select concat('p', s_suppkey % 20, '/h', s_suppkey, '.py') as file, s_suppkey as file_id, s_suppkey % 5 as shape, case s_suppkey % 5
  when 0 then concat('def _system():', chr(10), '    return {"role": "ai", "content": "Rules ', s_suppkey, '"}', chr(10), 'def build_y_messages(q):', chr(10), '    return [_system(), {"role": "human", "content": q}]', chr(10))
  when 1 then concat('RULES = "Brief ', s_suppkey, '"', chr(10), 'def _system():', chr(10), '    content = RULES', chr(10), '    return {"role": "system", "content": content}', chr(10), 'def build_y_messages(q):', chr(10), '    return [_system(), ("human", "ask")]', chr(10))
  when 2 then concat('def _inner():', chr(10), '    return {"role": "system", "content": "x"}', chr(10), 'def _outer():', chr(10), '    return _inner()', chr(10), 'def build_y_messages(q):', chr(10), '    return [_outer()]', chr(10))
  when 3 then concat('def build_y_messages(q):', chr(10), '    a = b', chr(10), '    b = a', chr(10), '    return [{"role": "user", "content": a}]', chr(10))
  else concat('def _head(q):', chr(10), '    t = f"{q} twice"', chr(10), '    return {"role": "system", "content": t}', chr(10), 'async def build_y_messages(q):', chr(10), '    s = "Early"', chr(10), '    s = "Late ', s_suppkey, '"', chr(10), '    u = s', chr(10), '    return [_head(q), {"role": "user", "content": u}]', chr(10)) end as content
from supplier""",
    "fx_expr_files": r"""
select concat('p', s_suppkey % 20, '/e', s_suppkey, '.py') as file, s_suppkey as file_id, s_suppkey % 9 as shape, s_name as head, concat(' call ', s_suppkey) as tail, case s_suppkey % 9
  when 0 then concat('X_PROMPT = "', s_name, '" + who + " call ', s_suppkey, '"', chr(10))
  when 1 then concat('X_PROMPT = dedent("', s_name, '").strip()', chr(10))
  when 2 then concat('X_PROMPT = textwrap.dedent(f"', s_name, '{user.name}{f(1)}" + " call ', s_suppkey, '")', chr(10))
  when 3 then concat('X_PROMPT = "', s_name, '{name} call ', s_suppkey, '".format(name=1).rstrip()', chr(10))
  when 4 then concat('X_PROMPT = "', s_name, '" + (" call ', s_suppkey, '" + dedent(y) + z + z).strip() + ""', chr(10))
  when 5 then concat('out = client.messages.create(model="m', s_suppkey, '", temperature=-0.5, max_output_tokens=', s_suppkey, ', response_format={"type": "json_object"}, stop="x", foo=[1, 2], top_p=True, ', chr(10),
    '  system=[{"type": "text", "text": "', s_name, '"}, {"type": "image"}, {"type": "text", "text": "t" + tail}], messages=[{"role": "user", "content": (" call ', s_suppkey, '" + q).strip()}])', chr(10))
  when 6 then concat('X_PROMPT = "', s_name, '{{ user }}"', chr(10))
  when 7 then concat('def build_e_messages(q):', chr(10), '    t = "', s_name, '" + q', chr(10), '    return [{"role": "user", "content": t}]', chr(10))
  else concat('X_PROMPT = dedent("', s_name, '", "b")', chr(10), 'Y_PROMPT = dedent("', s_name, '".strip() + "")', chr(10)) end as content
from supplier""",
    "fx_tree_files": """
select concat('r', s_suppkey % 3) as project, s_suppkey as file_id, s_suppkey % 9 as shape,
  case s_suppkey % 9 when 0 then concat('src/a', s_suppkey, '.py') when 1 then concat('e', s_suppkey, '/.env') when 2 then concat('src/tests/t', s_suppkey, '.py') when 3 then concat('p/.svn/x', s_suppkey, '.py') when 4 then concat('deep/er', s_suppkey, '/Config.yaml')
    when 5 then concat('notes', s_suppkey, '.txt') when 6 then concat('app/prod', s_suppkey, '.ENV') when 7 then concat('.hidden/h', s_suppkey, '.py') else concat('env/v', s_suppkey, '.py') end as file,
  concat('# ', s_name, chr(10), s_nationkey) as content
from supplier""",
    "fx_symbol_files": r"""
select concat('s', s_suppkey, '/', case f when 0 then 'app/agents/planner.py' when 1 then 'app/agents/engine.py' when 2 then 'app/agents/__init__.py' when 3 then 'app/runner.py' when 4 then 'aaa.py' when 5 then 'prompts.py' else 'use.py' end) as file,
  s_suppkey as project, s_suppkey % 4 as shape, f as part, case f
  when 0 then concat('class Planner:', chr(10), '    def plan(self):', chr(10), '        return self.llm.complete(prompt="plan")', chr(10))
  when 1 then concat('class ', case when s_suppkey % 4 = 1 then 'Other' else 'Engine' end, ':', chr(10), '    def run(self):', chr(10), '        return self.llm.complete(prompt="run")', chr(10))
  when 2 then concat('from .planner import Planner as Lead', chr(10))
  when 3 then concat(case s_suppkey % 4 when 3 then '' when 2 then concat('from app.agents import Lead as MyPlanner', chr(10), 'from .agents.engine import Engine', chr(10)) else concat('from app.agents.planner import Planner as MyPlanner', chr(10), 'from app.agents.engine import Engine', chr(10)) end,
    'class Runner:', chr(10), '    def __init__(self):', chr(10), '        self.a = ', case s_suppkey % 4 when 3 then 'Planner' else 'MyPlanner' end, '()', chr(10), '        self.b: Engine = Engine()', chr(10), '    def go(self):', chr(10), '        self.a.plan()', chr(10), '        self.b.run()', chr(10))
  when 4 then concat('class ', case when s_suppkey % 4 = 3 then 'Nothing' else 'Planner' end, ':', chr(10), '    pass', chr(10))
  when 5 then concat('def build_', case when s_suppkey % 4 = 1 then 'o' else 'n' end, '_messages(q):', chr(10), '    return [{"role": "user", "content": "hi"}]', chr(10))
  else concat(case s_suppkey % 4 when 3 then '' else concat('from prompts import build_n_messages as make', chr(10)) end, 'ms = ', case s_suppkey % 4 when 3 then 'build_n_messages' else 'make' end, '(1)', chr(10), 'out = llm.chat(messages=ms)', chr(10)) end as content
from supplier cross join (select p_partkey - 1 as f from part where p_partkey <= 7) k""",
    "fx_json_files": """
select concat('p', s_suppkey % 20, '/tests/d', s_suppkey, '.json') as file, s_suppkey as file_id, s_suppkey % 4 as shape, case s_suppkey % 4
  when 0 then concat('[{"question": "q', s_suppkey, '", "n": 2}, {"zzz": 1}, 5]') when 1 then concat(' {"input": {"a": 1}, "id": ', s_suppkey, '}') when 2 then 'no json {' else '"text"' end as content
from supplier""",
    "fx_nodes": """
select distinct src % 97 as pipeline_id, src as prompt_id from fx_edges
union select distinct src % 97, dst from fx_edges""",
}

BASE = ("customer", "orders", "lineitem", "part", "supplier", "events", "documents", "labels")
_WORD = re.compile(r"\b\w+\b")


def needs(sql: str) -> list[str]:
    """The fixture views that a statement uses, those they use first."""
    out: list[str] = []
    for name in _WORD.findall(sql):
        if name in SQL and name not in out:
            out += [x for x in [*needs(SQL[name]), name] if x not in out]
    return out


def with_views(sql: str, **extra: str) -> str:
    """``sql`` with the fixture views it uses as common table expressions, for a plain SQL engine."""
    body = sql.strip()
    ctes = ", ".join(f"{n} as ({SQL[n].strip()})" for n in needs(body))
    if not ctes:
        return body
    if body.lower().startswith("with recursive"):
        return f"with recursive {ctes}, {body[len('with recursive') :].strip()}"
    if body.lower().startswith("with"):
        return f"with {ctes}, {body[len('with') :].strip()}"
    return f"with {ctes} {body}"


class Fixtures:
    """Derived tables of one data folder as lazy DataFrames, without registering views globally."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in self._made:
            return self._made[name]
        if f"fx_{name}" not in SQL and name not in BASE:
            raise AttributeError(name)
        if name in BASE:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        else:
            sql = SQL[f"fx_{name}"]
            used = [b for b in BASE if re.search(rf"\b{b}\b", sql)] + [v[3:] for v in SQL if v != f"fx_{name}" and re.search(rf"\b{v}\b", sql)]
            frames = {f"t_{u}": getattr(self, u) for u in used}
            for u in used:
                sql = re.sub(rf"\b(?:fx_)?{u}\b(?!\s*\()", f"{{t_{u}}}", sql) if u in BASE else re.sub(rf"\bfx_{u}\b", f"{{t_{u}}}", sql)
            df = self.spark.sql(_escape(sql, frames), **frames)
        self._made[name] = df
        return df


def _escape(sql: str, frames: dict) -> str:
    """Braces that are not table references are doubled, as ``spark.sql`` formats its text."""
    marks = {f"{{{k}}}": f"\x00{k}\x01" for k in frames}
    for mark, hidden in marks.items():
        sql = sql.replace(mark, hidden)
    return sql.replace("{", "{{").replace("}", "}}").replace("\x00", "{").replace("\x01", "}")
