"""Sources, streams over several triggers, failing calls and code facts on hand-written rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillspark import storage
from quillspark.operators import cases, corpus, inference, judging
from quillspark.operators.iterations import Convergence
from quillspark.sources import tables, tree
from quillspark.sources.pyfacts import file_facts


def test_outputs_with_broken_and_blank_lines(spark, tmp_path):
    run = tmp_path / "run_id=r1"
    run.mkdir()
    (run / "a.json").write_text('{"case_index": 1, "text": "x"}\n\n{"case_index": "y"}\n{"case\n')
    good, bad = tables.read_outputs(spark, str(tmp_path))
    assert [(r.run_id, r.case_index, r.text) for r in good.collect()] == [("r1", 1, "x")]
    assert sorted(r.line for r in bad.collect()) == ['{"case', '{"case_index": "y"}']


@pytest.mark.parametrize("slices", [1, 4, 256])
def test_corpus_leaves_ignored_folders_and_other_files_out(spark, tmp_path, slices):
    kept = {"a.py": "python", "src/b.py": "python", "src/app.env": "env", "config.yaml": "config", ".env": "env", "x/y/z/.env.Local": "env", "x/Settings.YML": "config", "x/config.py": "python", "x/.hidden/c.py": "python", "_x/_y.py": "python"}
    for name in (*kept, ".git/c.py", "src/tests/d.py", "test/e.py", "x/.svn/f.py", "env/g.py", "notes.txt", "x/a.pyc"):
        at = tmp_path / "one" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(f"# {name}")
    (tmp_path / "one/bad.py").write_bytes(b"# \xff\n")
    (tmp_path / "one/loop").symlink_to(tmp_path / "one")
    (tmp_path / "two").mkdir()
    (tmp_path / "two/a.py").write_text("2")
    roots = [f"{tmp_path}/one/", f"file://{tmp_path}/two", f"{tmp_path}/none"]
    got = {(r.project, r.file): (r.kind, r.content) for r in tree.load_corpus(spark, roots, slices=slices).collect()}
    one = f"{tmp_path}/one"
    assert got == {(one, f): (k, f"# {f}") for f, k in kept.items()} | {(one, "bad.py"): ("python", "# \ufffd\n"), (f"file://{tmp_path}/two", "a.py"): ("python", "2")}
    assert len(tree.load_corpus(spark, [one], ["x", "src"]).where("kind = 'python'").collect()) == 6


def test_tables_that_were_never_written_are_empty(spark, tmp_path):
    stored = tables.Tables(spark, str(tmp_path))
    assert stored.read("runs").count() == 0
    stored.append("scores", spark.createDataFrame([("r", 0, "llm", "j", 0.5, None)], tables.SCHEMAS["scores"]))
    assert stored.read("scores").count() == 1


def test_a_failing_call_fails_no_other_row(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None)], "id int, prompt string")
    got = {r.id: (r.reply, r.error) for r in inference.call_model(df, F.col("prompt"), inference.EchoBackend(fail_on="bad")).collect()}
    assert got == {1: ("echo: ok", None), 2: (None, "RuntimeError: refused"), 3: (None, "no prompt")}


def test_a_case_ends_at_its_first_failing_node(spark):
    prompts = spark.createDataFrame([(1, 1, "{q}"), (1, 2, "then {a}")], "pipeline_id long, node long, template string")
    edges = spark.createDataFrame([(1, 2, "a", 0)], "src long, dst long, via string, pos int")
    data = spark.createDataFrame([(1, 0, {"q": "fine"}), (1, 1, {"q": "bad"})], "pipeline_id long, case_index int, inputs map<string,string>")
    got = {(r.node, r.case_index): r.text for r in inference.run_pipelines(prompts, edges, data, inference.EchoBackend(fail_on="bad")).collect()}
    assert got == {(1, 0): "echo: fine", (1, 1): None, (2, 0): "echo: then echo: fine"}


def test_invalid_dimension_lists_count_as_absent(spark):
    prompts = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "prompt_id int, project string")
    project = spark.createDataFrame([("p", "tone", 1.0)], "project string, dimension string, weight double")
    own = spark.createDataFrame([(1, "x", 0.5), (2, "y", 0.5), (2, " ", 0.5), (3, "z", None)], "prompt_id int, dimension string, weight double")
    got = sorted((r.prompt_id, r.dimension) for r in judging.active_dimensions(prompts, project, own).collect())
    assert got == [(1, "x"), (2, "tone"), *[(3, d) for d in ("accuracy", "format", "relevance", "safety")]]


def test_replies_that_list_cases(spark):
    replies = ['[{"a": 1}, 2, null]', "none", "[", "[]", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "id int, r string")
    got = {r.id: r.o for r in df.select("id", cases.json_objects(F.col("r")).alias("o")).collect()}
    assert got == {0: ['{"a":1}'], 1: None, 2: None, 3: [], 4: None}


def test_negative_tolerance_is_refused(spark):
    df = spark.createDataFrame([(1, 0.5)], "node int, score double")
    with pytest.raises(ValueError):
        judging.assess_status(df, df, -0.1)


def test_file_facts():
    assert [r["fact"] for r in file_facts("f", "def (")] == ["warning"]
    assert file_facts("f", None) == []
    rows = file_facts("f", 'x = {"input": "a", "n": [1]}\nasync def g(q):\n    y = await c.chat(prompt=f"hi {q}")\n    return y\n')
    assert [json.loads(r["text"]) for r in rows if r["fact"] == "dict"] == [{"input": "a", "n": [1]}]
    assert [(r["value"], r["text"]) for r in rows if r["fact"] == "message"] == [("fstring", "hi {q}")]
    assert [(r["name"], r["value"]) for r in rows if r["fact"] == "assign"] == [("x", "other"), ("y", "call")]


def test_an_empty_corpus(spark):
    facts = corpus.Facts(spark.createDataFrame([], "file string, content string"))
    assert corpus.prompt_sites(facts).count() == 0


def test_names_in_a_loop_stay_unresolved(spark):
    code = 'A = B\nB = A\nC = D\nD = "text"\ndef build_x_prompt(q):\n    return [{"role": "user", "content": A}, {"role": "user", "content": C}]\n'
    facts = corpus.Facts(spark.createDataFrame([("f.py", code)], "file string, content string"))
    templates = corpus.match_templates(facts)
    said = corpus.site_messages(facts, templates).join(templates.select("id", "file", "scope"), "id")
    got = sorted((r.pos, r.kind, r.text) for r in corpus.resolve_names(said, facts).collect())
    assert got == [(1, "unresolved", "A"), (2, "literal", "text")]


def test_the_critic_reads_what_the_judge_said(spark):
    """From the second round on, the loop's critic gets weak dimensions, worst critiques and users' notes."""

    class Quoting:
        def chat(self, prompt, temperature, max_tokens):
            return json.dumps({"revised_template": prompt.split("Feedback:\n", 1)[1].split("\n\nWeights", 1)[0], "rationale": "quoted"})

    class Judge:
        def chat(self, prompt, temperature, max_tokens):
            return json.dumps({"accuracy": 0.5, "relevance": 1.0, "critique": "too short"})

    prompts = spark.createDataFrame([(1, "Hi {q}")], "session_id long, template string")
    asked = spark.createDataFrame([(1, 0, {"q": "a"}), (1, 1, {"q": "b"})], "session_id long, case_index long, inputs map<string,string>")
    notes = spark.createDataFrame([(1, 0, "down", ""), (1, 1, None, "be kind"), (1, 2, "up", "fine")], "session_id long, case_index long, thumb string, note string")
    got = inference.iterate_sessions(prompts, asked, [("accuracy", 0.5), ("relevance", 0.5)], inference.EchoBackend(), Judge(), Quoting(), Convergence(max_rounds=2), notes)
    texts = {r.round: r.template for r in got.collect()}
    assert texts[1] == "Hi {q}"
    assert texts[2] == "\n\n".join(
        ["Weak dimensions:\n- accuracy", "Worst cases:\n- case 0: too short\n- case 1: too short", "Thumbs down:\n- case 0: (no note)", "Notes:\n- case 1: be kind"]
    )


def test_sessions_are_not_broadcast(spark, monkeypatch):
    """Tables with a row a session are small files, but go through no broadcast; a reply is parsed once, not in every branch."""
    plans, real = [], storage.materialise_at

    def kept(df, name, rows=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name, rows)

    for module in (storage, inference):
        monkeypatch.setattr(module, "materialise_at", kept)

    class Judge:
        def chat(self, prompt, temperature, max_tokens):
            return json.dumps({"accuracy": 0.5})

    class Critic:
        def chat(self, prompt, temperature, max_tokens):
            return json.dumps({"revised_template": "again"})

    path = storage.new_path(spark, "given")
    spark.range(50).selectExpr("id as session_id", "'Hi {q}' as template").write.parquet(f"{path}/prompts")
    spark.range(50).selectExpr("id as session_id", "0L as case_index", "map('q', 'a') as inputs").write.parquet(f"{path}/cases")
    got = inference.iterate_sessions(spark.read.parquet(f"{path}/prompts"), spark.read.parquet(f"{path}/cases"), [("accuracy", 1.0)], inference.EchoBackend(), Judge(), Critic())
    assert got.where("reason = 'stagnation' and round = 3").count() == 50
    assert sum("SortMergeJoin" in p for p in plans) >= 8 and not any("Broadcast" in p for p in plans)
    read = spark.createDataFrame([("x",)], "reply string").select(judging.critic_reply(F.col("reply")).alias("r"))
    assert read._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") <= 2


def test_sessions_end_each_by_its_own_rule(spark):
    """A failed critic, a gain and flat scores end sessions in different rounds; no session at all gives no row."""

    class Critic:
        def chat(self, prompt, temperature, max_tokens):
            said = prompt.split("Template: ", 1)[1].split("\n\n", 1)[0]
            return "no object" if said.startswith("lost") else json.dumps({"revised_template": said + "+", "rationale": "r"})

    class Judge:
        def chat(self, prompt, temperature, max_tokens):
            return json.dumps({"accuracy": 0.5 if "gain" not in prompt else 0.9 if "gain++" in prompt else 0.4})

    prompts = spark.createDataFrame([(1, "lost"), (2, "gain"), (3, "flat")], "session_id long, template string")
    asked = spark.createDataFrame([(i, 0, {"q": "a"}) for i in (1, 2, 3)], "session_id long, case_index long, inputs map<string,string>")
    run = lambda p: inference.iterate_sessions(p, asked, [("accuracy", 1.0)], inference.EchoBackend(), Judge(), Critic())
    got = sorted((r.session_id, r.round, r.weighted_score, r.revise_mode, r.reason) for r in run(prompts).collect())
    assert [g[:4] for g in got] == [(1, 1, 0.5, "auto"), (1, 2, 0.0, "failed"), (2, 1, 0.4, "auto"), (2, 2, 0.4, "auto"), (2, 3, 0.9, "auto"), *[(3, n, 0.5, "auto") for n in (1, 2, 3)]]
    assert [g[4] for g in got] == [None, None, None, None, "delta", None, None, "stagnation"]
    assert run(prompts.where("session_id < 0")).count() == 0


def test_run_modes_reject_what_is_not_there(spark):
    prompts = spark.createDataFrame([(1, 1, "{q}"), (1, 2, "then {a}")], "pipeline_id long, node long, template string")
    schema = "pipeline_id long, mode string, node long, segment array<long>"
    for row in [(1, "all", None, None), (1, "node", None, None), (1, "segment", None, []), (1, "node", 9, None), (1, "segment", None, [1, 9]), (1, None, None, None)]:
        with pytest.raises(ValueError):
            inference.select_nodes(prompts, spark.createDataFrame([row], schema))
    with pytest.raises(ValueError):
        inference.generate_cases("context", prompts, prompts, inference.EchoBackend(), 1)


def test_paths_that_are_not_there_have_no_rows(spark, tmp_path):
    good, bad = tables.read_outputs(spark, f"{tmp_path}/none")
    assert good.count() == 0 and bad.count() == 0 and good.columns[:2] == ["run_id", "case_index"]
    assert tables.read_cases(spark, f"file://{tmp_path}/none").count() == 0


def test_stored_cases_are_appended_once(spark, tmp_path):
    schema = tables.CASE
    case = lambda i: (i, "p", {"q": i}, None, ["t"], "seed", None)
    path = str(tmp_path / "cases")
    tables.append_cases(spark.createDataFrame([case("a"), case("b")], schema), path, tables.read_cases(spark, path))
    tables.append_cases(spark.createDataFrame([case("b"), case("c")], schema), path, tables.read_cases(spark, path))
    assert sorted(r.id for r in tables.read_cases(spark, path).collect()) == ["a", "b", "c"]


def test_environment_files_in_any_case(spark):
    files = spark.createDataFrame([("p/APP.ENV", "OPENAI_API_KEY=x"), ("p/Settings.YAML", "ANTHROPIC_API_KEY: y"), ("p/readme.md", "OPENAI_API_KEY=x")], "file string, content string")
    from quillspark.operators.inventory import provider_evidence

    assert sorted((r.file, r.provider) for r in provider_evidence(files).collect()) == [("p/APP.ENV", "openai"), ("p/Settings.YAML", "anthropic")]


def test_scan_of_a_corpus(spark):
    """D7 as a whole: sites, edges, pipelines, evidence and warnings of a few files."""
    chain = 'import openai\nr = client.chat.completions.create(messages=[{"role": "human", "content": "Hi"}])\nclient.chat.completions.create(messages=[{"role": "user", "content": r}])\n'
    files = spark.createDataFrame([("p/a.py", chain), ("p/b.py", "def broken(:"), ("p/.env", "OPENAI_API_KEY=x")], "file string, content string")
    got = {k: v.collect() for k, v in corpus.scan_corpus(files.where("file not like '%.env'")).items()}
    assert [(r.line, r.provider) for r in sorted(got["sites"], key=lambda r: r.line)] == [(2, "openai"), (3, "openai")]
    assert [(r.kind, r.confidence) for r in got["edges"]] == [("variable", "high")]
    (pipe,) = got["pipelines"]
    ids = sorted(r.id for r in got["sites"])
    assert pipe.nodes.split(",") == ids and (pipe.entries, pipe.exits) == (got["edges"][0].src, got["edges"][0].dst) and pipe.name.endswith("_pipeline") and len(pipe.pipeline_id) == 12
    assert [r.file for r in got["warnings"]] == ["p/b.py"] and not got["evidence"]


def test_calls_leave_in_slices(spark, monkeypatch):
    """A batch that holds more than a slice's bytes is answered in parts: each row once, with its own columns."""
    monkeypatch.setattr(inference, "SLICE", 100)
    rows = spark.range(60).select("id", F.when(F.col("id") % 7 > 0, F.repeat(F.lit("x"), F.col("id").cast("int"))).alias("p"), F.array("id").alias("more"))
    got = sorted(tuple(r) for r in inference.call_model(rows, F.col("p"), inference.EchoBackend()).collect())
    assert got == [(k, "x" * k if k % 7 else None, [k], f"echo: {'x' * k}" if k % 7 else None, None if k % 7 else "no prompt") for k in range(60)]
