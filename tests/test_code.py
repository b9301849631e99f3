"""Expressions, symbols and pipes of sources, on hand-written files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.operators import corpus
from quillspark.operators.expressions import fold_expressions
from quillspark.sources import pyfacts
from quillspark.sources.pyfacts import extract_facts
from quillspark.storage import materialise


def facts(spark, **files):
    return corpus.Facts(spark.createDataFrame([(k.replace("__", "/") + ".py", v) for k, v in files.items()], "file string, content string"))


CASES = [
    ('dedent("You are.")', "literal", "You are.", []),
    ('textwrap.dedent("""\n  You are.\n""")', "literal", "\n  You are.\n", []),
    ('dedent(f"Tell {topic}.")', "fstring", "Tell {topic}.", ["topic"]),
    ('dedent("Hello {name}.".format(name="x"))', "fstring", "Hello {name}.", ["name"]),
    ('tw.dedent("body")', "literal", "body", []),
    ('dedent("a", "b")', None, None, None),
    ('dedent(text="body")', None, None, None),
    ("dedent()", None, None, None),
    ("dedent(body)", None, None, None),
    ('mycall("hello")', None, None, None),
    ('"Hi {who}".format(who="there")', "fstring", "Hi {who}", ["who"]),
    ('dedent("""\nRULES\n""").strip()', "literal", "\nRULES\n", []),
    ('"  hello".lstrip()', "literal", "  hello", []),
    ('"x,y".strip(",")', "literal", "x,y", []),
    ("f'hi {user.name}, age {age}'", "fstring", "hi {user.name}, age {age}", None),
    ("'You are ' + role + '. Answer.'", "concat", "You are {role}. Answer.", ["role"]),
    ("'a' + ('b' + f'{x}') + dedent('c' + (d + 1).strip())", "concat", "ab{x}c{d}{<expr>}", ["x", "d"]),
    ("'' + x", "concat", "{<expr>}{x}", ["x"]),
    ("'{{ a.b }} and {{ c }}'.strip()", "jinja2", "{{ a.b }} and {{ c }}", ["a.b", "c"]),
    ("'x' + f'{g(1)}' + h[0]", "concat", "x{<expr>}{<expr>}", []),
]


def test_expressions(spark):
    files = {f"f{k}": f"X = {code}\nllm.invoke(prompt={code})\n" for k, (code, *_) in enumerate(CASES)}
    f = facts(spark, **files)
    for fact in ("assign", "message"):
        rows = f.of(fact)
        if fact == "message":
            rows = rows.join(f.of("call").where("value = 'llm.invoke'").select(F.col("id").alias("parent")), "parent", "left_semi")
        got = {r.file: r for r in rows.collect()}
        for k, (code, kind, text, names) in enumerate(CASES):
            row = got[f"f{k}.py"]
            if kind is None:
                assert row.value in ("call", "unresolved"), code
            else:
                assert (row.value, row.text) == (kind, text), code
                assert names is None or row["items"] == names, code
    assert fold_expressions(f.of("expr").where("1 = 0")).collect() == []


def test_deep_expressions(spark):
    code = '"a"'
    for k in range(20):
        code = f'("b{k}" + {code}).strip()'
    row = facts(spark, f=f"X = {code}\n").of("assign").first()
    assert (row.value, row.text) == ("concat", "".join(f"b{k}" for k in reversed(range(20))) + "a")


def test_confidence_of_folded_messages(spark):
    sites = corpus.prompt_sites(facts(spark, a='llm.invoke(prompt="a" + b)\n', b="llm.invoke(prompt=dedent(b))\n")).collect()
    assert {r.file: r.confidence for r in sites} == {"a.py": "high", "b.py": "medium"}


def test_call_parameters(spark):
    code = [
        "c.x(model='m', temperature=0.7, max_tokens=200, top_p=0.9, foo=42, messages=[])",
        "c.x(model='m', response_format={'type': 'json_object'}, prompt='p')",
        "c.x(model='m', messages=[], system='s', input='hi', prompt='p')",
        "c.x(model=m, max_output_tokens=512, temperature=-1, top_p=True, max_tokens=x, prompt='p')",
        "c.x(response_format='text', prompt='p', **more)",
        "f(a=1)",
    ]
    got = {r.id.split(":")[1]: tuple(r)[1:] for r in corpus.call_parameters(facts(spark, f="\n".join(code))).collect()}
    assert got == {
        "1": ("m", 0.7, 200, 0.9, None, {"foo": "42"}),
        "2": ("m", None, None, None, "json_object", {}),
        "3": ("m", None, None, None, None, {}),
        "4": (None, -1.0, None, None, None, {"max_output_tokens": "512"}),
        "5": (None, None, None, None, "text", {}),
    }


def test_system_blocks(spark):
    code = """c.messages.create(system=[{"type": "text", "text": "You are concise."}, {"type": "text", "text": "Cite."}], messages=[{"role": "user", "content": "q"}])
c.messages.create(system=[{"type": "image", "source": {}}], messages=[])
c.messages.create(system=[], messages=[])
c.messages.create(system=[x, {"text": "a" + b}], messages=[])
"""
    said = {r.line: (r.value, r.text) for r in facts(spark, f=code).of("message").where("name = 'system'").collect()}
    assert said[1] == ("literal", "You are concise.\n\nCite.") and said[4] == ("fstring", "{<expr>}\n\na{b}")
    assert said[2][0] == "unresolved" and set(said) == {1, 2, 4}


def test_pipes_need_neighbours(spark):
    f = facts(spark, f='x = llm.invoke(prompt="a") | y | llm.invoke(prompt="b") | llm.invoke(prompt="c")\nz = 2 | 3\n')
    edges = corpus.pipe_edges(f, corpus.prompt_sites(f)).collect()
    assert [(e.src.split(":")[2], e.dst.split(":")[2]) for e in edges] == [("33", "58")]


SITE = "class {0}:\n    def go(self):\n        return self.llm.complete(prompt='x')\n"
RUN = "class R:\n    def __init__(self):\n        self.a = {0}()\n        self.b = {1}()\n    def run(self):\n        self.a.go()\n        self.a.go()\n        self.b.go()\n"


@pytest.mark.parametrize(
    "imports, first, second, want",
    [
        ("from app.p import P as Q\nfrom app.e import E\n", "Q", "E", True),
        ("from .app.p import P as Q\nfrom .app.e import E\n", "Q", "E", True),
        ("import app.p\n", "app.p.P", "E", True),
        ("from app import Lead\n", "Lead", "E", True),
        ("", "P", "E", True),
        ("from app.p import P as Q\n", "Q", "Q", False),
        ("", "P", "Twin", False),
        ("from elsewhere import Twin\n", "P", "Twin", False),
        ("from app.p import P as Q\n", "Z", "E", False),
    ],
)
def test_classes_of_other_files(spark, imports, first, second, want):
    files = {"one__app__p": SITE.format("P"), "one__app__e": SITE.format("E"), "one__run": imports + RUN.format(first, second), "two__t": SITE.format("Twin")}
    rows = spark.createDataFrame([("one/app/__init__.py", "from .p import P as Lead\n")] + [(k.replace("__", "/") + ".py", v) for k, v in files.items()], "file string, content string")
    f = corpus.Facts(rows)
    edges = corpus.cross_file_edges(f, corpus.prompt_sites(f)).collect()
    assert [(e.src.split(":")[0], e.dst.split(":")[0]) for e in edges] == ([("one/app/p.py", "one/app/e.py")] if want else [])


def test_last_class_of_init_counts(spark):
    run = "class R:\n    def __init__(self):\n        self.a = P()\n        self.a = Unknown()\n        self.b = P()\n        self.b = E()\n        if x:\n            self.a = E()\n    def late(self):\n        self.a = E()\n    def run(self):\n        self.a.go()\n        self.b.go()\n"
    f = facts(spark, one__p=SITE.format("P"), one__e=SITE.format("E"), one__run=run)
    edges = corpus.cross_file_edges(f, corpus.prompt_sites(f)).collect()
    assert [(e.src.split(":")[0], e.dst.split(":")[0]) for e in edges] == [("one/p.py", "one/e.py")]


def test_builders_of_the_project(spark):
    built = "def build_a_messages(q):\n    return [{'role': 'user', 'content': 'hi'}]\n"
    use = "ms = {0}(1)\nout = llm.chat(messages=ms)\n"
    f = facts(
        spark, one__a=built, one__use=use.format("build_a_messages"), two__use=use.format("build_a_messages"),
        three__lib__b=built, three__a=built, three__use="from lib.b import build_a_messages as make\n" + use.format("make"),
    )
    sites = corpus.prompt_sites(f)
    got = {r.id.split(":")[0]: r.builder for r in corpus.link_wrappers(f, sites, corpus.match_templates(f)).collect()}
    assert got == {"one/use.py": "one/a.py:build_a_messages", "three/use.py": "three/lib/b.py:build_a_messages"}


def test_files_are_dealt_over_all_cores(spark):
    """However few bytes the sources have, adaptive execution doesn't parse them in one task."""
    files = spark.range(200).select(F.concat(F.lit("p/f"), "id", F.lit(".py")).alias("file"), F.lit("a = f(1)\n").alias("content"))
    rows = extract_facts(files).select("fact", F.spark_partition_id().alias("task"))
    tasks = {r.task for r in rows.collect()}
    assert len(tasks) >= 4 and rows.where("fact = 'call'").count() == 200


def test_tasks_grow_with_the_facts(spark, monkeypatch):
    """Sites and their scopes: every join and group is dealt over a number of tasks that grows with the facts.

    Left to adaptive execution, which goes by compressed bytes, a few tasks would sort all rows.
    """
    monkeypatch.setattr(corpus, "ROWS_A_TASK", 100)
    monkeypatch.setattr(pyfacts, "CHARS_A_TASK", 1000)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        code = "import openai\nP_PROMPT = 'a' + b\nQ_PROMPT = 'c'\nclass C{0}:\n    def __init__(self, k):\n        pass\n    def f(self, q: str):\n        return self.llm.invoke(prompt='p{0}')\n"
        files = spark.createDataFrame([(f"p/f{k}.py", code.format(k)) for k in range(120)] + [("p/empty.py", ""), ("p/null.py", None)], "file string, content string")
        assert extract_facts(files).rdd.getNumPartitions() > 120 * len(code) // 1000
        f = corpus.Facts(files)
        n = f._all.count()
        assert f.tasks == -(-n // 100) > spark.sparkContext.defaultParallelism
        sites = corpus.prompt_sites(f)
        made = materialise(sites, "sites")
        shapes = corpus.input_shapes(f, made)
        for df in (sites, shapes):
            dealt = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
            assert dealt and all(f", {f.tasks}), REPARTITION_BY_NUM" in line for line in dealt), [line for line in dealt if "BY_NUM" not in line]
        # Rows without an expression are not all in one task either.
        assert len(f.of("assign").inputFiles()) > 10
        got = sorted((r.file, r.line, r.function, r["args"]) for r in shapes.where("line > 3").collect())
        assert got == sorted((f"p/f{k}.py", 8, f"C{k}.f", ["q: str"]) for k in range(120))
        assert shapes.count() == made.count() == 360 and made.where("origin = 'constant' and n_messages = 1").count() == 240
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_shapes_of_a_name_defined_twice(spark):
    """Each site has a row of its own line, also where two share an id, as a constant that is set twice does."""
    f = facts(spark, f="A_PROMPT = 'x'\nA_PROMPT = 'y'\n")
    rows = corpus.input_shapes(f, corpus.prompt_sites(f)).collect()
    assert sorted((r.file, r.line) for r in rows) == [("f.py", 1), ("f.py", 2)]
