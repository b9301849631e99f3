"""Rules over the facts of a code corpus (K2-K7, K9, K10, D1-D7); each is a plan over fact tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as X
from quillspark.operators import inventory as I
from quillspark.operators.cases import case_id, site_id
from quillspark.operators.expressions import RESOLVED, fold_expressions, with_folded
from quillspark.operators.graph import build_pipelines
from quillspark.operators.select import dedupe_edges, file_anchor
from quillspark.operators.symbols import resolve_symbols
from quillspark.sources.pyfacts import extract_facts
from quillspark.storage import files_for, materialise, new_path

#: Fixed values, in order of precedence: provider, end of the call chain, package that the file must import.
SDK_CALLS: tuple[tuple[str, str, str | None], ...] = (
    ("openai", "chat.completions.create", None),
    ("openai", "responses.create", "openai"),
    ("openai", "completions.create", "openai"),
    ("anthropic", "messages.create", "anthropic"),
    ("anthropic", "messages.stream", "anthropic"),
)
#: Methods that build an engine; folders that hold cases; keys of literals that look like inputs.
ENGINE_BUILDERS = ("as_query_engine", "as_chat_engine", "as_retriever")
CASE_FOLDERS = ("tests", "fixtures", "examples", "test", "test_data")
INPUT_KEYS = ("content", "prompt", "input", "inputs", "query", "question", "messages", "system", "user", "text", "body", "topic")
EDGE = ["src", "dst", "kind", "confidence", "detector"]
#: Facts of all kinds for each task that joins or groups some of them, at most on average.
ROWS_A_TASK = 400_000


class Facts:
    """Fact rows of a corpus, written once to the shared folder with one partition a kind.

    Messages and assignments are written a second time, with the texts of their expressions.
    """

    def __init__(self, files: DataFrame):
        spark, path = files.sparkSession, new_path(files.sparkSession, "facts")
        rows = extract_facts(files)
        rows.write.partitionBy("fact").parquet(path)
        self.spark, self.path = spark, path
        self._all = spark.read.schema(rows.schema).parquet(path)
        #: Tasks of a join or group: so many that each holds few rows, and a few for each core while there are enough.
        n = self._all.count()
        self.tasks = max(-(-n // ROWS_A_TASK), min(spark.sparkContext.defaultParallelism, files_for(n)))
        folded = materialise(fold_expressions(self.of("expr")), "texts")
        self._folded = {fact: materialise(with_folded(self._raw(fact), folded, self.tasks), fact) for fact in ("message", "assign")}

    def _raw(self, fact: str) -> DataFrame:
        return self._all.where(F.col("fact") == fact).drop("fact")

    def dealt(self, df: DataFrame, *keys: Column | str) -> DataFrame:
        """``df`` dealt by ``keys`` over a number of tasks that grows with the facts, for a join or group by these keys.

        Facts compress a hundred times, and adaptive execution puts tables together by their bytes, so a few tasks would
        sort them all. It leaves a given number as it is.
        """
        return df.repartition(self.tasks, *keys)

    def of(self, fact: str) -> DataFrame:
        return self.__dict__.get("_folded", {}).get(fact, self._raw(fact))


def _packages(facts: Facts) -> DataFrame:
    top = F.substring_index("value", ".", 1)
    held = [F.when(F.bool_or(top == p), p) for p in ("openai", "anthropic")]  # not a set, whose groups would be sorted
    return facts.dealt(facts.of("import"), "file").groupBy("file").agg(F.array_compact(F.array(*held)).alias("packages"))


def _with_messages(calls: DataFrame, facts: Facts) -> DataFrame:
    # Not a semi join, which the optimizer puts before the dealing.
    said = facts.dealt(facts.of("message").select(F.col("parent").alias("id")), "id").distinct()
    return facts.dealt(calls, "id").join(said, "id")


def match_sdk_calls(facts: Facts) -> DataFrame:
    """K2: calls of known clients that carry messages, with their provider; the first rule that fits wins."""
    calls = facts.dealt(facts.of("call"), "file").join(_packages(facts), "file", "left")
    provider = F.lit(None).cast("string")
    for name, path, needs in reversed(SDK_CALLS):
        fits = F.concat(F.lit("."), "value").endswith(f".{path}")
        if needs:
            fits &= F.coalesce(F.array_contains("packages", needs), F.lit(False))
        provider = F.when(fits, name).otherwise(provider)
    known = calls.withColumn("provider", provider).where("provider is not null and arrays_overlap(items, array('messages', 'input', 'prompt', 'system'))")
    return _with_messages(known, facts).select("file", "id", "line", "scope", "depth", "value", "provider")


def match_wrapper_calls(facts: Facts, known: DataFrame) -> DataFrame:
    """K3: other calls that look like those of a model's wrapper: a method's name with a receiver's or arguments'."""
    others = facts.dealt(facts.of("call"), "id").join(known.select("id", F.lit(True).alias("_known")), "id", "left").where("_known is null").drop("_known")
    calls = facts.dealt(others, "file").join(_packages(facts), "file", "left")
    method, receiver = F.substring_index("value", ".", -1), F.regexp_extract("value", r"^(.*)\.[^.]*$", 1)
    first = F.coalesce((F.col("name") == "list") | (F.col("name").startswith("name:") & I.is_message_list(F.substring("name", 6, 1000))), F.lit(False))
    signal = F.arrays_overlap("items", F.array(*[F.lit(k) for k in I.MESSAGE_KEYWORDS])) | first
    found = calls.where(F.col("value").contains(".") & I.is_wrapper_method(method) & (I.calls_a_model(receiver) | signal))
    provider = I.provider_of_imports(F.coalesce("packages", F.array().cast("array<string>")))
    return _with_messages(found, facts).select("file", "id", "line", "scope", "depth", "value", provider.alias("provider"))


def match_templates(facts: Facts) -> DataFrame:
    """K4: functions that build messages, and constants of a module that hold a prompt."""
    built = facts.of("scope").where((F.col("value") == "function") & I.is_builder(F.substring_index("name", ".", -1)))
    builders = built.select("file", F.concat_ws(":", "file", "name").alias("id"), "line", F.col("name").alias("scope"), "name", F.lit("builder").alias("origin"))
    held = facts.of("assign").where("scope = ''").where(F.col("value").isin(*RESOLVED) & I.is_prompt_constant(F.col("name")))
    constants = held.select("file", F.concat_ws(":", "file", "name").alias("id"), "line", "scope", "name", F.lit("constant").alias("origin"))
    return builders.unionByName(constants)


def site_messages(facts: Facts, templates: DataFrame) -> DataFrame:
    """``(id, pos, role, kind, text)`` of calls, of the lists that builders return, and of constants.

    Roles are those that their aliases stand for (X16).
    """
    own = facts.of("message").select(F.col("parent").alias("id"), "pos", X.role(F.col("name")).alias("role"), F.col("value").alias("kind"), "text")
    lists = facts.of("return").where("id is not null and value is null").select("file", "scope", F.col("id").alias("_list"))
    builders = facts.dealt(templates.where("origin = 'builder'").select("file", "scope", "id"), "file", "scope")
    returned = builders.join(facts.dealt(lists, "file", "scope"), ["file", "scope"]).select("id", "_list")
    built = facts.dealt(returned, "_list").join(facts.dealt(own.withColumnRenamed("id", "_list"), "_list"), "_list").drop("_list")
    values = facts.of("assign").where("scope = ''").select(F.concat_ws(":", "file", "name").alias("id"), F.col("value").alias("kind"), "text")
    held = facts.dealt(templates.where("origin = 'constant'").select("id", "name"), "id").join(facts.dealt(values, "id"), "id")
    constants = held.select("id", F.lit(0).alias("pos"), I.constant_role(F.col("name")).alias("role"), "kind", "text")
    return own.unionByName(built.select(*own.columns)).unionByName(constants.select(*own.columns))


def call_parameters(facts: Facts) -> DataFrame:
    """K1: ``(id, model, temperature, max_tokens, top_p, response_format, extra)`` of calls with messages.

    Only plain values count; ``extra`` holds the code of other keywords, and of ``max_output_tokens`` besides its
    value. The texts themselves are no parameters.
    """
    of = lambda value, *names: F.max_by(F.when(F.col("name").isin(*names), value), F.when(F.col("name").isin(*names), F.col("pos")))
    held = F.get("items", F.lit(0))
    number = F.when(F.col("value").isin("int", "float", "negative"), F.col("text").try_cast("double"))
    other = ~F.col("name").isin("model", "temperature", "max_tokens", "top_p", "response_format", "messages", "system", "input", "prompt")
    return facts.of("param").groupBy(F.col("parent").alias("id")).agg(
        of(F.when(F.col("value") == "str", held), "model").alias("model"),
        of(number, "temperature").alias("temperature"),
        of(F.when(F.col("value") == "int", F.col("text").try_cast("long")), "max_tokens", "max_output_tokens").alias("max_tokens"),
        of(number, "top_p").alias("top_p"),
        of(F.when(F.col("value").isin("str", "dict"), held), "response_format").alias("response_format"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(other, F.struct("name", "text"))))).alias("extra"),
    )


def resolve_names(messages: DataFrame, facts: Facts, hops: int = 4) -> DataFrame:
    """K6: unresolved messages that name a local or module variable, with its text, over at most ``hops`` names.

    ``messages`` is ``(id, file, scope, pos, role, kind, text)``. A name's last assignment counts; a local
    one goes before the module's. A message that a function of the module makes (``helper()``) is that of its
    first return, if that is one message, whose names are then looked up in the helper. Names that lead
    nowhere, or in a loop, stay unresolved.
    """
    made = F.when(F.col("kind") == "unresolved", F.regexp_extract("text", r"^(\w+)\(\)$", 1))
    returns = facts.of("return").where("not contains(scope, '.')").groupBy("file", "scope").agg(F.min_by(F.struct("id", "value"), "line").alias("_r")).where("_r.value = 'dict'")
    said = facts.of("message").select(F.col("parent").alias("_id"), F.struct(X.role(F.col("name")).alias("role"), F.col("value").alias("kind"), "text").alias("_m"))
    helpers = returns.select("file", F.col("scope").alias("_helper"), F.col("_r.id").alias("_id")).join(said, "_id").drop("_id")
    helped = messages.withColumn("_helper", F.nullif(made, F.lit(""))).join(helpers, ["file", "_helper"], "left")
    messages = helped.select(
        "id", "file", F.when(F.col("_m").isNotNull(), F.col("_helper")).otherwise(F.col("scope")).alias("scope"), "pos",
        *[F.when(F.col("_m").isNotNull(), F.col(f"_m.{c}")).otherwise(F.col(c)).alias(c) for c in ("role", "kind", "text")],
    )
    # Of the latest assignment of each name; one row a name of each scope.
    last = facts.of("assign").where(F.col("value").isin(*RESOLVED, "name")).groupBy("file", "scope", "name").agg(F.max_by(F.struct("value", "text"), "line").alias("_b"))
    out = messages.withColumn("_name", F.when(F.col("kind") == "unresolved", F.col("text")))
    for _ in range(hops):
        local = last.select("file", "scope", F.col("name").alias("_name"), F.col("_b").alias("_l"))
        module = last.where("scope = ''").select("file", F.col("name").alias("_name"), F.col("_b").alias("_m"))
        found = out.join(local, ["file", "scope", "_name"], "left").join(module, ["file", "_name"], "left").withColumn("_f", F.coalesce("_l", "_m"))
        ends = F.col("_f.value").isin(*RESOLVED)
        out = found.select(
            "id", "file", "scope", "pos", "role",
            F.when(ends, F.col("_f.value")).otherwise(F.col("kind")).alias("kind"),
            F.when(ends, F.col("_f.text")).otherwise(F.col("text")).alias("text"),
            F.when(F.col("_f.value") == "name", F.col("_f.text")).alias("_name"),
        )
    return out.drop("_name")


def link_wrappers(facts: Facts, wrappers: DataFrame, templates: DataFrame) -> DataFrame:
    """K7: ``(id, builder)``: calls whose message list was made by a builder, through the variable they pass.

    The builder is what its name stands for in the call's file: an import, over its alias, or a definition of the
    same project (:func:`symbols.resolve_symbols`).
    """
    passed = facts.of("use").select("file", "scope", "name", F.col("line").alias("at"), F.col("parent").alias("use_id"))
    uses = passed.join(wrappers.select(F.col("id").alias("use_id")), "use_id", "left_semi")
    sets = facts.of("assign").select("file", "scope", "name", F.col("line").alias("at"), F.when(F.col("value") == "call", F.substring_index("text", ".", -1)).otherwise("").alias("value"))
    bound = I.last_binding(uses, sets).where("bound <> ''").select("use_id", "file", F.col("bound").alias("name"))
    built = templates.where("origin = 'builder'").select("file", F.substring_index("name", ".", -1).alias("name"), "id")
    meant = resolve_symbols(bound, built, facts.of("import"))
    builders = built.groupBy(F.col("file").alias("at"), F.col("name").alias("of")).agg(F.min("id").alias("builder"))
    linked = bound.join(meant, ["file", "name"]).join(builders, ["at", "of"])
    return linked.groupBy(F.col("use_id").alias("id")).agg(F.min("builder").alias("builder"))


def prompt_sites(facts: Facts) -> DataFrame:
    """K5: ``(id, call_id, site_id, file, line, scope, name, provider, origin, confidence, n_messages)`` of all sites.

    A site's id is X5's over its place and texts; a call's confidence is X21's, a builder's medium, a constant's high.
    """
    sdk = match_sdk_calls(facts)
    wrapped = match_wrapper_calls(facts, sdk)
    templates = match_templates(facts)
    call = lambda df, origin: df.select("file", "id", "line", "scope", F.col("value").alias("name"), "provider", F.lit(origin).alias("origin"))
    hinted = facts.dealt(templates, "file").join(_packages(facts), "file", "left").withColumn("provider", I.provider_of_imports(F.coalesce("packages", F.array().cast("array<string>"))))
    sites = call(sdk, "sdk").unionByName(call(wrapped, "wrapper")).unionByName(hinted.select("file", "id", "line", "scope", "name", "provider", "origin"))
    said = facts.dealt(site_messages(facts, templates), "id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "text"))).alias("m"))
    whole = facts.dealt(sites, "id").join(said, "id", "left").withColumn("m", F.coalesce("m", F.array().cast("array<struct<pos:int,kind:string,text:string>>")))
    confidence = (
        F.when(F.col("origin") == "builder", "medium").when(F.col("origin") == "constant", "high").otherwise(I.call_confidence(F.transform("m", lambda x: x["kind"])))
    )
    texts = F.transform("m", lambda x: x["text"])
    column = F.when(F.col("origin").isin("sdk", "wrapper"), F.split("id", ":")[2])
    return whole.select(
        "id", site_id(F.col("file"), F.col("line"), column, texts).alias("site_id"), "file", "line", "scope",
        X.slug(F.col("name")).alias("name"), "provider", "origin", confidence.alias("confidence"), F.size("m").alias("n_messages"),
    )


def input_shapes(facts: Facts, sites: DataFrame) -> DataFrame:
    """K9: ``(id, file, line, function, args, doc)`` of the smallest scope around each site; a class stands for its ``__init__``."""
    scopes = facts.of("scope")
    spans = scopes.select("file", F.col("name").alias("qual"), F.col("line").alias("line_start"), F.col("pos").alias("line_end"))
    around = I.enclosing_scope(sites.select("file", F.col("id").alias("site"), "line"), spans, facts.tasks)
    named = facts.dealt(scopes.select("file", F.col("name").alias("scope"), "line", "value", "items", "text"), "file", "scope")
    named = named.groupBy("file", "scope").agg(F.max_by(F.struct("value", "items", "text"), "line").alias("_s"))
    inits = named.where("scope like '%.__init__'").select("file", F.regexp_replace("scope", r"\.__init__$", "").alias("scope"), F.col("_s.items").alias("_init"))
    both = facts.dealt(around, "file", "scope").join(named, ["file", "scope"], "left").join(facts.dealt(inits, "file", "scope"), ["file", "scope"], "left")
    args = F.when(F.col("_s.value") == "class", F.col("_init")).otherwise(F.col("_s.items"))
    return both.select(F.col("site").alias("id"), "file", "line", F.col("scope").alias("function"), F.filter(args, lambda a: a != "self").alias("args"), F.col("_s.text").alias("doc"))


def json_objects_of(files: DataFrame) -> DataFrame:
    """``(file, line, items, text)``: each JSON file's object, or the objects of its list, with their keys.

    A file's line is 1, as objects of JSON have none of their own. Files that do not parse, or hold anything
    else, have no rows.
    """
    whole = files.where(F.lower("file").endswith(".json")).select("file", F.trim("content").alias("_c")).where(F.try_parse_json("_c").isNotNull())
    each = F.when(F.col("_c").startswith("["), F.from_json("_c", "array<string>")).when(F.col("_c").startswith("{"), F.array("_c"))
    # As text with sorted keys, so that equal objects are equal whatever their spacing.
    found = whole.select("file", F.lit(1).alias("line"), F.explode(each).alias("_o")).withColumn("text", F.to_json(F.try_parse_json("_o")))
    return found.withColumn("items", F.json_object_keys("text")).where("size(items) > 0").select("file", "line", "items", "text")


def mine_cases(facts: Facts, sites: DataFrame, n: int = 50, folders: Sequence[str] | None = CASE_FOLDERS, files: DataFrame | None = None) -> DataFrame:
    """``(project, site, case_id, inputs, file, line)``: literals of each project with an input's key, ``n`` a site at most.

    Literals are dictionaries in sources and, with ``files``, the objects of JSON files. ``sites`` is ``(project,
    site)``. A literal's project is its file's first folder. Only files below one of ``folders`` count; with None,
    all do.
    """
    inside = F.lit(True) if folders is None else F.arrays_overlap(F.split("file", "/"), F.array(*[F.lit(d) for d in folders]))
    literals = facts.of("dict").select("file", "line", "items", "text")
    if files is not None:
        literals = literals.unionByName(json_objects_of(files))
    keyed = literals.where(F.arrays_overlap("items", F.array(*[F.lit(k) for k in INPUT_KEYS])) & inside)
    # Of equal literals of a project the first; then the first n, before sites multiply them. The partial group
    # limit leaves n rows a task of a project before any of them meet.
    once = keyed.groupBy(F.split("file", "/")[0].alias("project"), F.col("text").alias("inputs")).agg(F.min(F.struct("file", "line")).alias("_a"))
    rank = F.row_number().over(Window.partitionBy("project").orderBy("_a", "inputs"))
    first = once.withColumn("_r", rank).where(F.col("_r") <= n).select("project", "inputs", "_a.file", "_a.line")
    return sites.join(first, "project").select("project", "site", case_id(F.col("site"), F.from_json("inputs", "map<string,string>")).alias("case_id"), "inputs", "file", "line")


# Edges -------------------------------------------------------------------------------------------


def _bound_calls(facts: Facts) -> DataFrame:
    """``(src, dst, depth)``: calls that use the name another call's result was last bound to."""
    uses = facts.of("use").select("file", "scope", "name", F.col("line").alias("at"), F.col("parent").alias("use_id"))
    sets = facts.of("assign").select("file", "scope", "name", F.col("line").alias("at"), F.coalesce("parent", F.lit("")).alias("value"))
    depth = facts.of("call").select(F.col("id").alias("use_id"), "depth")
    bound = I.last_binding(uses, sets).where("bound <> '' and bound <> use_id")
    return bound.join(depth, "use_id").select(F.col("bound").alias("src"), F.col("use_id").alias("dst"), "depth").distinct()


def _sites_only(pairs: DataFrame, sites: DataFrame) -> DataFrame:
    known = sites.select("id")
    return pairs.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi").where("src <> dst")


def _edges(pairs: DataFrame, kind: str, confidence, detector: int) -> DataFrame:
    return pairs.select("src", "dst", F.lit(kind).alias("kind"), confidence.alias("confidence"), F.lit(detector).alias("detector"))


def variable_edges(facts: Facts, sites: DataFrame) -> DataFrame:
    """A site's output, bound to a name, goes into a later site of the scope; high at the top of it, else medium."""
    return _edges(_sites_only(_bound_calls(facts), sites), "variable", F.when(F.col("depth") == 0, "high").otherwise("medium"), 1)


def function_edges(facts: Facts, sites: DataFrame) -> DataFrame:
    """``g(f(x))``, or ``a = f(); g(a)``, where functions f and g of the file return a site's output."""
    bound = facts.of("assign").where("parent is not null").groupBy("file", "scope", "name").agg(F.max_by("parent", "line").alias("_b"))
    returns = facts.of("return").where("id is null").join(bound, ["file", "scope", "name"], "left").select("file", F.col("scope").alias("value"), F.coalesce("parent", "_b").alias("site"))
    gives = returns.join(sites.select(F.col("id").alias("site")), "site", "left_semi").groupBy("file", "value").agg(F.min("site").alias("site"))
    calls = facts.of("call").select("file", "id", "parent", "value").join(gives, ["file", "value"])
    stands = calls.select("id", "site")
    nested = calls.where("parent is not null").select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    pairs = nested.unionByName(_bound_calls(facts).select("src", "dst")).distinct()
    ends = pairs.join(stands.select(F.col("id").alias("src"), F.col("site").alias("_s")), "src").join(stands.select(F.col("id").alias("dst"), F.col("site").alias("_d")), "dst")
    return _edges(ends.select(F.col("_s").alias("src"), F.col("_d").alias("dst")).where("src <> dst").distinct(), "function", F.lit("high"), 2)


def pipe_edges(facts: Facts, sites: DataFrame) -> DataFrame:
    """D3: sites that are operands side by side in ``a | b | c``; what lies between two of them parts them."""
    steps = facts.of("pipe").join(sites.select(F.col("id").alias("parent")), "parent", "left_semi")
    after = F.lead(F.struct("pos", "parent")).over(Window.partitionBy("id").orderBy("pos"))
    beside = steps.withColumn("_next", after).where("_next.pos = pos + 1 and _next.parent <> parent")
    return _edges(beside.select(F.col("parent").alias("src"), F.col("_next.parent").alias("dst")).distinct(), "lc_pipe", F.lit("high"), 3)


def engine_edges(facts: Facts, sites: DataFrame) -> DataFrame:
    """All sites of a file by line, where it imports the index library and builds an engine."""
    files = facts.of("import").where("value like 'llama_index%'").select("file")
    builds = facts.of("call").where(F.substring_index("value", ".", -1).isin(*ENGINE_BUILDERS)).select("file")
    of = sites.join(files, "file", "left_semi").join(builds, "file", "left_semi")
    return _edges(I.chain_edges(of.select(F.col("file").alias("group_id"), F.col("line").alias("pos"), F.col("id").alias("site"))), "query_engine", F.lit("low"), 4)


def method_chain_edges(facts: Facts, sites: DataFrame, least: int = 3) -> DataFrame:
    """A method that calls ``least`` or more of its class's methods with sites chains them; low where it branches."""
    owner = F.regexp_extract("scope", r"^(.*)\.[^.]+$", 1)
    methods = sites.where(F.col("scope").contains(".")).groupBy("file", "scope").agg(F.min_by("id", F.struct("line", "id")).alias("site"))
    named = methods.select("file", owner.alias("cls"), F.substring_index("scope", ".", -1).alias("method"), "site")
    calls = facts.of("call").where("value rlike '^self[.][^.]+$'").select("file", "scope", "line", "depth", owner.alias("cls"), F.substring_index("value", ".", -1).alias("method"))
    steps = calls.join(named, ["file", "cls", "method"])
    wide = steps.groupBy("file", "scope").agg(F.countDistinct("method").alias("_n"), F.max("depth").alias("_depth")).where(F.col("_n") >= least)
    found = steps.join(wide, ["file", "scope"]).select(F.struct("file", "scope").alias("group_id"), F.col("line").alias("pos"), "site")
    pairs = I.chain_edges(found).join(wide.select(F.struct("file", "scope").alias("group_id"), "_depth"), "group_id")
    return _edges(pairs, "method_chain", F.when(F.col("_depth") > 0, "low").otherwise("medium"), 5)


def cross_file_edges(facts: Facts, sites: DataFrame) -> DataFrame:
    """A method that calls two or more objects held in ``self`` chains the first sites of their classes' files.

    What ``__init__`` sets counts, the last class that the project has. A class is what its name stands for in the
    file (:func:`symbols.resolve_symbols`); files without a site are passed over.
    """
    owner = F.regexp_extract("scope", r"^(.*)\.[^.]+$", 1)
    made = facts.of("assign").where("name rlike '^self[.][^.]+$' and value = 'call' and scope like '%.__init__' and depth = 0")
    held = made.select("file", owner.alias("cls"), F.col("name").alias("attr"), F.substring_index("text", ".", -1).alias("name"), "line")
    classes = facts.of("scope").where("value = 'class'").select("file", F.substring_index("name", ".", -1).alias("name"))
    where = held.join(resolve_symbols(held, classes, facts.of("import")), ["file", "name"]).groupBy("file", "cls", "attr").agg(F.max_by("at", "line").alias("_at"))
    anchors = file_anchor(sites.select("file", "line", "id")).select(F.col("file").alias("_at"), F.col("anchor").alias("site"))
    receivers = where.join(anchors, "_at").select("file", "cls", F.col("attr").alias("name"), "site")
    calls = facts.of("call").where("value rlike '^self[.][^.]+[.][^.]+$'").select("file", "scope", "line", owner.alias("cls"), F.regexp_extract("value", r"^(.*)\.[^.]+$", 1).alias("name"))
    found = calls.join(receivers, ["file", "cls", "name"]).select(F.struct("file", "scope").alias("group_id"), F.col("line").alias("pos"), "site")
    return _edges(I.chain_edges(found), "cross_file", F.lit("medium"), 6)


DETECTORS = (variable_edges, function_edges, pipe_edges, engine_edges, method_chain_edges, cross_file_edges)


def corpus_edges(facts: Facts, sites: DataFrame) -> DataFrame:
    """All detectors' edges, the surest of each pair and kind.

    Detectors of edges within a file get the sites of files that have two at least.
    """
    busy = sites.groupBy("file").agg(F.count("*").alias("_n")).where("_n > 1").select("file")
    within = sites.join(busy, "file", "left_semi")
    return dedupe_edges(I.all_edges(*[d(facts, sites if d is cross_file_edges else within).select(*EDGE) for d in DETECTORS]))


def warnings(facts: Facts) -> DataFrame:
    """``(file, name, text)`` of files that could not be read as sources."""
    return facts.of("warning").select("file", "name", "text")


def scan_corpus(files: DataFrame) -> dict[str, DataFrame]:
    """The whole inventory of ``(file, content)``: sites, edges, pipelines, evidence and warnings."""
    facts = Facts(files)
    # Written once: every detector starts from them.
    sites = materialise(prompt_sites(facts), "sites")
    edges = materialise(corpus_edges(facts, sites), "corpus-edges")
    return {
        "sites": sites,
        "edges": edges,
        "pipelines": build_pipelines(edges.select("src", "dst"), sites),
        "evidence": I.provider_evidence(files),
        "warnings": warnings(facts),
    }
