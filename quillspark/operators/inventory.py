"""The inventory of call sites: names (X17-X21), scopes and bindings (W5, W13, W15), evidence (K8, P10), edges (Q8)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: How functions that build messages, and constants that hold prompts, are named.
BUILDER_NAME = r"^(?:build_|make_|compose_|render_|format_|create_|get_|_build_)[a-z0-9_]+?_(?:messages|prompt|chat|template|instructions?)s?$"
PROMPT_CONSTANT = (
    r"^(?:(?:SYSTEM|USER|ASSISTANT|TOOL|PROMPT|TEMPLATE|INSTRUCTIONS?|RUBRIC|CRITIC|JUDGE|PERSONA)_[A-Z0-9_]*"
    r"|[A-Z][A-Z0-9_]*?_(?:PROMPT|TEMPLATE|INSTRUCTIONS?|MESSAGE|MESSAGES|RULES|RUBRIC))$"
)
#: Parts of the names of objects that call a model, methods that do, names of message lists.
RECEIVER_HINTS = ("llm", "client", "chat", "model", "gpt", "claude", "chain", "agent", "completion", "responder", "messenger", "anthropic", "openai")
WRAPPER_METHODS = (
    "complete", "acomplete", "completion", "completions", "chat_complete", "chat_completion", "invoke", "ainvoke",
    "generate", "agenerate", "generate_response", "agenerate_response", "send", "asend", "send_messages", "chat",
    "achat", "run", "arun", "predict", "apredict", "call", "acall", "__call__",
)
MESSAGE_HINTS = ("messages", "msgs", "chat", "prompt", "history")
#: Keyword arguments that mark a call to a model.
MESSAGE_KEYWORDS = ("messages", "prompt", "system")
#: Which variables hold whose key.
PROVIDER_KEYS: tuple[tuple[str, str], ...] = (
    ("openai", r"^(?:OPENAI_API_KEY|OPENAI_ORG(?:_ID)?)$"),
    ("anthropic", r"^ANTHROPIC_API_KEY$"),
    ("langchain", r"^(?:LANGCHAIN_API_KEY|LANGSMITH_API_KEY|LANGCHAIN_TRACING_V2)$"),
    ("llamaindex", r"^LLAMAINDEX_[A-Z0-9_]+$"),
    ("dashscope", r"^DASHSCOPE_API_KEY$"),
)
KEY_LINE = r"""^\s*(?:export\s+)?['"]?([A-Z][A-Z0-9_]+)['"]?\s*[:=]"""
PROVIDERS = ("openai", "anthropic", "langchain", "llamaindex", "dashscope")


def is_builder(name: Column) -> Column:
    """A name like those of functions that build messages."""
    return name.rlike(BUILDER_NAME)


def is_prompt_constant(name: Column) -> Column:
    """A name like those of constants that hold prompts."""
    return name.rlike(PROMPT_CONSTANT)


def constant_role(name: Column) -> Column:
    """The role that a constant's name starts with, ``user`` for others."""
    upper = F.upper(name)
    picked = F.when(upper.startswith("SYSTEM"), "system").when(upper.startswith("ASSISTANT"), "assistant").when(upper.startswith("TOOL"), "tool")
    return picked.otherwise("user")


def provider_of_imports(packages: Column) -> Column:
    """Whose client a file imports, anthropic before openai."""
    return F.when(F.array_contains(packages, "anthropic"), "anthropic").when(F.array_contains(packages, "openai"), "openai").otherwise("unknown")


def calls_a_model(receiver: Column) -> Column:
    """A receiver with one of the hints in its name."""
    return F.lower(receiver).rlike("|".join(RECEIVER_HINTS))


def is_wrapper_method(method: Column) -> Column:
    """A method that wrappers of models have."""
    return method.isin(*WRAPPER_METHODS)


def is_message_list(name: Column) -> Column:
    """A name like those of message lists."""
    return F.lower(name).rlike("|".join(MESSAGE_HINTS))


def key_provider(key: Column) -> Column:
    """Whose key a variable holds; null for any other."""
    (first, pattern), *rest = PROVIDER_KEYS
    out = F.when(key.rlike(pattern), first)
    for provider, pattern in rest:
        out = out.when(key.rlike(pattern), provider)
    return out


def call_confidence(kinds: Column) -> Column:
    """High if any message of a call is resolved, else medium."""
    return F.when(F.exists(kinds, lambda k: k != "unresolved"), "high").otherwise("medium")


def provider_evidence(files: DataFrame) -> DataFrame:
    """K8: ``(file, provider, source, line, key_var_name)``: keys set in environment and configuration files.

    ``files`` is ``(file, content)``. Comments do not count, values are never emitted, and a key counts
    once a file, on its first line. File names count in any case. Whole files are split on Spark, one row a line.
    """
    base = F.lower(F.regexp_extract("file", r"([^/]+)$", 1))
    env = base.isin(".env", ".env.local", ".env.example", ".env.sample") | base.endswith(".env")
    config = base.isin("config.yaml", "config.yml", "settings.yaml", "settings.yml", "config.py", "settings.py")
    source = F.when(env, ".env").when(config, "config")
    lines = files.select("file", source.alias("source"), F.posexplode(F.split("content", r"\r\n|\r|\n")).alias("at", "text")).where("source is not null")
    keyed = lines.where(~F.ltrim("text").startswith("#")).withColumn("key_var_name", F.regexp_extract("text", KEY_LINE, 1))
    named = keyed.withColumn("provider", key_provider(F.col("key_var_name"))).where("provider is not null")
    return named.groupBy("file", "source", "provider", "key_var_name").agg((F.min("at") + 1).alias("line"))


def list_evidence(evidence: DataFrame) -> DataFrame:
    """P10: evidence by time of detection; an unheard-of provider is ``unknown``, an unheard-of source ``config``."""
    provider = F.when(F.col("provider").isin(*PROVIDERS), F.col("provider")).otherwise("unknown")
    source = F.when(F.col("source").isin(".env", "config", "code"), F.col("source")).otherwise("config")
    return evidence.withColumn("provider", provider).withColumn("source", source).orderBy("detected_at", "id")


def chain_edges(steps: DataFrame, group: str = "group_id") -> DataFrame:
    """Edges between consecutive distinct steps of each group, a step at its first place.

    ``steps`` is ``(group, pos, site)``.
    """
    first = steps.groupBy(group, "site").agg(F.min("pos").alias("pos"))
    after = F.lead("site").over(Window.partitionBy(group).orderBy("pos", "site"))
    return first.select(group, F.col("site").alias("src"), after.alias("dst")).where("dst is not null")


def enclosing_scope(sites: DataFrame, scopes: DataFrame, tasks: int | None = None) -> DataFrame:
    """The smallest function or class around each site; null without any.

    ``sites`` is ``(file, site, line)``, ``scopes`` ``(file, qual, line_start, line_end)``, both ends included; of
    equal scopes the least name. A scope is cut into aligned blocks of 2**level lines, two a level at most; each block
    keeps its smallest scope, and a line looks its block up at every level that its file has. So a scope of n lines
    costs at most 2 log n rows and a line log n of its file's longest scope, whether scopes nest or cross, and no pair of
    a scope and a line is joined. Lines that several sites share are looked up once. With ``tasks``, every join and
    group of many files is dealt over so many, as :meth:`corpus.Facts.dealt` says.
    """
    dealt = lambda df, *keys: df.repartition(tasks, *keys) if tasks else df
    real = scopes.where("file is not null and line_start <= line_end")
    # Of scopes with the same ends only the least name can be the answer.
    spans = real.select("file", F.col("line_start").cast("long").alias("_a"), F.col("line_end").cast("long").alias("_b"), "qual")
    once = dealt(spans, "file", "_a", "_b").groupBy("file", "_a", "_b").agg(F.min("qual").alias("qual"))
    # Blocks of a level are numbered; those inside a scope go from the first, rounded up, to before the last, rounded down.
    shifted = lambda c, k: F.expr(f"shiftright({c}, {k})")
    cut = once.withColumn("_level", F.explode(F.expr("sequence(0, cast(floor(log2(_b - _a + 1)) as int))"))).select(
        "file", "_level", (-shifted("-_a", "_level")).alias("_l"), shifted("_b + 1", "_level").alias("_r"), F.struct((F.col("_b") - F.col("_a")).alias("size"), (-F.col("_a")).alias("start"), "qual").alias("_scope")
    ).where("_l < _r")
    ends = F.array(F.when(F.col("_l") % 2 != 0, F.col("_l")), F.when(F.col("_r") % 2 != 0, F.col("_r") - 1))
    each = cut.select("file", "_level", F.explode(F.array_compact(F.array_distinct(ends))).alias("_block"), "_scope")
    blocks = dealt(each, "file", "_level", "_block").groupBy("file", "_level", "_block").agg(F.min("_scope").alias("_scope"))
    tops = dealt(once, "file").groupBy("file").agg(F.max(F.expr("cast(floor(log2(_b - _a + 1)) as int)")).alias("_top"))
    lines = dealt(sites.where("line is not null").select("file", "line"), "file").distinct().join(tops, "file")
    asked = lines.withColumn("_level", F.explode(F.sequence(F.lit(0), "_top"))).withColumn("_block", shifted("cast(line as long)", "_level"))
    inside = dealt(asked, "file", "_level", "_block").join(blocks, ["file", "_level", "_block"]).select("file", "line", "_scope")
    found = dealt(inside, "file", "line").groupBy("file", "line").agg(F.min("_scope")["qual"].alias("scope"))
    return dealt(sites.select("file", "site", "line"), "file", "line").distinct().join(found, ["file", "line"], "left").select("file", "site", "line", "scope")


def last_binding(uses: DataFrame, assigns: DataFrame) -> DataFrame:
    """What each use of a name was last set to before it.

    ``uses`` is ``(file, scope, name, at, use_id)``, ``assigns`` ``(file, scope, name, at, value)``. Both are
    put in one order and the last value is carried forward, so a name set n times and used m times costs
    n + m rows; an assignment at the place of a use does not count.
    """
    both = uses.select("file", "scope", "name", "at", F.lit(0).alias("_kind"), "use_id", F.lit(None).alias("value")).unionByName(
        assigns.select("file", "scope", "name", "at", F.lit(1).alias("_kind"), F.lit(None).alias("use_id"), "value")
    )
    order = Window.partitionBy("file", "scope", "name").orderBy("at", "_kind", "value")
    seen = F.last("value", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("bound", seen).where("_kind = 0").select("file", "scope", "name", "at", "use_id", "bound")


def all_edges(*found: DataFrame) -> DataFrame:
    """Q8: what all detectors found."""
    return reduce(DataFrame.unionByName, found)
