"""K1: texts of string expressions, folded from tables of their nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.storage import materialise

#: Kinds of a template whose text is known.
RESOLVED = ("literal", "jinja2", "fstring", "concat")
#: Levels that a plan holds before it is cut.
LEVELS = 6
NONE = "array<string>"
#: Slots of templates; dotted names count.
JINJA_SLOT = r"\{\{\s*([a-zA-Z_][a-zA-Z0-9_.]*)\s*\}\}"
BRACE_SLOT = r"\{([a-zA-Z_][a-zA-Z0-9_.]*)\}"


def _leaves(nodes: DataFrame) -> DataFrame:
    """Kind, text and variables of nodes without operands."""
    kind = F.when(F.col("value") == "literal", X.template_kind(F.col("text"))).when(F.col("value") == "format", "fstring").otherwise(F.col("value"))
    names = (
        F.when(F.col("value") == "fstring", F.coalesce("items", F.array().cast(NONE)))
        .when(F.col("value") == "format", F.regexp_extract_all("text", F.lit(BRACE_SLOT)))
        .when(kind == "jinja2", F.regexp_extract_all("text", F.lit(JINJA_SLOT)))
        .otherwise(F.array().cast(NONE))
    )
    return nodes.where("value not in ('concat', 'wrap', 'blocks')").select("id", "parent", "pos", "name", kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"), names.alias("vars"))


def _folded(what: Column, kids: Column) -> tuple[Column, Column, Column]:
    """Kind, text and variables of an operation over its operands in order."""
    unknown = F.lit("{<expr>}")
    slot = lambda x: F.when(x["text"] != "", x["text"]).otherwise(F.when(x["name"].isNotNull(), F.concat(F.lit("{"), x["name"], F.lit("}"))).otherwise(unknown))
    bare = lambda x: F.when((x["text"] == "") & x["name"].isNotNull(), F.array(x["name"])).otherwise(x["vars"])
    only = F.get(kids, 0)
    block_names = F.array_distinct(F.flatten(F.transform(kids, lambda x: x["vars"])))
    any_known = F.exists(kids, lambda x: x["kind"] != "unresolved")
    block_kind = F.when(F.size(block_names) > 0, "fstring").when(any_known, "literal").otherwise("unresolved")
    kind = F.when(what == "concat", "concat").when(what == "wrap", only["kind"]).otherwise(block_kind)
    text = (
        F.when(what == "concat", F.array_join(F.transform(kids, slot), ""))
        .when(what == "wrap", only["text"])
        .otherwise(F.array_join(F.transform(kids, lambda x: F.when(x["text"] != "", x["text"]).otherwise(unknown)), "\n\n"))
    )
    names = F.when(what == "concat", F.array_distinct(F.flatten(F.transform(kids, bare)))).when(what == "wrap", only["vars"]).otherwise(block_names)
    return kind, text, names


def fold_expressions(nodes: DataFrame) -> DataFrame:
    """``(id, kind, text, vars)`` of every whole expression of ``nodes``, which are ``expr`` facts.

    ``+`` joins its operands (kind ``concat``; a name stands as ``{name}``, what is not known as ``{<expr>}``);
    ``dedent()`` and ``strip()`` pass their operand on; ``"...".format()`` is an f-string of its braces; content
    blocks are joined by blank lines. They nest freely. A level of all expressions is folded at a time, from the
    deepest up, by one aggregation of operands under their operation.
    """
    deepest = nodes.agg(F.max("depth")).first()[0]
    solved = None
    for level in reversed(range((deepest or 0) + 1)):
        here = nodes.where(F.col("depth") == level)
        leaves = _leaves(here)
        if solved is not None:
            under = solved.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "text", "vars", "name"))).alias("kids"))
            kind, text, names = _folded(F.col("value"), F.col("kids"))
            inner = here.where("value in ('concat', 'wrap', 'blocks')").join(under.withColumnRenamed("parent", "id"), "id")
            name = F.lit(None).cast("string")
            leaves = leaves.unionByName(inner.select("id", "parent", "pos", name.alias("name"), kind.alias("kind"), text.alias("text"), names.alias("vars")))
        solved = materialise(leaves, "expressions") if level and (deepest - level) % LEVELS == LEVELS - 1 else leaves
    return solved.where("parent is null").select("id", "kind", "text", "vars")


def with_folded(rows: DataFrame, folded: DataFrame, tasks: int) -> DataFrame:
    """Messages or assignments with the kind, text and variables of their expressions, where these are known.

    A plain literal that holds a template's marks is one (X3). The join is dealt over ``tasks``; rows without an
    expression, which are most, are dealt by their file, with a mark that no expression's id ends with.
    """
    known = folded.where(F.col("kind") != "unresolved").select(F.col("id").alias("_id"), F.col("kind").alias("_kind"), F.col("text").alias("_text"), "vars")
    keyed = rows.withColumn("_key", F.coalesce("id", F.concat("file", F.lit(":")))).repartition(tasks, "_key")
    both = keyed.join(known.repartition(tasks, "_id"), F.col("_key") == F.col("_id"), "left")
    kind = F.coalesce("_kind", F.when(F.col("value") == "literal", X.template_kind(F.col("text"))).otherwise(F.col("value")))
    out = {"value": kind, "text": F.coalesce("_text", "text"), "items": F.coalesce("vars", "items"), "id": F.lit(None).cast("string")}
    return both.select(*[out[c].alias(c) if c in out else F.col(c) for c in rows.columns])
