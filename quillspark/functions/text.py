"""Scalar functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Role names that others use for ours.
ROLE_ALIASES = {"human": "user", "ai": "assistant", "function": "tool"}
SLOT = r"\{\{?\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}\}?"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` found once a row; named in several branches of a ``when``, an expression is run in each."""
    return F.transform(F.array(value), use)[0]


def render(template: Column, values: Column) -> Column:
    """``{name}`` and ``{{ name }}`` filled from a map in one pass; unknown names stay as they are.

    Values are not searched again, so braces or dollar signs in them mean nothing.
    """
    between = F.split(template, SLOT)
    slots = F.regexp_extract_all(template, F.lit(SLOT), F.lit(0))
    names = F.regexp_extract_all(template, F.lit(SLOT), F.lit(1))
    filled = F.zip_with(slots, names, lambda s, n: F.coalesce(F.try_element_at(values, n), s))
    return F.array_join(F.zip_with(between, filled, lambda b, f: F.concat(b, F.coalesce(f, F.lit("")))), "")


def variables(template: Column) -> Column:
    """Names of a template's slots in order, each once."""
    return F.array_distinct(F.regexp_extract_all(template, F.lit(SLOT), F.lit(1)))


def template_kind(text: Column) -> Column:
    """``jinja2`` for double braces or a statement block, else ``literal``."""
    return F.when(text.rlike(r"\{\{.*?\}\}|\{%\s*\w+"), "jinja2").otherwise("literal")


def slug(text: Column, default: str = "anonymous") -> Column:
    """Runs of anything but letters, digits and underscores become one underscore."""
    cleaned = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(default))


def token_estimate(text: Column) -> Column:
    """About a quarter of the characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def output_estimate(tokens: Column) -> Column:
    """As many tokens out as in, within 64 and 1024."""
    return F.least(F.lit(1024), F.greatest(F.lit(64), tokens)).cast("long")


def truncate(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last an ellipsis if any were cut."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 1), F.lit("…")))


def preview(text: Column, limit: int = 200) -> Column:
    """One line, line feeds shown as a sign."""
    return truncate(F.replace(text, F.lit("\n"), F.lit("⏎")), limit)


def json_object(reply: Column) -> Column:
    """The JSON object in a model's reply, as text; null if there is none that parses.

    A code fence is taken off; else what lies between the first ``{`` and the last ``}`` is tried.
    """
    from_ = F.instr(reply, "{")
    to = F.length(reply) - F.instr(F.reverse(reply), "}") + 1
    inner = F.when((from_ > 0) & (F.instr(reply, "}") > 0) & (to > from_), F.substring(reply, from_, to - from_ + 1))
    starts = F.ltrim(F.regexp_replace(reply, r"^\s*```\w*\s*", ""))
    return bound(inner, lambda x: F.when(~starts.startswith("[") & F.try_parse_json(x).isNotNull(), x))


def score(raw: Column) -> Column:
    """A reply's score as text: booleans are 0 and 1, numbers are held within 0 and 1, the rest is 0."""
    number = bound(raw, lambda r: F.when(F.lower(r) == "true", 1.0).when(F.lower(r) == "false", 0.0).otherwise(r.try_cast("double")))
    return bound(number, lambda n: F.when(n.isNull() | F.isnan(n), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), n))))


def role(name: Column) -> Column:
    """The role that an alias stands for; others stay."""
    table = F.create_map(*[F.lit(x) for kv in ROLE_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(name)), F.lower(name))


def response_format(name: Column) -> Column:
    """``text`` and ``json`` pass, others become null."""
    return F.when(name.isin("text", "json"), name)
