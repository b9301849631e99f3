"""Names of a project's modules, and the file that defines what a file means by a name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Imports that a name is followed over, from a package to the module that has it.
HOPS = 4


def project(file: Column) -> Column:
    """A file's first folder."""
    return F.split(file, "/")[0]


def _package(file: Column) -> Column:
    """The folders below the project that a file lies in."""
    parts = F.split(file, "/")
    return F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))


def module(file: Column) -> Column:
    """Dotted path of a file below its project; a package stands for its ``__init__``."""
    name = F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.py$", "")
    return F.array_join(F.when(name == "__init__", _package(file)).otherwise(F.concat(_package(file), F.array(name))), ".")


def _absolute(file: Column, value: Column) -> Column:
    """An import's module; a relative one counts from the file's package up."""
    dots = F.length(F.regexp_extract(value, r"^(\.*)", 1))
    rest = F.nullif(F.regexp_replace(value, r"^\.+", ""), F.lit(""))
    above = F.slice(_package(file), 1, F.greatest(F.size(_package(file)) - dots + 1, F.lit(0)))
    return F.when(dots == 0, value).otherwise(F.array_join(F.when(rest.isNull(), above).otherwise(F.concat(above, F.array(rest))), "."))


def _tails(df: DataFrame) -> DataFrame:
    """A row for each name under which a module may be imported: its path, with or without outer folders."""
    parts = F.split("module", r"\.")
    tail = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), ".")))
    return df.withColumn("module", tail)


def aliases(imports: DataFrame) -> DataFrame:
    """``(file, name, module, of)``: names that a file imports from modules, and what they are called there."""
    some = imports.where("text is not null and text <> '*'").groupBy("file", "name").agg(F.max_by(F.struct("value", "text"), "line").alias("_i"))
    return some.select("file", "name", _absolute(F.col("file"), F.col("_i.value")).alias("module"), F.col("_i.text").alias("of"))


def resolve_symbols(names: DataFrame, definitions: DataFrame, imports: DataFrame) -> DataFrame:
    """``names`` ``(file, name)`` with the file and name ``(at, of)`` of what they stand for in the project.

    ``definitions`` is ``(file, name)``. An import counts before the file's own definitions, and its alias gives the
    name: that of the imported module, over further imports of packages, else the first file of the project that
    defines the name. Files of another project never count. Names that no file defines have no row.
    """
    own = definitions.select("file", "name").distinct()
    placed = own.withColumn("project", project(F.col("file")))
    first = placed.groupBy("project", F.col("name").alias("of")).agg(F.min("file").alias("_first"))
    modules = _tails(placed.withColumn("module", module(F.col("file")))).groupBy("project", "module", F.col("name").alias("of")).agg(F.min("file").alias("_in"))
    known = aliases(imports)
    passed = known.withColumn("project", project(F.col("file"))).select("project", module(F.col("file")).alias("_m"), "name", "module", "of")
    onward = _tails(passed.withColumnRenamed("module", "_to").withColumnRenamed("_m", "module")).groupBy("project", "module", F.col("name").alias("of")).agg(F.min(F.struct("_to", F.col("of").alias("_as"))).alias("_next"))
    asked = names.select("file", "name").distinct().join(known, ["file", "name"], "left").withColumn("project", project(F.col("file")))
    out = asked.withColumn("imported", F.col("of").isNotNull()).withColumn("of", F.coalesce("of", "name")).withColumn("at", F.lit(None).cast("string"))
    for _ in range(HOPS):
        met = out.join(modules, ["project", "module", "of"], "left").join(onward, ["project", "module", "of"], "left")
        at = F.coalesce("at", "_in")
        goes = at.isNull() & F.col("_next").isNotNull()
        out = met.select(
            "project", "file", "name", "imported", at.alias("at"),
            F.when(goes, F.col("_next._to")).otherwise(F.col("module")).alias("module"), F.when(goes, F.col("_next._as")).otherwise(F.col("of")).alias("of"),
        )
    here = own.withColumn("_own", F.col("file"))
    ends = out.join(here, ["file", "name"], "left").join(first, ["project", "of"], "left")
    at = F.coalesce("at", F.when(~F.col("imported"), F.col("_own")), "_first", "_own")
    return ends.select("file", "name", at.alias("at"), F.when(F.coalesce("at", "_first").isNull(), F.col("name")).otherwise(F.col("of")).alias("of")).where("at is not null")
