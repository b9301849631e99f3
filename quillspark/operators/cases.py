"""Cases: the run matrix (J2), ids (X5, X6, X24), replies that list cases (X11, X23), padding (X15, Q9), node inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What padding puts into a case's first text slot, by turns.
BOUNDARY = ("", "a", "   ", "x" * 4000)
#: Keys of a case that are not inputs.
META = ("tags", "notes", "expected")
#: Cases that a task of the run matrix holds at most on average (so few that a Parquet file's dictionary has all their
#: texts), and those of one dataset that go together.
CASES_A_TASK, CASES_A_PART = 128, 32


def run_matrix(targets: DataFrame, cases: DataFrame, inline: DataFrame) -> DataFrame:
    """``(target_id, case_index, body)``: a target's inline cases, else those of its dataset.

    ``targets`` is ``(target_id, dataset_id)``, ``cases`` ``(dataset_id, case_index, body)``, ``inline``
    ``(target_id, case_index, body)``. A dataset's cases meet all its targets, so there are far more rows out than in. The
    join goes through the cases and holds the targets' ids: a body's rows follow each other, which columnar files keep
    as one body and a run, and no text is held or spilled for each target. Partitions are as many as there are
    ``CASES_A_TASK`` cases, since each makes a row for every target; a large dataset is dealt over several. Ids of targets
    are merged, as they grow with the input and are small enough in files to be broadcast; only a row a dataset may be.
    """
    own = inline.hint("merge").join(targets.select("target_id"), "target_id", "left_semi")
    some = targets.hint("merge").join(inline.select("target_id"), "target_id", "left_anti").select("target_id", "dataset_id")
    sizes = cases.groupBy("dataset_id").agg(F.ceil(F.count("*") / CASES_A_PART).cast("int").alias("_parts"))
    tasks = max(1, -(-cases.count() // CASES_A_TASK))
    # A dataset's targets go to each of its parts; a case goes to one.
    dealt = some.hint("merge").join(sizes, "dataset_id").select("target_id", "dataset_id", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part")).repartition(tasks, "dataset_id", "_part")
    placed = cases.join(sizes, "dataset_id").withColumn("_part", F.pmod(F.xxhash64("case_index"), "_parts").cast("int")).drop("_parts").repartition(tasks, "dataset_id", "_part")
    rest = placed.hint("merge").join(dealt, ["dataset_id", "_part"])
    return own.select("target_id", "case_index", "body").unionByName(rest.select("target_id", "case_index", "body"))


def site_id(file: Column, line: Column, col: Column, texts: Column) -> Column:
    """12 hex digits over a call site's place and message texts; a missing column is ``?``."""
    parts = [file, line.cast("string"), F.coalesce(col.cast("string"), F.lit("?")), F.array_join(texts, "|")]
    return F.substring(F.sha1(F.concat_ws(":", *parts)), 1, 12)


def canonical_json(inputs: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(inputs))))


def case_id(site: Column, inputs: Column) -> Column:
    """12 hex digits over a site and its inputs, whatever order the keys come in."""
    return F.substring(F.sha1(F.concat(site.cast("string"), F.lit("\x00"), canonical_json(inputs))), 1, 12)


def pipeline_id(nodes: Column) -> Column:
    """12 hex digits over a pipeline's sorted node ids."""
    return F.substring(F.sha1(F.array_join(F.array_sort(F.array_distinct(nodes)), "|")), 1, 12)


def json_objects(reply: Column) -> Column:
    """X11: the objects of the JSON array in a reply, each as text; null without an array that parses."""
    begin, end = F.instr(reply, "["), F.length(reply) - F.instr(F.reverse(reply), "]") + 1
    inner = F.when((begin > 0) & (F.instr(reply, "]") > 0) & (end > begin), F.substring(reply, begin, end - begin + 1))
    items = F.when(F.try_parse_json(inner).isNotNull(), F.from_json(inner, "array<variant>"))
    return F.transform(F.filter(items, lambda x: F.schema_of_variant(x).startswith("OBJECT")), lambda x: F.to_json(x))


def case_inputs(item: Column, seed: Column) -> Column:
    """A listed case's inputs; slots it lacks come from the seed's, and without ``inputs`` all but metadata counts.

    Null where the item has no inputs at all.
    """
    wrapped = F.from_json(F.get_json_object(item, "$.inputs"), "map<string,string>")
    bare = F.map_filter(F.from_json(item, "map<string,string>"), lambda k, _: ~k.isin(*META))
    own = F.coalesce(wrapped, bare)
    missing = F.map_filter(seed, lambda k, _: ~F.map_contains_key(own, k))
    return F.when(F.size(own) > 0, F.map_concat(own, missing))


def boundary_inputs(seed: Column, first: Column, index: Column) -> Column:
    """The seed's inputs with its slot ``first`` set to a boundary value by ``index``."""
    value = F.element_at(F.array(*[F.lit(v) for v in BOUNDARY]), (index % len(BOUNDARY) + 1).cast("int"))
    return F.when(first.isNull(), seed).otherwise(F.transform_values(seed, lambda k, v: F.when(k == first, value).otherwise(v)))


def expand_cases(seeds: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """Q9: exactly ``n`` new cases a site: those found that are no seeds, in order, then boundary cases.

    ``seeds`` is ``(site, inputs)`` with one row a site, ``found`` ``(site, pos, inputs)``. Ids are X6's; a
    boundary case whose id is taken has its index added to the inputs.
    """
    named = found.where(F.size("inputs") > 0).withColumn("case_id", case_id(F.col("site"), F.col("inputs")))
    once = named.groupBy("site", "case_id").agg(F.min(F.struct("pos", F.to_json("inputs").alias("j"))).alias("_f"))
    known = seeds.select("site", case_id(F.col("site"), F.col("inputs")).alias("case_id"))
    fresh = once.join(known, ["site", "case_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("site").orderBy("_f.pos", "case_id"))
    kept = fresh.withColumn("k", rank - 1).where(F.col("k") < n).select("site", "k", "case_id", F.lit("model").alias("origin"))
    have = kept.groupBy("site").agg(F.count("*").alias("_n"))
    pad = seeds.join(have, "site", "left").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).where(F.col("k") >= F.coalesce("_n", F.lit(0)))
    edge = boundary_inputs(F.col("inputs"), F.try_element_at(F.map_keys("inputs"), F.lit(1)), F.col("k"))
    marked = F.map_concat("_e", F.create_map(F.lit("_fill_index"), F.col("k").cast("string")))
    # The first round of boundary values is told apart by value, later ones repeat it.
    plain = pad.withColumn("_e", edge).withColumn("_id", case_id(F.col("site"), F.col("_e")))
    taken = known.unionByName(kept.select("site", "case_id")).withColumnRenamed("case_id", "_id").withColumn("_t", F.lit(True))
    filled = plain.join(taken.distinct(), ["site", "_id"], "left").withColumn(
        "case_id", F.when(F.col("_t") | (F.col("k") - F.coalesce("_n", F.lit(0)) >= len(BOUNDARY)), case_id(F.col("site"), marked)).otherwise(F.col("_id"))
    )
    return kept.unionByName(filled.select("site", "k", "case_id", F.lit("boundary").alias("origin")))


def node_inputs(cases: DataFrame, edges: DataFrame, outputs: DataFrame) -> DataFrame:
    """``(node, case_index, inputs)``: the case's inputs, overlaid with outputs of the nodes before.

    ``cases`` is ``(node, case_index, inputs)``, ``edges`` ``(src, dst, via, pos)``, ``outputs``
    ``(node, case_index, text)``. An output is named by the edge's ``via``, or else by its source; of
    equal names the later edge wins.
    """
    sent = outputs.withColumnRenamed("node", "src").join(edges, "src")
    named = sent.select(F.col("dst").alias("node"), "case_index", F.coalesce("via", F.col("src").cast("string")).alias("name"), "pos", "src", "text")
    last = named.groupBy("node", "case_index", "name").agg(F.max(F.struct("pos", "src", "text"))["text"].alias("text"))
    over = last.groupBy("node", "case_index").agg(F.map_from_entries(F.collect_list(F.struct("name", "text"))).alias("_over"))
    both = cases.join(over, ["node", "case_index"], "left")
    kept = F.map_filter("inputs", lambda k, _: ~F.map_contains_key("_over", k))
    return both.select("node", "case_index", F.when(F.col("_over").isNull(), F.col("inputs")).otherwise(F.map_concat(kept, "_over")).alias("inputs"))
