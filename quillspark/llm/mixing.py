"""Mixing sources to target weights by capped water-filling; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.storage import materialise

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Leading hex digits of the seeded digest that name a slice of a source; 16 ** 4 slices a source.
SLICE_DIGITS = 4
#: What is known of up to so many sources is broadcast; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_sizes(sized: DataFrame) -> DataFrame:
    """``(source, source_size)`` of rows ``(source, size)``; null is a source like any other."""
    return sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))


def rank_sources(sources: DataFrame) -> DataFrame:
    """Add ``rank`` from 0, sources by code point and null last, without one task that sees them all.

    The sources are range-partitioned and sorted; a row's rank is its place in its partition plus the
    sizes of the partitions before, of which there are as many as shuffle partitions.
    """
    ordered = materialise(
        sources.repartitionByRange(F.col("source").isNull(), F.col("source"))
        .sortWithinPartitions(F.col("source").isNull(), F.col("source"))
        .withColumn("_at", F.monotonically_increasing_id()),
        "sources",
    )
    at = F.shiftright("_at", 33)
    parts = ordered.groupBy(at.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return ordered.join(offsets, at == F.col("_part")).select(
        *sources.columns, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("rank")
    )


def cyclic_weights(sources: DataFrame, cycle: Sequence[int]) -> DataFrame:
    """Add ``weight``: the cycle's weights in turn, by the sources' rank."""
    cases = F.element_at(F.array(*[F.lit(int(w)) for w in cycle]), (F.col("rank") % len(cycle)).cast("int") + 1)
    return rank_sources(sources).withColumn("weight", cases.cast("long"))


def water_fill(weighted: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Add ``target``: ``share`` of all sizes dealt by weight, none above ``max_epochs`` times its size.

    Each round deals what the clamped sources leave to the others in proportion to their weights and
    clamps those that would pass their cap; it ends when none does. A round sends one row of sums to
    the driver; sources stay distributed. If every source is clamped the rest cannot be dealt.
    """
    sources = materialise(weighted.withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs))), "weights", weighted.count())
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    # A source is clamped when the level, the share of a unit of weight, reaches its cap a weight, so
    # the clamped ones are those up to a bound; the bound grows until nothing changes.
    clamped, level = F.lit(False), (0.0, 0)
    n_before = -1
    while True:
        row = sources.agg(
            F.coalesce(F.sum(F.when(clamped, F.col("_cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0)),
            F.count(F.when(clamped, 1)),
        ).first()
        level = (total - row[0], row[1])
        if row[2] == n_before or not row[1]:
            break
        n_before = row[2]
        clamped = clamped | (F.lit(level[0]) * F.col("weight") / F.lit(level[1]) > F.col("_cap"))
    dealt = F.lit(level[0]) * F.col("weight") / F.lit(level[1]) if level[1] else F.lit(0.0)
    return sources.withColumn("target", F.when(clamped, F.col("_cap")).otherwise(dealt)).drop("_cap")


def sample_repetitions(sized: DataFrame, targets: DataFrame, seed: int, id_col: str = "doc_id") -> DataFrame:
    """Add ``taken``: the words of each row that the mix takes, repeats counted.

    With ``e = target / source_size`` epochs, each row is taken whole ``floor(e)`` times. The rest of
    the target goes to rows in the order of a seeded digest of their id: whole rows as long as they
    fit, then the first words of the row at the edge. So a source's taken words are its target,
    rounded, and no row exceeds ``floor(e) + 1`` times its size. Reruns agree.

    A source's order is never put into one task: its rows fall into 16^4 slices by digest, slice sums
    give the slice with the edge, and only that slice's rows are sorted. Rows of equal id are
    interchangeable and may be taken in either order.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = sized.withColumn("_d", digest).withColumn("_slice", F.substring("_d", 1, SLICE_DIGITS))
    slices = rows.groupBy("source", "_slice").agg(F.sum("size").alias("_sum"))
    up_to = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    facts = (
        targets.where("source_size > 0")
        .withColumn("_whole", F.floor(F.col("target") / F.col("source_size")).cast("long"))
        .withColumn("_rest", F.round("target").cast("long") - F.col("_whole") * F.col("source_size"))
        .select(F.col("source").alias("_src"), "source_size", "target", "_whole", "_rest")
    )
    same = F.col("source").eqNullSafe(F.col("_src"))
    edges = (
        slices.withColumn("_upto", F.sum("_sum").over(up_to))
        .join(facts, same)
        .where("_upto >= _rest and _upto - _sum < _rest")
        .select(F.col("_src").alias("_src2"), F.col("_slice").alias("_edge"), (F.col("_upto") - F.col("_sum")).alias("_before"))
    )
    known = targets.select(F.col("source").alias("_src0"), F.col("source_size").alias("_size0"), F.col("target").alias("_target0"))
    facts = (
        known.join(facts, F.col("_src0").eqNullSafe(F.col("_src")), "left")
        .join(edges, F.col("_src0").eqNullSafe(F.col("_src2")), "left")
        .select(
            F.col("_src0").alias("_src"),
            F.col("_size0").alias("source_size"),
            F.col("_target0").alias("target"),
            F.coalesce("_whole", F.lit(0)).alias("_whole"),
            F.coalesce("_rest", F.lit(0)).alias("_rest"),
            "_edge",
            "_before",
        )
    )
    if targets.count() <= BROADCAST_SOURCES:
        facts = F.broadcast(facts)
    joined = rows.join(facts, same).drop("_src")
    # Dealt anew, so that the join before may split a large source over tasks.
    at_edge = joined.where("_slice = _edge").repartition("source", "_slice")
    order = Window.partitionBy("source", "_slice").orderBy("_d", "size").rowsBetween(Window.unboundedPreceding, -1)
    sorted_edge = at_edge.withColumn("_left", F.col("_rest") - F.col("_before") - F.coalesce(F.sum("size").over(order), F.lit(0)))
    extra_edge = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left")))
    extra = F.when(F.col("_slice") < F.col("_edge"), F.col("size")).otherwise(F.lit(0))
    out = [*sized.columns, "source_size", "target"]
    taken = lambda x: (F.col("_whole") * F.col("size") + x).cast("long").alias("taken")
    rest = joined.where("_edge is null or _slice <> _edge").select(*out, taken(extra))
    return rest.unionByName(sorted_edge.select(*out, taken(extra_edge)))


def mix_sources(
    docs: DataFrame, cycle: Sequence[int] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` of every row of ``docs``.

    Null texts have size 0; a null source is a source, the last. Sources of size 0 get target 0.
    An empty table gives an empty result. Other columns are ignored.
    """
    sized = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    targets = water_fill(cyclic_weights(source_sizes(sized), cycle), share, max_epochs).select("source", "source_size", "target")
    return sample_repetitions(sized, materialise(targets, "targets", targets.count()), seed)


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: rows repeated, the rows at a source's edge cut.

    A row of a non-empty text appears once per whole repetition, and once more with its first words
    for what is left; in a cut row ``n_chars``, if there is one, is the cut text's. Rows without words are
    not taken. Rows of one id, source and size share what :func:`mix_sources` takes of them in the order of
    their texts' hashes, so each of several repeated rows, or of rows with null ids, has its own part and the
    words are the mix's. Columns may have any names; an empty table gives an empty one.
    """
    size = word_count(F.col("text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct("doc_id", "source", size.alias("size")).alias("alike")).where("alike.size > 0")
    mix = mix_sources(docs, **options).groupBy(F.struct("doc_id", "source", "size").alias("alike")).agg(F.count("*").alias("n"), F.sum("taken").alias("sum"))
    # One key of one type, in which nulls are equal: so the numbering and the join need one shuffle.
    ordered = rows.withColumn("k", F.row_number().over(Window.partitionBy("alike").orderBy(F.xxhash64("row.text"))))
    # The group's words: whole repetitions of all its rows, then of the first ones, then a part of the next.
    joined = ordered.join(mix, "alike").select("row", "k", "n", "sum", "alike.size")
    whole = F.floor(F.col("sum") / (F.col("n") * F.col("size")))
    extra = F.col("sum") - whole * F.col("n") * F.col("size") - (F.col("k") - 1) * F.col("size")
    dealt = joined.withColumn("taken", whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), extra))).where("taken > 0")
    pieces = F.split("row.text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.col("row.text").rlike(r"^[\x20\x09-\x0D]").cast("long")
    cut = F.array_join(F.slice(pieces, F.lit(1), (F.col("taken") % F.col("size") + lead).cast("int")), "")
    copies = F.expr("transform(sequence(1, cast(ceil(taken / size) as int)), k -> k * size <= taken)")
    out = dealt.withColumn("is_whole", F.explode(copies)).withColumn("cut", F.when(~F.col("is_whole"), cut))
    short = F.col("row").withField("text", F.col("cut"))
    if "n_chars" in docs.columns:
        short = short.withField("n_chars", F.char_length("cut").cast(docs.schema["n_chars"].dataType))
    return out.select(F.when(F.col("is_whole"), F.col("row")).otherwise(short).alias("row")).select("row.*")
