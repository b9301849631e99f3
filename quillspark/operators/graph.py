"""Graph operators over edge tables; every loop works on all graphs of the table together."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import contraction
from quillspark.operators.cases import pipeline_id
from quillspark.storage import materialise_at, remove


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int | None = None) -> DataFrame:
    """G1: weakly connected components as ``(node, component)``, the smallest node naming its component.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each round links every
    neighbour to the smallest one, so chains of any length shrink by a constant factor and no
    neighbourhood is ever collected; minima come from a partial aggregation and are joined back, so
    a hub's rows may be split over tasks by skew-join handling. A round ends in a Parquet table in
    the shared folder. Null ends are dropped; self-loops make a node a component of its own. Rounds go on
    until nothing moves; ``max_rounds`` makes more of them an error.
    """
    spark = edges.sparkSession
    clean = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    cur, path = materialise_at(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    first, first_path = cur, path
    stamp, size = None, cur.count()
    for number in itertools.count(1):
        if max_rounds is not None and number > max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        links = cur.where("u <> v")
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: larger neighbours of u go to the smallest node known to u.
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        # Small star: smaller neighbours of u, and u itself, go to the smallest of them.
        joined = large.join(low2, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        nxt, nxt_path = materialise_at(small.where("u <> v").distinct(), "stars", size)
        row = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if path != first_path:
            remove(spark, path)
        cur, path = nxt, nxt_path
        if (row["n"], row["h"]) == stamp or row["n"] == 0:
            break
        stamp = (row["n"], row["h"])
    nodes = first.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return nodes.join(cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def build_pipelines(edges: DataFrame, sites: DataFrame) -> DataFrame:
    """``(pipeline_id, name, component, nodes, n_nodes, n_edges, entries, exits)`` of each group of linked nodes.

    ``sites`` is ``(id, name)``. The id is X24's over the nodes. Entries have no edge in, exits none out; these and
    the nodes are sorted lists as text. The name comes from the first entry's site, or the first node's where
    a pipeline has no entry, or the component where that site is not known. Nodes without edges are in no pipeline.
    """
    named = components(edges)
    plain = edges.select("src", "dst").where("src <> dst").distinct()
    ins = plain.select(F.col("dst").alias("node")).distinct().withColumn("has_in", F.lit(True))
    outs = plain.select(F.col("src").alias("node")).distinct().withColumn("has_out", F.lit(True))
    nodes = named.join(ins, "node", "left").join(outs, "node", "left")
    listed = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("node"))))
    whole = nodes.groupBy("component").agg(
        F.count("*").alias("n_nodes"), F.array_sort(F.collect_set("node")).alias("nodes"), listed(F.col("has_in").isNull()).alias("entries"), listed(F.col("has_out").isNull()).alias("exits")
    )
    whole = whole.withColumn("_anchor", F.coalesce(F.get("entries", 0), F.get("nodes", 0)))
    named_after = whole.join(sites.select(F.col("id").alias("_anchor"), F.col("name").alias("_site")), "_anchor", "left")
    name = X.slug(F.concat(F.coalesce("_site", F.concat(F.lit("pipeline_"), F.substring(F.col("component").cast("string"), 1, 6))), F.lit("_pipeline")))
    joined = lambda c: F.array_join(F.transform(c, lambda n: n.cast("string")), ",").alias(c)
    whole = named_after.select(
        pipeline_id(F.transform("nodes", lambda n: n.cast("string"))).alias("pipeline_id"), name.alias("name"), "component", "n_nodes", joined("nodes"), joined("entries"), joined("exits")
    )
    n_edges = plain.join(named, plain["src"] == named["node"]).groupBy("component").agg(F.count("*").alias("n_edges"))
    return whole.join(n_edges, "component", "left").select(
        "pipeline_id", "name", "component", "nodes", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "entries", "exits"
    )


def downstream_impact(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``(start, node, distance, kinds)``: what each start reaches, by shortest paths.

    ``kinds`` are those on all shortest paths, sorted and joined. One ring a round for all starts; a
    ring's rows come from the ring before, joined with the edges, less what was reached already. The
    start is left out. A start that no edge names, and a cycle that a start reaches, is a ``ValueError``.
    """
    spark = edges.sparkSession
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("start"))
    unknown = starts.join(nodes, "start", "left_anti").first()
    if unknown is not None:
        raise ValueError(f"start {unknown['start']} is not in the graph")
    cyclic = reachable_cycles(edges, starts).where("cyclic").first()
    if cyclic is not None:
        raise ValueError(f"a cycle can be reached from {cyclic['start']}")
    plain = edges.select("src", "dst", "kind").distinct()
    ring = starts.select(F.col("start"), F.col("start").alias("node"), F.lit(0).alias("distance"), F.array().cast("array<string>").alias("kinds"))
    reached, path = materialise_at(ring, "ring")
    ring, paths = reached, [path]
    for distance in itertools.count(1):
        step = ring.join(plain, ring["node"] == plain["src"]).select(
            "start", F.col("dst").alias("node"), F.array_union("kinds", F.array("kind")).alias("kinds")
        )
        new = step.join(reached.select("start", "node"), ["start", "node"], "left_anti")
        merged = new.groupBy("start", "node").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("kinds"))
        ring, path = materialise_at(merged.select("start", "node", F.lit(distance).alias("distance"), "kinds"), "ring")
        if ring.isEmpty():
            remove(spark, path)
            break
        paths.append(path)
        reached = spark.read.schema(ring.schema).parquet(*paths)
    return reached.where("distance > 0").select("start", "node", "distance", F.array_join("kinds", ",").alias("kinds"))


def topo_levels(edges: DataFrame) -> DataFrame:
    """``(node, level)``: 0 without predecessors, else one more than the highest of them.

    Nodes on or behind a cycle have a null level. See :func:`contraction.levels`: chains and trees are followed by
    pointer jumping, so rounds do not follow the depth of a graph.
    """
    return contraction.levels(edges)


def reachable_cycles(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``(start, cyclic)``: whether a cycle can be reached from each start.

    See :func:`contraction.leading_to_cycles`: trimming by pointer jumping, then colouring forwards and backwards.
    """
    stuck = contraction.leading_to_cycles(edges).select(F.col("node").alias("start"), F.lit(True).alias("_c"))
    return starts.join(stuck, "start", "left").select("start", F.coalesce("_c", F.lit(False)).alias("cyclic"))


def dag_layers(edges: DataFrame) -> DataFrame:
    """``(node, layer)`` by the longest path; nodes on or behind a cycle come one layer past the end."""
    levels = topo_levels(edges)
    end = levels.agg(F.coalesce(F.max("level"), F.lit(-1)) + 1).first()[0]
    return levels.select("node", F.coalesce("level", F.lit(end)).alias("layer"))


def segment_entries(segments: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Where each run of part of a pipeline starts: ``(run_id, node)``.

    Known entries in the segment, or, for a segment without any, nodes without a predecessor in it.
    """
    known = segments.join(entries.select("node"), "node", "left_semi").select("run_id", "node")
    other = segments.join(known.select("run_id"), "run_id", "left_anti")
    inside = other.select("run_id", F.col("node").alias("src")).join(edges.select("src", "dst").where("src <> dst"), "src")
    led = inside.select("run_id", F.col("dst").alias("node")).distinct()
    return known.unionByName(other.join(led, ["run_id", "node"], "left_anti").select("run_id", "node")).distinct()


def impact_status_map(prompts: DataFrame, nodes: DataFrame, impact: DataFrame) -> DataFrame:
    """``(prompt_id, statuses)`` before any re-run: all consumers ``unverified``.

    Null for a prompt in no pipeline, an empty map for one without consumers.
    """
    found = impact.groupBy(F.col("start").alias("prompt_id")).agg(F.array_sort(F.collect_set("node")).alias("_n"))
    inside = nodes.select("prompt_id").distinct().withColumn("_in", F.lit(True))
    both = prompts.join(inside, "prompt_id", "left").join(found, "prompt_id", "left")
    entries = F.transform(F.coalesce("_n", F.array().cast("array<long>")), lambda n: F.struct(n.alias("k"), F.lit("unverified").alias("v")))
    return both.select("prompt_id", F.when(F.col("_in"), F.map_from_entries(entries)).alias("statuses"))
