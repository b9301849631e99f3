"""Levels and cycles of directed graphs in rounds that do not follow their depth: pointer jumping and colouring."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillspark.storage import materialise_at, remove

#: Contraction goes on while a round leaves at most so much of the edges; colouring does the rest.
SHRINKS = 0.8
#: Pointers that a round follows one after the other, each as far as those of the round before.
HOPS = 3


def _written(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, str, dict[str, int]]:
    """A written table, its path, and counts that were observed while it was written."""
    seen = Observation()
    out, path = materialise_at(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in counts.items()]), name)
    return out, path, seen.get


def follow_pointers(pointers: DataFrame) -> tuple[DataFrame, str, DataFrame]:
    """List ranking: ``(node, root, dist)`` followed to roots that no pointer leaves; the path; and the nodes that
    have no such root, as they lead into a loop.

    A null root is final. Each round follows every pointer as far as it has come already, so a chain of n takes
    log4(n) rounds, and what has not ended by then never does.
    """
    cur, path, seen = _written(pointers, "pointers")
    for k in range(math.ceil(math.log(max(2, seen["rows"]), HOPS + 1)) + 1):
        step = cur.withColumn("open", F.lit(True))
        ahead = cur.select(F.col("node").alias("_n"), F.col("root").alias("_r"), F.col("dist").alias("_d"))
        for _ in range(HOPS):
            moved = F.col("_n").isNotNull()
            step = step.join(ahead, F.col("root") == F.col("_n"), "left").select(
                "node", F.when(moved, F.col("_r")).otherwise(F.col("root")).alias("root"), (F.col("dist") + F.coalesce("_d", F.lit(0))).alias("dist"), moved.alias("open")
            )
        old = path
        cur, path, seen = _written(step, "pointers", left=F.col("open"))
        remove(cur.sparkSession, old)
        if not seen["left"]:
            return cur.select("node", "root", "dist"), path, cur.where("1 = 0").select("node")
        cur = cur.select("node", "root", "dist")
    # After that many rounds an open pointer has gone further than there are nodes.
    named = cur.select(F.col("node").alias("_n"))
    looped = cur.join(named, cur["root"] == named["_n"], "left_semi").select("node")
    return cur.join(looped.select(F.col("node").alias("_n")), cur["node"] == F.col("_n"), "left_anti").select("node", "root", "dist"), path, looped


def levels(edges: DataFrame) -> DataFrame:
    """``(node, level)``: the longest way from a node without predecessors; null on and behind cycles.

    A node with one predecessor lies one above it, so all such nodes point at it and :func:`follow_pointers` finds
    where their chains and trees hang. What is left keeps edges with lengths between the rest. Nodes without
    predecessors are one root together; a node whose predecessors hang on one root has one predecessor in
    the next round. So chains, trees and what is nested from them, of any depth, take a few rounds; a round
    settles at least one level.
    """
    spark = edges.sparkSession
    plain, first = materialise_at(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).where("u is not null and v is not null").distinct(), "live")
    nodes = plain.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sources = plain.select(F.col("u").alias("node")).distinct().join(plain.select(F.col("v").alias("node")), "node", "left_anti")
    roots = sources.select("node", F.lit(None).cast(plain.schema["u"].dataType).alias("root"), F.lit(0).alias("dist"))
    live, path = plain.withColumn("w", F.lit(1)), first
    found: list[DataFrame] = []
    for number in itertools.count():
        single = live.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("u", "w")).alias("_e")).where("n = 1").select(F.col("v").alias("node"), F.col("_e.u").alias("root"), F.col("_e.w").alias("dist"))
        pointers, at, looped = follow_pointers(single.unionByName(roots) if number == 0 else single)
        found.append(pointers)
        # Nodes of a loop are no one's level; edges out of them stay, so that what is behind them never gets one.
        settled = pointers.select("node").unionByName(looped).select(F.col("node").alias("v"))
        hung = pointers.select(F.col("node").alias("_n"), F.col("root").alias("_r"), F.col("dist").alias("_d"))
        rest = live.join(settled, "v", "left_anti")
        moved = rest.join(hung, rest["u"] == hung["_n"], "left")
        longest = moved.groupBy(F.when(F.col("_n").isNotNull(), F.col("_r")).otherwise(F.col("u")).alias("u"), "v").agg(F.max(F.col("w") + F.coalesce("_d", F.lit(0))).alias("w"))
        old, before = path, live
        live, path, seen = _written(longest, "live")
        if old != first:
            remove(spark, old)
        if not seen["rows"] or number and pointers.isEmpty():
            break
    known = found[-1].where("root is null").select("node", F.col("dist").alias("level"))
    for pointers in reversed(found[:-1]):
        above = known.select(F.col("node").alias("root"), F.col("level").alias("_l"))
        hanging = pointers.join(above, "root").select("node", (F.col("_l") + F.col("dist")).alias("level"))
        known = materialise_at(known.unionByName(pointers.where("root is null").select("node", F.col("dist").alias("level"))).unionByName(hanging), "levels")[0]
    return nodes.join(known, "node", "left").select("node", F.col("level").cast("int").alias("level"))


def _furthest(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``(node, best)``: the largest label among a node's own and those of all nodes with a way to it.

    ``labels`` is ``(node, best)``, a struct with the node as ``id``. A round takes the largest label of the
    predecessors, and of the node whose label is held, so labels jump: rounds grow with the logarithm of the
    way, where labels are in random order.
    """
    cur, path, _ = _written(labels, "labels")
    while True:
        near = edges.join(cur.select(F.col("node").alias("src"), "best"), "src").select(F.col("dst").alias("node"), "best")
        jump = cur.select("node", F.col("best.id").alias("_at")).join(cur.select(F.col("node").alias("_at"), "best"), "_at").select("node", "best")
        offered = near.unionByName(jump).groupBy("node").agg(F.max("best").alias("_new"))
        better = F.greatest(F.col("best"), F.col("_new"))
        step = cur.join(offered, "node", "left").select("node", better.alias("best"), (better > F.col("best")).alias("moved"))
        old = path
        cur, path, seen = _written(step, "labels", moved=F.coalesce("moved", F.lit(False)))
        cur = cur.select("node", "best")
        remove(cur.sparkSession, old)
        if not seen["moved"]:
            return cur


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """``(node)``: those that lie on a cycle, by colouring forwards and backwards.

    In each round nodes take a random order; a node's colours are the largest node that has a way to it and the
    largest that it has a way to. An edge between different colours is on no cycle; equal ones are a strongly
    connected component if both colours are the same node. The rest goes on under another order, as the largest node
    parts it into what is before it and what is behind.
    """
    found = edges.where("src = dst").select(F.col("src").alias("node"))
    left, path, seen = _written(edges.select("src", "dst").where("src <> dst").distinct(), "parts")
    for number in itertools.count():
        if not seen["rows"]:
            return found.distinct()
        ends = _ends(left)
        order = ends.select("node", F.struct(F.xxhash64(F.lit(number), "node").alias("h"), F.col("node").alias("id")).alias("best"))
        before = _furthest(left, order).select("node", F.col("best.id").alias("f"))
        colours, _, _ = _written(before.join(_furthest(_turned(left), order).select("node", F.col("best.id").alias("b")), "node"), "colours")
        of = lambda end: colours.select(F.col("node").alias(end), F.struct("f", "b").alias(f"_{end}"))
        inside = left.join(of("src"), "src").join(of("dst"), "dst").where("_src = _dst").select("src", "dst", (F.col("_src.f") == F.col("_src.b")).alias("whole"))
        inside, at, _ = _written(inside, "inside")
        found = found.unionByName(_ends(inside.where("whole")))
        old = path
        left, path, seen = _written(inside.where("not whole").select("src", "dst"), "parts")
        remove(left.sparkSession, old)


def leading_to_cycles(edges: DataFrame) -> DataFrame:
    """``(node)``: those that have a way to a cycle, or lie on one.

    Trimming first: a node with one successor leads where that leads, so chains and trees hang on what is left
    (:func:`follow_pointers`), and edges to nodes that lead nowhere go. Once a round no longer shrinks the edges much,
    :func:`cyclic_nodes` and one more colouring, in which nodes of cycles come before all others, settle the rest.
    """
    spark = edges.sparkSession
    some = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    # A null end is a cycle; so is an edge to oneself.
    live, path, seen = _written(some.select("src", F.nullif("dst", "src").alias("dst")), "live")
    found: list[tuple[DataFrame, DataFrame]] = []
    while seen["rows"]:
        size = seen["rows"]
        outs = live.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("dst").isNull()).alias("bad"), F.max("dst").alias("_d"))
        one = outs.where("n = 1 or bad > 0").select(F.col("src").alias("node"), F.when(F.col("bad") == 0, F.col("_d")).alias("root"), F.lit(1).cast("long").alias("dist"))
        pointers, _, looped = follow_pointers(one)
        looped, _, _ = _written(looped, "looped")
        found.append((pointers, looped))
        gone = pointers.select("node").unionByName(looped).select(F.col("node").alias("src"))
        rest = live.join(gone, "src", "left_anti")
        hung = pointers.select(F.col("node").alias("_n"), F.col("root").alias("_r")).unionByName(looped.select(F.col("node").alias("_n"), F.lit(None).cast(live.schema["src"].dataType).alias("_r")))
        moved = rest.join(hung, rest["dst"] == hung["_n"], "left").select("src", F.when(F.col("_n").isNotNull(), F.col("_r")).otherwise(F.col("dst")).alias("dst")).distinct()
        kept, kept_path, _ = _written(moved.select("src", F.nullif("dst", "src").alias("dst")), "kept")
        # A node without a successor leads nowhere.
        leads = kept.select(F.col("src").alias("dst")).distinct()
        old = path
        live, path, seen = _written(kept.where("dst is null").unionByName(kept.join(leads, "dst", "left_semi").select("src", "dst")), "live")
        remove(spark, old), remove(spark, kept_path)
        if seen["rows"] > SHRINKS * size:
            break
    bad = live.where("dst is null").select(F.col("src").alias("node"))
    core = live.where("dst is not null")
    if seen["rows"]:
        seeds = cyclic_nodes(core).unionByName(bad).distinct().withColumn("_s", F.lit(True))
        marked = _ends(live.select("src", F.coalesce("dst", "src").alias("dst"))).join(seeds, "node", "left")
        labels = marked.select("node", F.struct(F.coalesce("_s", F.lit(False)).alias("s"), F.xxhash64("node").alias("h"), F.col("node").alias("id")).alias("best"))
        bad = _furthest(_turned(core), labels).where("best.s").select("node")
    for pointers, looped in reversed(found):
        hanging = pointers.join(bad.select(F.col("node").alias("root")).distinct(), "root", "left_semi").select("node")
        bad = materialise_at(bad.unionByName(looped).unionByName(pointers.where("root is null").select("node")).unionByName(hanging), "leading")[0]
    return bad.distinct()
