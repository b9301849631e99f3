"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.storage import materialise

BITS = 16
K = 10


def sign_code(vector: Column, dims: int, bits: int = BITS) -> Column:
    """The signs of a vector as segments of ``bits`` bits; a component over 0 (NaN too) gives 1."""
    segment = lambda at: F.aggregate(
        F.sequence(F.lit(at), F.lit(min(at + bits, dims) - 1)),
        F.lit(0),
        lambda acc, i: acc + F.when(F.get(vector, i) > 0, F.pow(F.lit(2), i - at).cast("int")).otherwise(0),
    )
    return F.array(*[segment(at) for at in range(0, dims, bits)])


def _distance(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")


def top_k(vectors: DataFrame, queries: DataFrame, dims: int, k: int = K, bits: int = BITS) -> DataFrame:
    """``(query_id, rank, vec_id, distance)``: the ``k`` nearest codes of each query, itself left out.

    ``vectors`` and ``queries`` are ``(vec_id, embedding)``. Ties in distance go to the smaller id.
    Rows with a null id, a null vector or another number of dimensions have no code and are skipped;
    repeated rows count once, and an id with several codes is an entry under each. A null component gives
    the bit 0. Other columns are ignored; an empty table gives an empty result.

    Codes are cut into m segments. Step r looks up, in each segment's index, the values r bits away
    from the query's. A code not met up to step r is over r bits away in every segment, so its
    distance is at least m * (r + 1); a query ends once its k-th verified distance is below that. Only
    unfinished queries go on; one count a step reaches the driver. Equal codes are one entry with
    their k smallest ids, which is all that a top-k can need, so frequent codes cost one row each.
    """
    m = -(-dims // bits)
    whole = lambda df: df.where("vec_id is not null and embedding is not null").where(F.size("embedding") == dims)
    coded = materialise(whole(vectors).select("vec_id", sign_code(F.col("embedding"), dims, bits).alias("code")).distinct(), "codes")
    by_id = Window.partitionBy("code").orderBy("vec_id")
    # k + 1, as a query may be one of them; the group limit runs before the shuffle.
    members = materialise(coded.withColumn("_r", F.row_number().over(by_id)).where(F.col("_r") <= k + 1).select("code", "vec_id"), "members")
    index = materialise(
        members.groupBy("code").agg(F.count("*").alias("n")).select("code", "n", F.posexplode("code").alias("seg", "value")), "index"
    )
    asked = materialise(
        whole(queries).select(F.col("vec_id").alias("query_id"), sign_code(F.col("embedding"), dims, bits).alias("q")).distinct(), "queries"
    )
    open_, done = asked, None
    found: DataFrame | None = None
    for r in range(bits + 1):
        flips = [sum(1 << b for b in c) for c in itertools.combinations(range(bits), r)]
        probes = open_.select("query_id", "q", F.posexplode("q").alias("seg", "own")).select(
            "query_id", "q", "seg", F.explode(F.transform(F.lit(flips), lambda x: x.bitwiseXOR(F.col("own")))).alias("value")
        )
        # Each step has many times more probes than queries, which size estimates do not see.
        met = probes.hint("merge").join(index, ["seg", "value"]).select("query_id", "code", "n", _distance("q", "code").alias("distance")).distinct()
        whole = met if found is None else found.join(open_.select("query_id"), "query_id", "left_semi").unionByName(met).distinct()
        met = materialise(whole, "met")
        # Ids at each distance of a query: at most 65 rows of it are summed up, however many codes it met.
        at = met.groupBy("query_id", "distance").agg(F.sum("n").alias("ids"))
        before = F.coalesce(F.sum("ids").over(Window.partitionBy("query_id").orderBy("distance").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        near = materialise(at.withColumn("_before", before).where(F.col("_before") <= k).drop("_before"), "distances")
        # Of the codes met, those beyond the k + 1 nearest ids cannot be in the answer.
        found = met.join(near.select("query_id", "distance"), ["query_id", "distance"], "left_semi").select(*met.columns)
        # Counting the query itself, k + 1 verified ids below the bound prove that k others are.
        proved = near.where(F.col("distance") < m * (r + 1)).groupBy("query_id").agg(F.sum("ids").alias("ids")).where(F.col("ids") >= k + 1).select("query_id")
        ready = found.join(proved, "query_id", "left_semi") if r < bits else found
        done = ready if done is None else done.unionByName(ready)
        if r == bits:
            break
        open_ = materialise(open_.join(proved, "query_id", "left_anti"), "open")
        if open_.isEmpty():
            break
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return (
        done.join(members, "code")
        .where("query_id <> vec_id")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("distance").cast("int").alias("distance"))
    )
