"""Connected components over DataFrames: alternating large-star and small-star rounds (Kiveris et al., 2014).

Each round moves every edge to a smaller neighbour; no group is ever collected, the edge count never
grows, and every round is written to the shared checkpoint folder and removed after the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch

#: A node with more edges than LIGHT and than a MOST-th of all is looked up by a broadcast instead of a
#: shuffle. However large the graph, there are fewer than MOST such nodes.
LIGHT, MOST = 256, 8192


def with_least(e: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """``e`` (u, v), of at most n rows and without nulls, with m, the least v of each u.

    The answers of nodes with many edges are broadcast (fewer than MOST rows) and their edges stay
    where they are, so no node's edges meet in one task.
    """
    low = scratch.write(e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("d")))
    limit = max(LIGHT, n // MOST)
    heavy = low.where(F.col("d") > limit).select("u", F.col("m").alias("hm"))
    met = e.join(F.broadcast(heavy), "u", "left")
    light = met.where("hm is null").select("u", "v").join(low.where(F.col("d") <= limit).select("u", "m"), "u")
    return met.where("hm is not null").select("u", "v", F.col("hm").alias("m")).unionByName(light)


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v: long) -> (node, component), component the smallest node reachable; only nodes with an edge to another node.

    Nulls and loops are ignored, repeated edges count once; no edges give no rows.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    scratch = Scratch(edges.sparkSession)
    e = scratch.write(e.distinct())
    seen = _digest(e)
    while True:
        done = [scratch.folder()]
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, 2 * seen[0], scratch).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        done.append(scratch.folder())
        large = scratch.write(large)
        done.append(scratch.folder())
        least = with_least(large, seen[0], scratch)
        done.append(scratch.folder())
        small = (
            least.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        e = scratch.write(small)
        scratch.remove(*done)
        now = _digest(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _digest(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
