"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clicktide.session import Written


def _least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least neighbour of u, u itself included, as `m`."""
    m = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(m.withColumnRenamed("u", "_u"), F.col("u") == F.col("_u")).select(
        "u", "v", F.least("u", "m").alias("m")
    )


def components(edges: DataFrame) -> DataFrame:
    """`(node, component)` for every node of `edges` (a, b longs): the least node it can reach.

    Alternates the large-star and the small-star step until every node hangs on its component's
    least node. Neighbour minima are combined before they are shuffled and a hub's edges meet its
    minimum in a join, which AQE can split. Each round is written, and that of the round before dropped.

    Edges may repeat and may be loops; a null end is ignored. No edge gives no row.
    """
    named = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    loops = named.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    held = Written(
        named.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    state, current = None, held.rows
    while True:
        row = current.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if state == (row.n, row.h):
            break
        state = (row.n, row.h)
        both = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = _least(large.distinct())
        small = least.select(
            F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")
        ).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        after = Written(small.filter("u <> v").distinct())
        held.drop()
        held, current = after, after.rows
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component"))
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionAll(roots).unionAll(loops).groupBy("node").agg(
        F.min("component").alias("component")
    )
