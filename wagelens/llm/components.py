"""Connected components by alternating large-star and small-star.

Every round is two groupings and joins by node. No node's neighbours are ever gathered: a
node sends its smallest neighbour, so a hub of any degree is a minimum and a join that
adaptive execution splits. Each round is written to the shared staging folder, which cuts the
lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from wagelens.session import staged

MOST_ROUNDS = 60


def _lowest(arcs: DataFrame) -> DataFrame:
    # Written, so that both sides of the joins below are plain shuffles: adaptive execution
    # splits a hub's rows only then.
    return staged(arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lowest")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the smallest of the node and its neighbours."""
    arcs = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        arcs.where("v > u").join(_lowest(arcs), "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the smallest of them; edges run downwards."""
    lowest = _lowest(edges)
    moved = edges.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(lowest.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _state(edges: DataFrame) -> Row:
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return edges.agg(F.count(F.lit(1)).alias("n"), total.alias("sum")).first()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges (u, v)``: the smallest node reachable.

    Loops and null ends link nothing; an edge may repeat and run either way.
    """
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    kept = staged(down.where("u != v").distinct(), "edges")
    before = _state(kept)
    if not before.n:
        return kept.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(MOST_ROUNDS):
        kept = staged(_small_star(_large_star(kept)), "edges")
        state = _state(kept)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = kept.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return kept.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
