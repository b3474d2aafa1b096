"""Connected components by alternating large-star and small-star steps.

Each step is an aggregation (with map-side partial minima) and an equi-join, so a
node with very many edges costs one skewed join, which adaptive execution splits,
and never a collected neighbour list. The number of rounds grows with the logarithm
of the largest component, not with its diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.shared import Written, numbered, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node with an edge to another node.

    ``edges`` has the columns ``u`` and ``v`` of one orderable type. The component is
    the least node of the class. Null ends, self-loops and repeated edges are ignored;
    nodes without other edges are absent, so callers take the node itself for them.
    """
    now = Written(
        edges.select("u", "v").where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    mark = None
    for _ in range(max_rounds):
        seen = now.df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen["n"] == 0 or (seen["n"], seen["h"]) == mark:
            return now.df.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        mark = (seen["n"], seen["h"])
        following = Written(_small_star(_large_star(now.df)).distinct(), "edges")
        now.drop()
        now = following
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def breadth_first(edges: DataFrame, max_levels: int = 1000) -> DataFrame:
    """``(component, pos, node, level, parent)``: each component's nodes breadth first from its least node.

    Neighbours follow in ascending order, so a node's parent is the first in order that has an edge
    to it. Levels advance in all components at once, each by one equi-join with the frontier; a
    frontier is numbered by a sort by range, never in one task. The number of rounds is the depth of
    the deepest component, of ``max_levels`` at most. Null ends, self-loops and repeated edges are
    ignored.
    """
    one = edges.select("u", "v").where("u is not null and v is not null and u <> v")
    both = written(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "neighbours")
    label = written(connected_components(one), "labels")
    kind = both.schema["u"].dataType
    roots = label.where("node = component").select("component", "node", F.lit(0).alias("level"), F.lit(None).cast(kind).alias("parent"))
    seen = front = written(numbered(roots, "component", name="nth"), "front")
    for level in range(1, max_levels + 1):
        met = both.join(front.select("component", F.col("node").alias("u"), "nth"), "u").groupBy("component", F.col("v").alias("node")).agg(F.min(F.struct("nth", "u")).alias("by"))
        fresh = met.join(seen.select("node"), "node", "left_anti").select("component", "node", F.lit(level).alias("level"), F.col("by.u").alias("parent"), F.col("by.nth").alias("before"))
        front = written(numbered(fresh, "component", "before", "node", name="nth").drop("before"), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    else:
        raise RuntimeError(f"a component is deeper than {max_levels} levels")
    ordered = numbered(written(seen, "seen"), "component", "level", "nth", name="at")
    first = ordered.groupBy("component").agg(F.min("at").alias("first"))
    return ordered.join(first, "component").select("component", (F.col("at") - F.col("first")).alias("pos"), "node", "level", "parent")
