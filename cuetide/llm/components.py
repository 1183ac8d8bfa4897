"""Connected components of a graph given as an edge table, by alternating star contraction.

Each round joins every edge end to the smallest node around it (large star: to larger neighbours; small star: to
smaller ones), until each component is a star about its smallest node. Every step is a groupBy with partial
aggregation and an equi-join whose two sides are plain shuffles, so Spark can split the share of a hub and nothing that
grows with the edges is broadcast. Rounds are written to the shared folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuetide.llm.common import let_go, stored

#: Rounds are logarithmic in the longest path; a graph needing more than this is reported as an error.
MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (a, b), each once with a < b. Of each node u and its smallest neighbour-or-self m: links v to m, for its
    larger neighbours v (large star) or its smaller ones and itself (small star)."""
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    # w is an aggregate, not the grouping column: so this side gets a shuffle of its own, and Spark may split the other's hubs.
    least = near.groupBy("u").agg(F.max("u").alias("w"), F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
    if large:
        found = near.where("v > u").join(least.hint("merge"), F.col("u") == F.col("w")).select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        found = near.join(least.hint("merge"), F.col("u") == F.col("w")).select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b"))
    return found.where("a < b").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges: two columns of node ids (long), in any order, repeats and loops allowed. Returns (node, component) for every
    node of an edge between two different nodes; component is the smallest node reachable. No edges: no rows."""
    left, right = (F.col(c) for c in edges.columns[:2])
    now = stored(edges.where(left != right).select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).distinct(), name)
    state = _state(now)
    for _ in range(MOST_ROUNDS):
        if not state[0]:
            break
        then = stored(_star(_star(now, True), False), name)
        after = _state(then)
        let_go(now)
        now = then
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
