"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a partial aggregate (the smallest neighbour of a node) and a join; a hub's rows are split by
the adaptive skew join. Each round's edges are written to the shared folder, so a lost executor costs a
round at most; the last round's are deleted. The driver sees two sums a round, never edges or labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, leave, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: every larger neighbour of u is tied to u's smallest neighbour (u included).
    small: u and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    around = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else down
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    tied = around.join(least, "u")
    if large:
        tied = tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        tied = tied.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return tied.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long, not null). Returns node, component: every node that has an edge to another node,
    with the smallest node reachable from it. Loops and repeated edges are allowed; no edges give no rows."""
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = _state(now)
    while state[0]:
        new = materialize(_star(_star(now, True), False), "edges")
        new_state = _state(new)
        discard(now)
        now, done, state = new, new_state == state, new_state
        if done:
            break
    leave(now)
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component")).groupBy("node").agg(F.min("component").alias("component"))
