"""Connected components by alternating large and small stars, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subspark.llm.common import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: every neighbour above a node is linked to the smallest node around it.
    Small star: every neighbour below a node, and the node itself, is linked to the smallest."""
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = around.join(least, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return out.filter(F.col("a") != F.col("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: (a long, b long), without nulls. Gives (node, root): root is the smallest node of node's component."""
    now = stored(edges.filter(F.col("a") != F.col("b")).select("a", "b"), "links")
    before, state = None, _state(now)
    while state != before and state[0]:
        now = stored(_stars(_stars(now, True), False), "links")
        before, state = state, _state(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
