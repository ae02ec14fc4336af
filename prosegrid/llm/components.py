"""Connected components by alternating large-star and small-star rounds.

Every round is two grouped minima and two equi-joins over the edge table, so
no task ever holds a component.  The rounds stop when the edge table, which is
then one star per component, no longer changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegrid.llm.scratch import Scratch


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"),
    ).first()
    return row["n"], row["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.where("v > u")
        .join(low, "u")
        .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges(a, b)`` -> ``(node, root)``; root is the smallest node reachable.

    Self-links, repeated links and links with a null end are ignored; a node
    that has no other link is not in the result.
    """
    now = scratch.store(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = _signature(now)
    while seen[0]:
        star = scratch.store(_small_star(_large_star(now)))
        scratch.drop(now)
        now, was = star, seen
        seen = _signature(now)
        if seen == was:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
