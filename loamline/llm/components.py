"""Connected components of a link table, by alternating large-star and small-star steps.

A node's links are never gathered: each step is a minimum per node (combined
before the exchange) joined back to the links. The minima are written first, so
that both sides of that join are plain exchanges, of which adaptive execution can
split a hot node's. Every round is written to the shared folder, so lineage stays
short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import dropped, stored


def _large_star(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every neighbour above a node goes to the least around it; and the minima, to be dropped once that is written."""
    both = e.select(F.col("u").alias("a"), F.col("v").alias("b")).union(e.select("v", "u"))
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct(), least


def _small_star(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every neighbour below a node, and the node itself, go to the least of them; and the minima."""
    least = stored(e.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct(), least


def components(links: DataFrame) -> DataFrame:
    """(id, root) for each node of links (u, v), root being its component's least id. Links may repeat and point either way; loops count as nothing."""

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    e = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = mark(e)
    while seen[0]:
        before = seen
        for star in (_large_star, _small_star):
            after, least = star(e)
            after = stored(after, "links")
            dropped(e)
            dropped(least)
            e = after
        seen = mark(e)
        if seen == before:
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
