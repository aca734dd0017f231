"""Connected components of a graph held in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstream.llm.common import frozen


def _mins(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """``u``, ``root`` for every node of undirected edges (u, v) that is not the
    smallest of its component; nodes that are missing are their own root.

    Alternates the large-star and small-star steps until nothing changes. A
    node's neighbours are only aggregated (before the shuffle too), never
    gathered, and each step is stored, so the lineage stays short. Loops and
    repeated edges do no harm; null ends are left out.
    """
    pair = lambda a, b: (F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = frozen(edges.where(F.col("u") != F.col("v")).select(*pair(F.col("u"), F.col("v"))).distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_mins(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = frozen(large.distinct(), "large-star")  # u > v in every row
        small = large.join(_mins(large), "u")
        linked = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))))
        now = frozen(small.select(linked.alias("e")).select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct(), "small-star")
        before, state = state, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select("u", F.col("v").alias("root"))
