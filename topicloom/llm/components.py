"""Connected components by contraction: every vertex moves to its least neighbour, the edges are renamed,
and what is left is contracted again. Each round at least halves the vertices of every open component, so
the rounds grow with the logarithm of its size. Each round is cut at written tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """v and top (the vertex that stands for its component) for every vertex of the edges u, v.

    Hubs: the least neighbour is a partial aggregate, and renaming joins are plain shuffled joins of two
    written tables, whose large partitions Spark splits at run time. No edges give no rows.
    """
    spark = edges.sparkSession
    named: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = cut(both.groupBy(F.col("u").alias("v0")).agg(F.least(F.min("v"), F.col("v0")).alias("up0")))
        up = cut(up.join(up.select(F.col("v0").alias("v1"), F.col("up0").alias("up1")), F.col("up0") == F.col("v1")).select("v0", F.col("up1").alias("up0")))
        if named is None:
            named = up.select(F.col("v0").alias("v"), F.col("up0").alias("top"))
        else:
            named = cut(named.join(up, F.col("top") == F.col("v0"), "left").select("v", F.coalesce("up0", "top").alias("top")))
        left = edges.join(up, F.col("u") == F.col("v0")).select(F.col("up0").alias("u"), "v")
        moved = left.join(up, F.col("v") == F.col("v0")).select(F.least("u", "up0").alias("u"), F.greatest("u", "up0").alias("v"))
        edges = cut(moved.where("u <> v").distinct())
    if named is None:
        return spark.createDataFrame([], "v long, top long")
    return named
