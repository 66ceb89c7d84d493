"""Connected components of an edge table by alternating large and small stars.

Each round rewires every edge to the smallest neighbour of its ends until all components are
stars around their smallest node; rounds grow with the logarithm of a component's size. All work
is aggregations and joins on the edge table, which each round writes to the shared folder. A hub
with many edges is one row on one side of its join, so the other side can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.session import persist_table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v"))


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: long, not null) that is not the smallest
    of its component; ``component`` is the smallest node. Loops and repeated edges do not matter."""
    def stored(e: DataFrame) -> tuple[DataFrame, tuple]:
        e = persist_table(spark, e.filter("u <> v").distinct(), "edges")
        return e, tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now, mark = stored(edges.select("u", "v"))
    while mark[0]:
        following, next_mark = stored(_small_star(_large_star(now)))
        if next_mark == mark:
            break
        now, mark = following, next_mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
