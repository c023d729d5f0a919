"""Connected components of an edge table by alternating large-star and small-star steps.

Both steps are a map-side combined minimum per vertex and a join back, so a vertex that touches a
third of all edges is one aggregated row, and the planner may split its edges in the join. Each
round is written to shared storage; only the number of vertices that are not yet settled comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.tables import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return (down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())


def _settled(edges: DataFrame) -> bool:
    """Whether the edges, each from the greater vertex u to the lesser v, are stars: no vertex points twice, or points and is pointed at."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    unsettled = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out + into > 1")
    return unsettled.agg(F.count(F.lit(1))).first()[0] == 0


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(v, component): every vertex of ``edges`` (columns u, v of one orderable type) that is not the
    least of its component, with that least vertex. ``edges`` is read more than once: pass a written table."""
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    while not _settled(now):
        now = written(_small_star(_large_star(now)), name)
    return now.select(F.col("u").alias("v"), F.col("v").alias("component"))
