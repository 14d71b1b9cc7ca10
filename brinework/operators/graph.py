"""Path and neighbourhood queries over an edge table (GR-family)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoint import Workspace


def undirected(edges: DataFrame) -> DataFrame:
    """src, dst, kind, strength both ways."""
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind", "strength"))


def neighbourhood(edges: DataFrame, start: DataFrame, per_kind: int) -> DataFrame:
    """start, kind, dst, strength: the strongest neighbours of each kind (GR-05)."""
    hop = start.select(F.col("id").alias("src")).join(undirected(edges), "src").groupBy("src", "kind", "dst").agg(F.max("strength").alias("strength"))
    w = Window.partitionBy("src", "kind").orderBy(F.desc("strength"), "dst")
    return hop.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_kind).select(F.col("src").alias("start"), "kind", "dst", "strength")


def distances(spark: SparkSession, edges: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """start, id, steps (least) up to ``most`` (GR-03): breadth first, only new nodes go on."""
    work = Workspace(spark, "distances")
    links = work.cut(undirected(edges).select("src", "dst").distinct(), "links")
    known = frontier = work.cut(start.select(F.col("id").alias("start"), "id", F.lit(0).cast("long").alias("steps")), "step0")
    for k in range(1, most + 1):
        hop = frontier.select("start", F.col("id").alias("src")).join(links, "src").select("start", F.col("dst").alias("id")).distinct()
        frontier = work.cut(hop.join(known.select("start", "id"), ["start", "id"], "left_anti").withColumn("steps", F.lit(k).cast("long")), f"new{k}")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def strongest_paths(spark: SparkSession, edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """start, id, strength: greatest product of hop strengths over walks of at most ``hops`` (GR-04).

    After each hop only the best walk per (start, node) is kept, so walks never multiply.
    """
    work = Workspace(spark, "strongest")
    links = work.cut(undirected(edges).groupBy("src", "dst").agg(F.max("strength").alias("s")), "links")
    best = work.cut(start.select(F.col("id").alias("start"), "id", F.lit(1.0).alias("strength")), "hop0")
    for k in range(1, hops + 1):
        hop = best.select("start", F.col("id").alias("src"), "strength").join(links, "src").select("start", F.col("dst").alias("id"), (F.col("strength") * F.col("s")).alias("strength"))
        best = work.cut(best.unionByName(hop).groupBy("start", "id").agg(F.max("strength").alias("strength")), f"hop{k}")
    return best.filter("start <> id")
