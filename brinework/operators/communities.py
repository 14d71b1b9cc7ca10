"""Communities of a weighted graph by modularity, without a task that holds the graph (K-12, K-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoint import Workspace
from .skew import hot_split_join

#: Weights are summed as whole numbers on this grid, so no order of addition changes a decision.
GRID = float(1 << 20)
#: Least gain of a move.
GAIN = 1e-10


def _best(links: DataFrame, placed: DataFrame, degrees: DataFrame, m2: float, gamma: float, total: int) -> DataFrame:
    """id, c, k, to: every node with its community, weighted degree and the community it would gain most in."""
    near = hot_split_join(links, placed.join(links.groupBy(F.col("v").alias("id")).agg(F.count(F.lit(1)).alias("n")), "id").select(F.col("id").alias("v"), "c", "n"), "v", "c", "n", total)
    pulled = near.filter("u <> v").groupBy(F.col("u").alias("id"), F.col("c").alias("to")).agg(F.sum("w").alias("l"))
    own = placed.select("id", F.col("c").alias("to"), F.lit(0).cast("long").alias("l"))
    offers = pulled.unionByName(own).groupBy("id", "to").agg(F.sum("l").alias("l"))
    sized = placed.join(degrees, "id")
    volumes = sized.groupBy(F.col("c").alias("to")).agg(F.sum("k").alias("volume"))
    asked = offers.join(volumes, "to").join(sized, "id")
    rest = F.col("volume") - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(F.lit(0))
    gain = F.col("l") - F.lit(gamma) * rest * F.col("k") / F.lit(m2)
    # A move needs more than GAIN over staying; of equal gains the lesser community.
    rated = asked.select("id", "c", "k", "to", (gain - F.when(F.col("to") == F.col("c"), 0.0).otherwise(GAIN * GRID)).alias("gain"))
    best = Window.partitionBy("id").orderBy(F.desc("gain"), "to")
    return rated.withColumn("r", F.row_number().over(best)).filter("r = 1").select("id", "c", "k", "to")


def louvain(spark: SparkSession, edges: DataFrame, gamma: float = 1.0, rounds: int = 12, levels: int = 8) -> DataFrame:
    """id, level, community: communities by local moving and contraction, level by level; community is its least member.

    edges: a, b (long), weight; undirected, repeated ones add up.  Every round
    all nodes look for the best community from one state of the graph and half
    of them - another half each round, by hash - may move there, which keeps
    neighbours from changing places forever.  ``rounds`` bounds the local
    moving of a level, as ``levels`` does the contractions; both usually end
    earlier, when nothing moves.  A node without edges has no row.
    """
    work = Workspace(spark, "louvain")
    weight = F.round(F.col("weight") * GRID).cast("long")
    one = edges.filter("a is not null and b is not null and weight > 0").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), weight.alias("w")).groupBy("u", "v").agg(F.sum("w").alias("w"))
    links = work.cut(one.unionByName(one.filter("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"), "w")), "links")
    members = work.cut(links.select(F.col("u").alias("id")).distinct().withColumn("node", F.col("id")), "members")
    found = None
    for level in range(1, levels + 1):
        # A loop of a contracted community counts for both its ends.
        degrees = work.cut(links.groupBy(F.col("u").alias("id")).agg(F.sum(F.when(F.col("u") == F.col("v"), 2 * F.col("w")).otherwise(F.col("w"))).alias("k")), f"degrees{level}")
        size = degrees.agg(F.sum("k").alias("m2"), F.count(F.lit(1)).alias("n")).first()
        if not size["n"]:
            break
        total = links.count()
        placed = work.cut(degrees.select("id", F.col("id").alias("c")), f"placed{level}_0")
        for k in range(1, rounds + 1):
            wish = work.cut(_best(links, placed, degrees, float(size["m2"]), gamma, total), f"wish{level}_{k}")
            if wish.filter("to <> c").isEmpty():
                break
            turn = F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(2)) == 0
            placed = work.cut(wish.select("id", F.when(turn, F.col("to")).otherwise(F.col("c")).alias("c")), f"placed{level}_{k}")
        least = placed.groupBy("c").agg(F.min("id").alias("to"), F.count(F.lit(1)).alias("n"))
        renamed = work.cut(hot_split_join(placed, least, "c", "to", "n", size["n"]).select(F.col("id").alias("node"), "to"), f"renamed{level}")
        below = members.join(renamed, "node").select("id", F.col("to").alias("node"))
        members = work.cut(below, f"members{level}")
        own = members.groupBy("node").agg(F.min("id").alias("community"), F.count(F.lit(1)).alias("n"))
        named = hot_split_join(members, own, "node", "community", "n", size["n"]).select("id", F.lit(level).alias("level"), "community")
        now = work.cut(named, f"level{level}")
        found = now if found is None else found.unionByName(now)
        fewer = renamed.select("to").distinct().count()
        if fewer == size["n"]:
            break
        # Contracted: edges between communities, and inside them as loops.
        x, y = renamed.select(F.col("node").alias("u"), F.col("to").alias("x")), renamed.select(F.col("node").alias("v"), F.col("to").alias("y"))
        merged = links.join(x, "u").join(y, "v").select(F.col("x").alias("u"), F.col("y").alias("v"), F.when((F.col("x") == F.col("y")) & (F.col("u") != F.col("v")), F.col("w") / 2).otherwise(F.col("w")).alias("w"))
        links = work.cut(merged.groupBy("u", "v").agg(F.round(F.sum("w")).cast("long").alias("w")), f"links{level}")
    return found if found is not None else members.select("id", F.lit(1).alias("level"), F.col("node").alias("community"))


def modularity(edges: DataFrame, communities: DataFrame, gamma: float = 1.0) -> DataFrame:
    """modularity of a partition (id, community) of edges (a, b, weight)."""
    c = communities.select(F.col("id").alias("a"), F.col("community").alias("ca")), communities.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    j = edges.join(c[0], "a").join(c[1], "b")
    ends = j.select(F.explode(F.array("ca", "cb")).alias("c"), "weight").groupBy("c").agg(F.sum("weight").alias("volume"))
    inside = j.agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("m"))
    return inside.crossJoin(ends.agg(F.sum(F.col("volume") * F.col("volume")).alias("squares"))).select((F.col("inside") / F.col("m") - F.lit(gamma) * F.col("squares") / (4 * F.col("m") * F.col("m"))).alias("modularity"))
