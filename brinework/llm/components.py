"""Problem 2: pairwise matches consolidated into groups.

Large-star / small-star rewriting (Kiveris et al., "Connected Components in
MapReduce and Beyond") as joins over an edge table ``(hi, lo)`` with hi > lo:

* large star: every hi of a node u is linked to the least neighbour of u;
* small star: every lo of a node u, and u, are linked to the least lo of u.

Rounds repeat until the edge table no longer changes; then it is a star per
component, centred on the least node.  A cluster of n members enters as n
edges to one hub node, never as pairs.

The rounds work on numbers, which Spark aggregates and joins without sorting
texts: a node's number is a 63-bit hash of its identifier, and identifiers
whose hashes are equal get numbers of their own.  At the end each component
takes the least identifier of its records.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoint import Workspace
from ..operators.skew import hot_split_join
from ..tables import load

#: Begins the identifiers of hubs, which no record has.
HUB = "\U0010ffff"


def links_of_clusters(members: DataFrame, cluster: str, record: str) -> DataFrame:
    """Edges record - hub of cluster. Rows with a null side give none."""
    hub = F.concat(F.lit(HUB), F.col(cluster).cast("string"))
    return members.select(hub.alias("hi"), F.col(record).cast("string").alias("lo")).dropna()


def links_of_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Edges of pairs in either order; a null side or a record with itself gives none."""
    x, y = F.col(a).cast("string"), F.col(b).cast("string")
    return pairs.select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo"), (x.isNotNull() & y.isNotNull()).alias("__whole")).filter("__whole and hi <> lo").drop("__whole")


def _hash(name: Column) -> Column:
    """An odd number; even ones are for identifiers whose hashes are equal."""
    return F.xxhash64(name).bitwiseOR(F.lit(1))


def numbered(spark: SparkSession, edges: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(hi, lo as numbers with hi > lo, distinct), (id, record_id of every record that isn't a hub). edges: hi, lo as texts.

    Two identifiers count as equal if 127 bits of hashes are.
    """
    plain = work.cut(edges.select("hi", "lo", _hash(F.col("hi")).alias("x"), _hash(F.col("lo")).alias("y")), "plain")
    ends = plain.select(F.col("hi").alias("name"), F.col("x").alias("id")).unionByName(plain.select(F.col("lo").alias("name"), F.col("y").alias("id")))
    second = F.xxhash64(F.lit(11), "name")
    clashes = ends.groupBy("id").agg(F.min(second).alias("p"), F.max(second).alias("q")).filter("p <> q").select("id")
    clashes = work.cut(clashes, "clashes")
    if not clashes.isEmpty():
        # Hardly any: of n identifiers about n * n / 2^64. They are numbered in order.
        own = ends.join(F.broadcast(clashes), "id", "left_semi").select("name").distinct()
        own = F.broadcast(work.cut(own.select("name", (2 * F.row_number().over(Window.orderBy("name"))).cast("long").alias("own")), "own"))
        plain = plain.join(own.withColumnsRenamed({"name": "hi", "own": "p"}), "hi", "left").join(own.withColumnsRenamed({"name": "lo", "own": "q"}), "lo", "left")
        plain = work.cut(plain.select("hi", "lo", F.coalesce("p", "x").alias("x"), F.coalesce("q", "y").alias("y")), "renumbered")
    names = plain.select(F.col("lo").alias("record_id"), F.col("y").alias("id")).unionByName(plain.filter(~F.col("hi").startswith(HUB)).select(F.col("hi").alias("record_id"), F.col("x").alias("id"))).distinct()
    return plain.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), names


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    below = edges.select(F.col("hi").alias("lo"), F.col("lo").alias("below"), F.lit(0).alias("one")).unionByName(edges.select("lo", F.lit(None).cast("long").alias("below"), F.lit(1).alias("one")))
    least = below.groupBy("lo").agg(F.min("below").alias("least"), F.sum("one").alias("weight")).filter("least is not null and weight > 0")
    return hot_split_join(edges, least, "lo", "least", "weight", total).select("hi", F.coalesce("least", "lo").alias("lo"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("least"), F.count(F.lit(1)).alias("weight"))
    joined = hot_split_join(edges, least, "hi", "least", "weight", total)
    # Of the least lo itself only the edge from u is left, of any other lo only its own.
    return joined.select(F.when(F.col("lo") == F.col("least"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("least").alias("lo"))


def _state(edges: DataFrame) -> tuple[int, int, int]:
    h = F.xxhash64("hi", "lo")
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftright(h, 24))).first()
    return row[0], int(row[1] or 0), int(row[2] or 0)


def star_components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(hi, lo): every node but the least of its component, with that least node. edges: numbers, hi > lo.

    Repeated edges are allowed.  An empty input gives an empty result.  Each
    round is written to the checkpoint folder and the one before it deleted;
    only a count and two checksums reach the driver.
    """
    work = Workspace(spark, "components")
    now = work.cut(edges.distinct(), "round0")
    state = _state(now)
    for k in range(1, max_rounds + 1):
        # Repeats that a large star leaves are few and go with those of the small star.
        large = work.cut(_large_star(now, state[0]), f"large{k}")
        then = work.cut(_small_star(large, state[0]).distinct(), f"round{k}")
        work.drop(f"round{k - 1}")
        work.drop(f"large{k}")
        now, before, state = then, state, _state(then)
        if state == before:
            return now
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def consolidate(spark: SparkSession, edges: list[DataFrame]) -> DataFrame:
    """record_id, group_id of all records in groups of two or more.

    group_id is the least record of the group by code points.  Records that
    only share a cluster with themselves, null identifiers and pairs of a
    record with itself give no rows; extra columns of the inputs are ignored.
    """
    work = Workspace(spark, "groups")
    linked, names = numbered(spark, reduce(DataFrame.unionByName, edges), work)
    stars = star_components(spark, linked)
    nodes = stars.select(F.col("hi").alias("id"), F.col("lo").alias("label")).unionByName(stars.select(F.col("lo").alias("id"), F.col("lo").alias("label")).distinct())
    records = work.cut(names.join(nodes, "id").select("record_id", "label"), "records")
    groups = records.groupBy("label").agg(F.min("record_id").alias("group_id"), F.count(F.lit(1)).alias("weight")).filter("weight > 1")
    return hot_split_join(records, groups, "label", "group_id", "weight", records.count()).filter("group_id is not null").select("record_id", "group_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate(
        spark,
        [
            links_of_clusters(load(spark, sf_dir, "nav_dup_members"), "cluster_id", "unit_id"),
            links_of_clusters(load(spark, sf_dir, "object_dup_members"), "cluster_id", "object_id"),
            links_of_pairs(load(spark, sf_dir, "match_pairs"), "id_a", "id_b"),
        ],
    )


#: The same by transitive closure, for small tables.
P2_ORACLE = """
WITH RECURSIVE e AS (
  SELECT '~' || cluster_id AS a, unit_id AS b FROM nav_dup_members WHERE cluster_id IS NOT NULL AND unit_id IS NOT NULL
  UNION SELECT '~' || cluster_id, object_id FROM object_dup_members WHERE cluster_id IS NOT NULL AND object_id IS NOT NULL
  UNION SELECT id_a, id_b FROM match_pairs WHERE id_a IS NOT NULL AND id_b IS NOT NULL AND id_a <> id_b),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS n, a AS m FROM s UNION SELECT s.a, r.m FROM r JOIN s ON s.b = r.n),
g AS (SELECT n AS record_id, min(m) FILTER (WHERE NOT starts_with(m, '~')) AS group_id, count(DISTINCT m) FILTER (WHERE NOT starts_with(m, '~')) AS size FROM r GROUP BY n)
SELECT record_id, group_id FROM g WHERE NOT starts_with(record_id, '~') AND size > 1
"""
