"""Graph projections and queries over the star schema and the duplicate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import round6
from ..operators import graph
from .catalog import Catalog, Tables

catalog = Catalog()
query = catalog.query
QUERIES, ORACLES = catalog.queries, catalog.oracles

_EDGES = """e AS (SELECT 'N' || n_nationkey AS src, 'R' || n_regionkey AS dst, 'IN_REGION' AS kind, 0.8::DOUBLE AS strength FROM nation
UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'IN_NATION', 0.6::DOUBLE FROM supplier UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'IN_NATION', 0.5::DOUBLE FROM customer),
u AS (SELECT * FROM e UNION ALL SELECT dst, src, kind, strength FROM e)"""


def _key(letter: str, c: str):
    return F.concat(F.lit(letter), F.col(c).cast("string"))


def _edges(t: Tables) -> DataFrame:
    """GR-01: relationship rows of three kinds."""
    e = t.nation.select(_key("N", "n_nationkey").alias("src"), _key("R", "n_regionkey").alias("dst"), F.lit("IN_REGION").alias("kind"), F.lit(0.8).alias("strength"))
    e = e.unionByName(t.supplier.select(_key("S", "s_suppkey").alias("src"), _key("N", "s_nationkey").alias("dst"), F.lit("IN_NATION").alias("kind"), F.lit(0.6).alias("strength")))
    return e.unionByName(t.customer.select(_key("C", "c_custkey").alias("src"), _key("N", "c_nationkey").alias("dst"), F.lit("IN_NATION").alias("kind"), F.lit(0.5).alias("strength")))


@query(f"WITH {_EDGES}, n AS (SELECT src AS id FROM u GROUP BY 1) SELECT kind, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets, (SELECT count(*) FROM n) AS nodes FROM e GROUP BY 1")
def graph_accounting(t: Tables) -> DataFrame:
    """GR-01, GR-02."""
    e = _edges(t)
    nodes = graph.undirected(e).select("src").distinct().agg(F.count(F.lit(1)).alias("nodes"))
    return e.groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets")).crossJoin(F.broadcast(nodes))


@query(f"WITH {_EDGES}, h AS (SELECT src, kind, dst, max(strength) AS strength FROM u WHERE src[1] = 'N' GROUP BY ALL) SELECT src AS start, kind, dst, strength FROM h QUALIFY row_number() OVER (PARTITION BY src, kind ORDER BY strength DESC, dst) <= 4")
def graph_neighbourhood(t: Tables) -> DataFrame:
    """GR-05."""
    return graph.neighbourhood(_edges(t), t.nation.select(_key("N", "n_nationkey").alias("id")), 4)


@query(f"""WITH RECURSIVE {_EDGES}, w AS (SELECT 'R' || r_regionkey AS start, 'R' || r_regionkey AS id, 0 AS steps FROM region UNION SELECT w.start, u.dst, steps + 1 FROM w JOIN u ON u.src = w.id WHERE steps < 4)
SELECT start, id, min(steps)::BIGINT AS steps FROM w GROUP BY ALL""")
def shortest_path_len(t: Tables) -> DataFrame:
    """GR-03: from every region, up to four steps."""
    return graph.distances(t.spark, _edges(t), t.region.select(_key("R", "r_regionkey").alias("id")), 4)


@query(f"""WITH RECURSIVE {_EDGES}, l AS (SELECT src, dst, max(strength) AS s FROM u GROUP BY ALL), w AS (SELECT 'N' || n_nationkey AS start, 'N' || n_nationkey AS id, 1.0::DOUBLE AS strength, 0 AS k FROM nation UNION SELECT start, dst, strength * s, k + 1 FROM w JOIN l ON l.src = w.id WHERE k < 2)
SELECT start, id, floor(max(strength) * 1e6 + 0.5) / 1e6 AS strength FROM w WHERE start <> id GROUP BY ALL""")
def path_strength(t: Tables) -> DataFrame:
    """GR-04: products of hop strengths over two hops."""
    best = graph.strongest_paths(t.spark, _edges(t), t.nation.select(_key("N", "n_nationkey").alias("id")), 2)
    return best.withColumn("strength", round6(F.col("strength")))


@query("""
WITH c AS (SELECT id_a AS x, id_b AS y FROM match_pairs WHERE id_a <> id_b) SELECT id, count(*) FILTER (WHERE d = 'OUT') AS out_links, count(*) FILTER (WHERE d = 'IN') AS in_links FROM (SELECT x AS id, 'OUT' AS d FROM c UNION ALL SELECT y, 'IN' FROM c) GROUP BY 1""")
def link_degrees(t: Tables) -> DataFrame:
    """GR-06: links out of and into each record, in one aggregation."""
    c = t.match_pairs.filter("id_a <> id_b")
    both = c.select(F.col("id_a").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(c.select("id_b", F.lit(0), F.lit(1)))
    return both.groupBy("id").agg(F.sum("o").alias("out_links"), F.sum("i").alias("in_links"))


@query("""
WITH m AS (SELECT DISTINCT cluster_id, source_id FROM object_dup_members WHERE source_id IS NOT NULL), k AS (SELECT source_id FROM sources)
SELECT source_id, count(*) AS clusters, (source_id IN (SELECT source_id FROM k)) AS registered FROM m GROUP BY 1 ORDER BY 1""")
def orphan_endpoints(t: Tables) -> DataFrame:
    """GR-07, J-25: relationships whose end isn't registered."""
    m = t.object_dup_members.filter("source_id is not null").select("cluster_id", "source_id").distinct().groupBy("source_id").agg(F.count(F.lit(1)).alias("clusters"))
    k = t.sources.select("source_id").distinct().withColumn("known", F.lit(True))
    return m.join(k, "source_id", "left").select("source_id", "clusters", F.coalesce("known", F.lit(False)).alias("registered"))


@query("""
WITH a AS (SELECT unit_id, cluster_id, similarity, row_number() OVER (PARTITION BY unit_id ORDER BY similarity DESC, cluster_id) AS ru, row_number() OVER (PARTITION BY cluster_id ORDER BY similarity DESC, unit_id) AS rc FROM (SELECT DISTINCT unit_id, cluster_id, similarity FROM nav_dup_members WHERE NOT isnan(similarity)))
SELECT unit_id, cluster_id, ru, rc FROM a WHERE ru <= 1 OR rc <= 1""")
def mentions_projection(t: Tables) -> DataFrame:
    """GR-01: a pair stays if either side has it in front."""
    a = t.nav_dup_members.filter("not isnan(similarity)").select("unit_id", "cluster_id", "similarity").distinct()
    ru = F.row_number().over(Window.partitionBy("unit_id").orderBy(F.desc("similarity"), "cluster_id"))
    rc = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("similarity"), "unit_id"))
    return a.select("unit_id", "cluster_id", ru.cast("long").alias("ru"), rc.cast("long").alias("rc")).filter("ru <= 1 or rc <= 1")
