"""Comparison of rankings: agreement, resampling, corrections, pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import dyadic, from_dyadic, round6
from ..tables import current
from .catalog import Catalog, Tables
from .vectors import _DENSE, _SHORT, _dense, _short

catalog = Catalog()
query = catalog.query
QUERIES, ORACLES = catalog.queries, catalog.oracles


def _both(t: Tables, k: int) -> DataFrame:
    """Documents that both rankings have among their first k, ranked anew within these."""
    j = _dense(t, k).select("qid", "doc", F.col("rank").alias("ra")).join(_short(t, k).select("qid", "doc", F.col("rank").alias("rb")), ["qid", "doc"])
    again = lambda c: F.row_number().over(Window.partitionBy("qid").orderBy(c))
    return j.select("qid", "doc", again("ra").alias("a"), again("rb").alias("b"))


_BOTH = f"""{_DENSE}, {_SHORT}, j AS (SELECT dense.qid, dense.doc, row_number() OVER (PARTITION BY dense.qid ORDER BY dense.rank) AS a, row_number() OVER (PARTITION BY dense.qid ORDER BY short.rank) AS b
 FROM dense JOIN short ON dense.qid = short.qid AND dense.doc = short.doc WHERE dense.rank <= 50 AND short.rank <= 50)"""


@query(f"WITH {_BOTH} SELECT qid, count(*) AS n, floor((1 - 6.0 * sum((a - b) * (a - b)) / (count(*) * (count(*) * count(*) - 1))) * 1e6 + 0.5) / 1e6 AS spearman FROM j GROUP BY 1 HAVING count(*) > 1")
def spearman(t: Tables) -> DataFrame:
    """R-22: rank correlation of two rankings over the documents both have."""
    n = F.count(F.lit(1))
    s = _both(t, 50).groupBy("qid").agg(n.alias("n"), F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("d")).filter("n > 1")
    return s.select("qid", "n", round6(1 - 6.0 * F.col("d") / (F.col("n") * (F.col("n") * F.col("n") - 1))).alias("spearman"))


@query(f"""WITH {_BOTH} SELECT x.qid, count(*) AS pairs, floor((count(*) FILTER (WHERE (x.a < y.a) = (x.b < y.b)) - count(*) FILTER (WHERE (x.a < y.a) <> (x.b < y.b))) / count(*) * 1e6 + 0.5) / 1e6 AS tau FROM j x JOIN j y ON x.qid = y.qid AND x.doc < y.doc GROUP BY 1""")
def kendall(t: Tables) -> DataFrame:
    """R-22: concordant less discordant pairs; a query has at most 50 documents, so its pairs are few."""
    j = _both(t, 50).groupBy("qid").agg(F.collect_list(F.struct("a", "b")).alias("l"))
    x = j.select("qid", F.col("l").alias("others"), F.explode("l").alias("x")).select("qid", "x", F.explode("others").alias("y")).filter("x.a < y.a")
    return x.groupBy("qid").agg(F.count(F.lit(1)).alias("pairs"), round6((F.count_if(F.col("x.b") < F.col("y.b")) - F.count_if(F.col("x.b") > F.col("y.b"))) / F.count(F.lit(1))).alias("tau"))


_HITS = f"""{_DENSE}, {_SHORT}, own AS (SELECT vec_id AS qid, label AS mine FROM embeddings), h AS (SELECT dense.qid, count(*) FILTER (WHERE label = mine) AS a FROM dense JOIN d USING (doc) JOIN own ON own.qid = dense.qid WHERE rank <= 10 GROUP BY 1),
k AS (SELECT short.qid, count(*) FILTER (WHERE label = mine) AS b FROM short JOIN d USING (doc) JOIN own ON own.qid = short.qid WHERE rank <= 10 GROUP BY 1), x AS (SELECT qid, a - b AS diff FROM h JOIN k USING (qid))"""


def _differences(t: Tables) -> DataFrame:
    """qid, diff: hits of the same label among the first ten, of the whole vectors less those of their beginnings."""
    label = t.embeddings.select("vec_id", "label")

    def hits(ranking: DataFrame, name: str) -> DataFrame:
        j = ranking.join(label.select(F.col("vec_id").alias("doc"), "label"), "doc").join(label.select(F.col("vec_id").alias("qid"), F.col("label").alias("own")), "qid")
        return j.groupBy("qid").agg(F.count_if(F.col("label") == F.col("own")).alias(name))

    return hits(_dense(t, 10), "a").join(hits(_short(t, 10), "b"), "qid").select("qid", (F.col("a") - F.col("b")).alias("diff"))


@query(f"""WITH {_HITS}, o AS (SELECT diff, row_number() OVER (ORDER BY qid) - 1 AS i, count(*) OVER () AS n FROM x),
sm AS (SELECT r.k, sum(o.diff) / any_value(z.n) AS mean FROM range(200) r(k), (SELECT i AS draw, n FROM o) z JOIN o ON o.i = ('0x' || md5((r.k * 1000003 + z.draw)::VARCHAR)[1:7])::BIGINT % z.n GROUP BY 1)
SELECT floor(quantile_cont(mean, 0.025) * 1e6 + 0.5) / 1e6 AS low, floor(quantile_cont(mean, 0.975) * 1e6 + 0.5) / 1e6 AS high FROM sm""")
def bootstrap_interval(t: Tables) -> DataFrame:
    """R-21: 200 resamples of the queries by hashed draws; the middle 95 % of their means. The queries are a stated set."""
    x = _differences(t)
    o = x.select("diff", (F.row_number().over(Window.orderBy("qid")) - 1).cast("long").alias("i"))
    n = x.agg(F.count(F.lit(1)).alias("n"))
    draws = o.select(F.col("i").alias("draw")).crossJoin(F.broadcast(n)).select("n", "draw", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("k"))
    picked = F.conv(F.substring(F.md5((F.col("k") * F.lit(1000003) + F.col("draw")).cast("string")), 1, 7), 16, 10).cast("long") % F.col("n")
    means = draws.withColumn("i", picked).join(o, "i").groupBy("k", "n").agg(F.sum("diff").alias("s")).select((F.col("s") / F.col("n")).alias("mean"))
    return means.agg(round6(F.percentile("mean", 0.025)).alias("low"), round6(F.percentile("mean", 0.975)).alias("high"))


@query("""
WITH g AS (SELECT event_type, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS a, count(*) AS n FROM events GROUP BY 1), p AS (SELECT event_type, least(1.0, 2.0 / (1 + abs(a - n / 2.0) / sqrt(n / 4.0))) AS p FROM g),
r AS (SELECT event_type, p, row_number() OVER (ORDER BY p, event_type) AS i, count(*) OVER () AS m FROM p) SELECT event_type, floor(p * 1e6 + 0.5) / 1e6 AS p, floor(max(least(1.0, (m - i + 1) * p)) OVER (ORDER BY i) * 1e6 + 0.5) / 1e6 AS adjusted FROM r""")
def holm(t: Tables) -> DataFrame:
    """R-21: Holm's correction over a family of tests (one per type): the running greatest of (m - i + 1) p."""
    g = t.events.groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("a"), F.count(F.lit(1)).alias("n"))
    p = g.select("event_type", F.least(F.lit(1.0), 2.0 / (1 + F.abs(F.col("a") - F.col("n") / 2.0) / F.sqrt(F.col("n") / 4.0))).alias("p"))
    # The family is as small as the number of types.
    order = Window.orderBy("p", "event_type")
    r = p.withColumn("i", F.row_number().over(order)).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy()))
    return r.select("event_type", round6(F.col("p")).alias("p"), round6(F.max(F.least(F.lit(1.0), (F.col("m") - F.col("i") + 1) * F.col("p"))).over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))).alias("adjusted"))


@query(f"""WITH {_DENSE}, {_SHORT}, p AS (SELECT qid, doc, 'dense' AS system, rank FROM dense WHERE rank <= 10 UNION ALL SELECT qid, doc, 'short', rank FROM short WHERE rank <= 10)
SELECT qid, doc, min(rank) AS best_rank, string_agg(system, ',' ORDER BY system) AS systems FROM p GROUP BY qid, doc""")
def judgement_pool(t: Tables) -> DataFrame:
    """R-26: what two systems have among their first ten, once each, with who found it."""
    p = _dense(t, 10).select("qid", "doc", F.lit("dense").alias("system"), "rank").unionByName(_short(t, 10).select("qid", "doc", F.lit("short").alias("system"), "rank"))
    return p.groupBy("qid", "doc").agg(F.min("rank").alias("best_rank"), F.array_join(F.array_sort(F.collect_list("system")), ",").alias("systems"))


@query(f"""WITH {_DENSE}, {_SHORT}, o AS (SELECT qid, doc, rank FROM dense WHERE rank <= 20), sf AS (SELECT o.qid, o.doc, o.rank, floor((1.0 / (60 + o.rank) + coalesce(0.5 / (60 + short.rank), 0)) * 1e9 + 0.5) AS s FROM o LEFT JOIN (SELECT * FROM short WHERE rank <= 20) short ON short.qid = o.qid AND short.doc = o.doc)
SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY rank > 3, CASE WHEN rank <= 3 THEN rank END, s DESC, rank) AS position FROM sf""")
def fixed_head_fusion(t: Tables) -> DataFrame:
    """R-16: the first three stay; those behind are ordered by their place and a second leg, fused by reciprocal ranks."""
    o = _dense(t, 20).select("qid", "doc", "rank").join(_short(t, 20).select("qid", "doc", F.col("rank").alias("leg")), ["qid", "doc"], "left")
    s = F.floor((1.0 / (60 + F.col("rank")) + F.coalesce(0.5 / (60 + F.col("leg")), F.lit(0.0))) * 1e9 + 0.5)
    order = Window.partitionBy("qid").orderBy(F.col("rank") > 3, F.when(F.col("rank") <= 3, F.col("rank")), F.desc("s"), "rank")
    return o.withColumn("s", s).select("qid", "doc", F.row_number().over(order).cast("long").alias("position"))


@query("""
WITH q AS (SELECT vec_id AS qid, i, embedding[i]::DOUBLE AS w FROM embeddings, range(1, 65) r(i) WHERE vec_id % 20 = 0 AND embedding[i] > 0.1), d AS (SELECT vec_id AS doc, i, embedding[i]::DOUBLE AS w FROM embeddings, range(1, 65) r(i) WHERE embedding[i] > 0.1),
s AS (SELECT qid, doc, sum(round(q.w * d.w * 16777216)::BIGINT) / 16777216 AS score FROM q JOIN d USING (i) WHERE qid <> doc GROUP BY ALL) SELECT qid, doc, floor(score * 1e6 + 0.5) / 1e6 AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM s QUALIFY rank <= 10""")
def sparse_topk(t: Tables) -> DataFrame:
    """R-05: products of sparse weight vectors (the places above 0.1), summed on a dyadic grid."""
    kept = t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "w")).filter("w > cast(0.1 as float)").withColumn("w", F.col("w").cast("double"))
    q, d = kept.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "i", F.col("w").alias("x")), kept.select(F.col("vec_id").alias("doc"), "i", F.col("w").alias("y"))
    s = q.join(d, "i").filter("qid <> doc").groupBy("qid", "doc").agg(from_dyadic(F.sum(dyadic(F.col("x") * F.col("y")))).alias("s"))
    r = s.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("s"), "doc")).cast("long")).filter("rank <= 10")
    return r.select("qid", "doc", round6(F.col("s")).alias("score"), "rank")


@query("""
WITH e AS (SELECT event_type AS g, event_id % 50 AS case_id, value FROM events), o AS (SELECT g, case_id, max(value) AS seen FROM e GROUP BY ALL), m AS (SELECT g, case_id, value FROM e),
a AS (SELECT g, case_id, sum(round(abs(value - seen) * 16777216)::BIGINT) / 16777216 / count(*) AS off FROM m JOIN o USING (g, case_id) GROUP BY ALL),
r AS (SELECT g, case_id, value, row_number() OVER (PARTITION BY g, case_id ORDER BY value) AS i, count(*) OVER (PARTITION BY g, case_id) AS n FROM m), b AS (SELECT g, case_id, sum(round((2 * i - n - 1) * value * 16777216)::BIGINT) / 16777216 / (any_value(n) * any_value(n)) AS spread FROM r GROUP BY ALL)
SELECT g AS event_type, floor(avg(off - spread) * 1e4 + 0.5) / 1e4 AS crps FROM a JOIN b USING (g, case_id) GROUP BY 1""")
def crps_by_ranks(t: Tables) -> DataFrame:
    """F-10: the score of ensembles, by ranks: mean distance to what was seen less half the mean distance of members, without pairs of members."""
    m = t.events.select(F.col("event_type").alias("g"), (F.col("event_id") % 50).alias("case_id"), "value")
    key = ["g", "case_id"]
    o = m.groupBy(*key).agg(F.max("value").alias("seen"), F.count(F.lit(1)).alias("n"))
    i = F.row_number().over(Window.partitionBy(*key).orderBy("value"))
    j = m.withColumn("i", i).join(o, key)
    s = j.groupBy(*key, "n").agg((from_dyadic(F.sum(dyadic(F.abs(F.col("value") - F.col("seen"))))) / F.col("n")).alias("off"), (from_dyadic(F.sum(dyadic((2 * F.col("i") - F.col("n") - 1) * F.col("value")))) / (F.col("n") * F.col("n"))).alias("spread"))
    return s.groupBy(F.col("g").alias("event_type")).agg((F.floor(F.avg(F.col("off") - F.col("spread")) * 1e4 + 0.5) / 1e4).alias("crps"))


@query("""
WITH x AS (SELECT l_returnflag AS flag, l_linestatus AS state, l_discount * 100 - l_tax * 100 AS off FROM lineitem), s AS (SELECT flag, state, count(*) AS n, floor(sum(round(abs(off) * 1048576)::BIGINT) / 1048576.0 / count(*) * 1e4 + 0.5) / 1e4 AS mae, floor(sum(round(off * 1048576)::BIGINT) / 1048576.0 / count(*) * 1e4 + 0.5) / 1e4 AS bias FROM x GROUP BY ALL)
SELECT flag, state, n, mae, bias, n >= 30 AND mae <= 3.5 AND abs(bias) <= 1.5 AS qualified FROM s""")
def qualification_gates(t: Tables) -> DataFrame:
    """F-12: error and bias per stratum; a stratum qualifies if it is large enough and both are within their gates."""
    off = F.col("l_discount") * 100 - F.col("l_tax") * 100
    n = F.count(F.lit(1))
    mean = lambda c: F.floor(F.sum(F.round(c * 1048576.0).cast("long")) / F.lit(1048576.0) / n * 1e4 + 0.5) / F.lit(1e4)
    s = t.lineitem.select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("state"), off.alias("off")).groupBy("flag", "state").agg(n.alias("n"), mean(F.abs("off")).alias("mae"), mean(F.col("off")).alias("bias"))
    return s.withColumn("qualified", (F.col("n") >= 30) & (F.col("mae") <= 3.5) & (F.abs("bias") <= 1.5))


@query("""
WITH p AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 101)::DOUBLE AS x, (s_suppkey * 61 % 89)::DOUBLE AS y FROM supplier), g AS (SELECT id, x, y, floor(x / 25) AS i, floor(y / 25) AS j, x / 25 - floor(x / 25) AS u, y / 25 - floor(y / 25) AS v FROM p),
h AS (SELECT *, (i * 7 + j * 3) % 11 AS a, ((i + 1) * 7 + j * 3) % 11 AS b, (i * 7 + (j + 1) * 3) % 11 AS c, ((i + 1) * 7 + (j + 1) * 3) % 11 AS d FROM g)
SELECT id, floor((CASE WHEN u + v <= 1 THEN a + u * (b - a) + v * (c - a) ELSE d + (1 - u) * (c - d) + (1 - v) * (b - d) END) * 1e6 + 0.5) / 1e6 AS height FROM h""")
def triangle_samples(t: Tables) -> DataFrame:
    """F-16: heights of points inside the triangles of a net, by barycentric weights; each point finds its triangle by arithmetic."""
    k = F.col("s_suppkey")
    p = t.supplier.select(k.alias("id"), (k * 37 % 101).cast("double").alias("x"), (k * 61 % 89).cast("double").alias("y"))
    g = p.select("id", F.floor(F.col("x") / 25).alias("i"), F.floor(F.col("y") / 25).alias("j"), (F.col("x") / 25 - F.floor(F.col("x") / 25)).alias("u"), (F.col("y") / 25 - F.floor(F.col("y") / 25)).alias("v"))
    at = lambda di, dj: ((F.col("i") + di) * 7 + (F.col("j") + dj) * 3) % 11
    a, b, c, d = at(0, 0), at(1, 0), at(0, 1), at(1, 1)
    u, v = F.col("u"), F.col("v")
    return g.select("id", round6(F.when(u + v <= 1, a + u * (b - a) + v * (c - a)).otherwise(d + (1 - u) * (c - d) + (1 - v) * (b - d))).alias("height"))


@query(r"""
WITH p AS (SELECT page_id, normalized_text AS t FROM (SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY created_at DESC NULLS LAST) = 1)), f AS (SELECT page_id, coalesce(length(t), 0) AS n, length(regexp_replace(coalesce(t, ''), '[^0-9]', '', 'g')) AS digits, length(regexp_replace(coalesce(t, ''), '[^\p{L}]', '', 'g')) AS letters, len(regexp_extract_all(coalesce(t, ''), '\[[0-9]+\]')) AS refs FROM p)
SELECT page_id, CASE WHEN n = 0 THEN 'EMPTY' WHEN n < 40 THEN 'TITLE' WHEN letters * 2 < n THEN 'NOISE' WHEN digits * 5 > n THEN 'TABLE' WHEN refs >= 8 THEN 'REFERENCES' ELSE 'TEXT' END AS class FROM f""")
def page_classes(t: Tables) -> DataFrame:
    """X-24: pages by thresholds on lengths and shares, the first rule that holds."""
    p = current(t.spark, t.sf_dir, "pages", ["normalized_text"]).select("page_id", F.coalesce("normalized_text", F.lit("")).alias("t"))
    only = lambda chars: F.length(F.regexp_replace("t", chars, ""))
    n, refs = F.length("t"), F.size(F.regexp_extract_all("t", F.lit(r"\[[0-9]+\]"), F.lit(0)))
    kind = F.when(n == 0, "EMPTY").when(n < 40, "TITLE").when(only(r"[^\p{L}]") * 2 < n, "NOISE").when(only("[^0-9]") * 5 > n, "TABLE").when(refs >= 8, "REFERENCES").otherwise("TEXT")
    return p.select("page_id", kind.alias("class"))
