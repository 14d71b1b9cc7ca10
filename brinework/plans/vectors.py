"""Vector search, fusion of rankings and their measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import round6
from ..operators import joins, retrieval, vectors
from .catalog import Catalog, Tables

catalog = Catalog()
query = catalog.query
QUERIES, ORACLES = catalog.queries, catalog.oracles

_R6 = "floor(({}) * 1e6 + 0.5) / 1e6"
_Q = "q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 20 = 0), d AS (SELECT vec_id AS doc, embedding::DOUBLE[] AS y, label FROM embeddings)"
_DENSE = f"{_Q}, s AS (SELECT qid, doc, floor(list_inner_product(x, y) * 1e6 + 0.5) / 1e6 AS score FROM q, d WHERE qid <> doc), dense AS (SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM s)"
_SHORT = "s2 AS (SELECT qid, doc, floor(list_inner_product(x[1:16], y[1:16]) * 1e6 + 0.5) / 1e6 AS score FROM q, d WHERE qid <> doc), short AS (SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM s2)"


def _sides(t: Tables, vector=None) -> tuple[DataFrame, DataFrame]:
    rows = t.embeddings.select("vec_id", (F.col("embedding") if vector is None else vector).alias("v"))
    return rows.filter("vec_id % 20 = 0"), rows


def _dense(t: Tables, k: int) -> DataFrame:
    return vectors.search(*_sides(t), "vec_id", "v", k)


def _short(t: Tables, k: int) -> DataFrame:
    return vectors.search(*_sides(t, F.slice("embedding", 1, 16)), "vec_id", "v", k)


@query(f"WITH {_DENSE} SELECT qid, doc, score, rank FROM dense WHERE rank <= 10")
def dense_topk(t: Tables) -> DataFrame:
    """R-03, J-17: every twentieth vector against all, in blocks."""
    return _dense(t, 10)


@query(f"WITH {_Q}, {_SHORT} SELECT qid, doc, score, rank FROM short WHERE rank <= 10")
def matryoshka_topk(t: Tables) -> DataFrame:
    """R-03 on the first 16 places."""
    return _short(t, 10)


@query("""
WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 0.125 ELSE -0.125 END)::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.vec_id AS qid, b.vec_id AS doc, floor(list_inner_product(a.v, b.v) * 1e6 + 0.5) / 1e6 AS score FROM b a, b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM s QUALIFY rank <= 10""")
def binary_topk(t: Tables) -> DataFrame:
    """R-04: signs only."""
    return vectors.search(*_sides(t, vectors.quantized(F.col("embedding"), "binary")), "vec_id", "v", 10)


@query("""
WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) / 127 AS sc FROM embeddings),
b AS (SELECT vec_id, list_transform(e, lambda x: least(greatest(floor(x / sc + 0.5), -127), 127) * sc) AS v FROM a), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM b),
s AS (SELECT a.vec_id AS qid, b.vec_id AS doc, floor(list_inner_product(a.v, b.v) * 1e6 + 0.5) / 1e6 AS score FROM u a, u b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM s QUALIFY rank <= 10""")
def int8_topk(t: Tables) -> DataFrame:
    """R-04: eight bits."""
    return vectors.search(*_sides(t, vectors.quantized(F.col("embedding"), "int8")), "vec_id", "v", 10)


@query("""
WITH tk AS (SELECT vec_id AS id, i AS pos, embedding[i * 8 + 1:i * 8 + 8]::DOUBLE[] AS vec FROM embeddings, range(8) r(i)), m AS (SELECT q.id AS qid, d.id AS doc, q.pos, max(list_inner_product(q.vec, d.vec)) AS best FROM tk q, tk d WHERE q.id % 20 = 0 AND q.id <> d.id GROUP BY ALL),
s AS (SELECT qid, doc, floor(sum(best) * 1e6 + 0.5) / 1e6 AS score FROM m GROUP BY ALL) SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM s QUALIFY rank <= 5""")
def maxsim_topk(t: Tables) -> DataFrame:
    """R-06: eight tokens of eight places each."""
    places = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct(i.alias("pos"), F.slice("embedding", i * 8 + 1, 8).alias("vec")))
    tokens = t.embeddings.select(F.col("vec_id").alias("id"), F.inline(places))
    return vectors.maxsim(tokens.filter("id % 20 = 0"), tokens, 5)


@query(f"WITH {_DENSE}, {_SHORT}, f AS (SELECT qid, doc, {_R6.format('sum(w / (60 + rank))')} AS score FROM (SELECT qid, doc, rank, 1.0::DOUBLE AS w FROM dense WHERE rank <= 20 UNION ALL SELECT qid, doc, rank, 0.5::DOUBLE FROM short WHERE rank <= 20) GROUP BY ALL) SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM f QUALIFY rank <= 10")
def rrf_fusion(t: Tables) -> DataFrame:
    """R-07, R-14."""
    fused = retrieval.rrf([(_dense(t, 20), 1.0), (_short(t, 20), 0.5)]).withColumn("score", round6(F.col("score")))
    return retrieval.ranked(fused, k=10).withColumn("rank", F.col("rank").cast("long"))


def _fusion_sql(scale: str) -> str:
    return f"""WITH {_DENSE}, {_SHORT}, a AS (SELECT qid, doc, {scale} AS s FROM dense WHERE rank <= 20), b AS (SELECT qid, doc, {scale} AS s FROM short WHERE rank <= 20),
k AS (SELECT qid, doc FROM a UNION SELECT qid, doc FROM b), fa AS (SELECT qid, min(s) AS f FROM a GROUP BY 1), fb AS (SELECT qid, min(s) AS f FROM b GROUP BY 1)
SELECT k.qid, k.doc, {_R6.format('0.7 * coalesce(a.s, fa.f) + 0.3 * coalesce(b.s, fb.f)')} AS score FROM k LEFT JOIN a ON a.qid = k.qid AND a.doc = k.doc LEFT JOIN b ON b.qid = k.qid AND b.doc = k.doc JOIN fa ON fa.qid = k.qid JOIN fb ON fb.qid = k.qid"""


def _fused(t: Tables, how: str) -> DataFrame:
    legs = [(_dense(t, 20).select("qid", "doc", "score"), 0.7), (_short(t, 20).select("qid", "doc", "score"), 0.3)]
    return retrieval.weighted_fusion(legs, how).withColumn("score", round6(F.col("score")))


@query(_fusion_sql("(score - min(score) OVER (PARTITION BY qid)) / nullif(max(score) OVER (PARTITION BY qid) - min(score) OVER (PARTITION BY qid), 0)"))
def weighted_fusion_minmax(t: Tables) -> DataFrame:
    """R-08."""
    return _fused(t, "minmax")


@query(_fusion_sql("(score - avg(score) OVER (PARTITION BY qid)) / nullif(stddev_pop(score) OVER (PARTITION BY qid), 0)"))
def weighted_fusion_zscore(t: Tables) -> DataFrame:
    """R-08."""
    return _fused(t, "zscore")


@query(_fusion_sql("1 - (row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) - 1) / count(*) OVER (PARTITION BY qid)"))
def weighted_fusion_rank(t: Tables) -> DataFrame:
    """R-08."""
    return _fused(t, "rank")


def _labelled(t: Tables, k: int) -> DataFrame:
    return _dense(t, k).join(t.embeddings.select(F.col("vec_id").alias("doc"), F.col("label").alias("source")), "doc")


@query(f"WITH {_DENSE}, l AS (SELECT dense.*, label AS source FROM dense JOIN d USING (doc) WHERE rank <= 20), r AS (SELECT *, (row_number() OVER (PARTITION BY qid, source ORDER BY rank) - 1) // 2 AS turn FROM l) SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY turn, rank) AS position FROM r")
def per_source_cap(t: Tables) -> DataFrame:
    """T-05: two of a source a round."""
    return retrieval.per_source_cap(_labelled(t, 20), "source", 2).select("qid", "doc", F.col("position").cast("long").alias("position"))


@query(f"WITH {_DENSE} SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN rank <= 8 AND label = 3 THEN 0 WHEN rank <= 8 THEN 1 ELSE 2 END, rank) AS position FROM dense JOIN d USING (doc) WHERE rank <= 20")
def head_promotion(t: Tables) -> DataFrame:
    """T-06."""
    return retrieval.head_promotion(_labelled(t, 20).withColumn("flag", F.col("source") == 3), "flag", 8).select("qid", "doc", F.col("position").cast("long").alias("position"))


@query(f"""WITH {_DENSE}, l AS (SELECT dense.*, label FROM dense JOIN d USING (doc) WHERE rank <= 20), r AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY rank) AS place FROM l),
c AS (SELECT qid, label, arg_min(doc, rank) AS doc, min(rank) AS best, string_agg(doc::VARCHAR, ',' ORDER BY rank) AS hits FROM r WHERE place <= 3 GROUP BY ALL) SELECT qid, doc, hits, row_number() OVER (PARTITION BY qid ORDER BY best) AS position FROM c""")
def collapse_groups(t: Tables) -> DataFrame:
    """T-07, R-10, K-34: best of each group, three inner hits."""
    return retrieval.collapse(_labelled(t, 20), "source", 3).select("qid", "doc", "hits", F.col("position").cast("long").alias("position"))


@query(f"WITH {_DENSE}, l AS (SELECT dense.*, label FROM dense JOIN d USING (doc) WHERE rank <= 20), r AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY rank) AS place, min(rank) OVER (PARTITION BY qid, label) AS best FROM l) SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY place, best) AS position FROM r")
def round_robin(t: Tables) -> DataFrame:
    """T-09, R-28."""
    return retrieval.interleaved(_labelled(t, 20), "source").select("qid", "doc", F.col("position").cast("long").alias("position"))


_QRELS = "g AS (SELECT q.qid, d.doc, CASE WHEN d.label = (SELECT label FROM embeddings WHERE vec_id = q.qid) THEN 2 + d.doc % 2 ELSE d.doc % 2 END AS grade FROM q, d WHERE q.qid <> d.doc AND (q.qid + d.doc) % 3 = 0)"


def _qrels(t: Tables) -> DataFrame:
    """Grades made from labels for a third of the pairs."""
    e = t.embeddings.select("vec_id", "label", (F.col("vec_id") % 3).alias("m"))
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("ql"), ((3 - F.col("m")) % 3).alias("m"))
    pairs = e.select(F.col("vec_id").alias("doc"), "label", "m").join(q, "m").filter("qid <> doc")
    grade = F.when(F.col("label") == F.col("ql"), 2 + F.col("doc") % 2).otherwise(F.col("doc") % 2)
    return pairs.select("qid", "doc", grade.alias("grade"))


@query(f"""WITH {_DENSE}, {_QRELS}, i AS (SELECT qid, count(*) FILTER (WHERE grade >= 2) AS n_rel FROM g GROUP BY 1), io AS (SELECT qid, grade, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, doc) AS i FROM g WHERE grade > 0), id AS (SELECT qid, sum(grade / log2(i + 1)) AS idcg FROM io WHERE i <= 10 GROUP BY 1),
t AS (SELECT dense.qid, rank, grade FROM dense LEFT JOIN g ON g.qid = dense.qid AND g.doc = dense.doc WHERE rank <= 10),
a AS (SELECT qid, count(*) FILTER (WHERE grade >= 2) AS hits, min(rank) FILTER (WHERE grade >= 2) AS first, sum(coalesce(grade, 0) / log2(rank + 1)) AS dcg, count(grade) AS judged, count(*) AS n FROM t GROUP BY 1)
SELECT qid, {_R6.format('hits / n_rel')} AS recall, {_R6.format('hits / 10')} AS precision, {_R6.format('coalesce(1 / first, 0)')} AS mrr, {_R6.format('dcg / idcg')} AS ndcg, {_R6.format('judged / n')} AS judged FROM i JOIN id USING (qid) JOIN a USING (qid) WHERE n_rel > 0""")
def ir_metrics(t: Tables) -> DataFrame:
    """R-19, R-20."""
    m = retrieval.measures(_dense(t, 10), _qrels(t))
    return m.select("qid", *(round6(F.col(c)).alias(c) for c in ("recall", "precision", "mrr", "ndcg", "judged")))


@query(f"""WITH {_DENSE}, {_SHORT}, h AS (SELECT dense.qid, count(*) FILTER (WHERE label = (SELECT label FROM embeddings WHERE vec_id = dense.qid)) / 10 AS a FROM dense JOIN d USING (doc) WHERE rank <= 10 GROUP BY 1),
k AS (SELECT short.qid, count(*) FILTER (WHERE label = (SELECT label FROM embeddings WHERE vec_id = short.qid)) / 10 AS b FROM short JOIN d USING (doc) WHERE rank <= 10 GROUP BY 1), x AS (SELECT qid, round((a - b) * 10)::BIGINT AS diff FROM h JOIN k USING (qid)),
r AS (SELECT n.i, sum(CASE WHEN md5((n.i * 1000003 + x.qid)::VARCHAR)[-1] IN ('0', '1', '2', '3', '4', '5', '6', '7') THEN diff ELSE -diff END) AS s FROM range(200) n(i), x GROUP BY 1)
SELECT (SELECT sum(diff)::BIGINT FROM x) AS observed, (SELECT count(*) FROM x) AS queries, {_R6.format('(count(*) FILTER (WHERE abs(s) >= abs((SELECT sum(diff) FROM x))) + 1) / 201')} AS p FROM r""")
def paired_compare(t: Tables) -> DataFrame:
    """R-21: sign-flip randomisation with hashed signs, so that it is the same everywhere."""
    label = t.embeddings.select("vec_id", "label")

    def hits(ranking: DataFrame, name: str) -> DataFrame:
        j = ranking.join(label.select(F.col("vec_id").alias("doc"), "label"), "doc").join(label.select(F.col("vec_id").alias("qid"), F.col("label").alias("own")), "qid")
        return j.groupBy("qid").agg(F.count_if(F.col("label") == F.col("own")).alias(name))

    x = hits(_dense(t, 10), "a").join(hits(_short(t, 10), "b"), "qid").select("qid", (F.col("a") - F.col("b")).alias("diff"))
    flips = x.select("diff", "qid", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("i"))
    sign = F.when(F.substring(F.md5((F.col("i") * F.lit(1000003) + F.col("qid")).cast("string")), -1, 1).between("0", "7"), 1).otherwise(-1)
    sums = flips.groupBy("i").agg(F.sum(sign * F.col("diff")).alias("s"))
    seen = x.agg(F.sum("diff").alias("observed"), F.count(F.lit(1)).alias("queries"))
    return sums.crossJoin(F.broadcast(seen)).groupBy("observed", "queries").agg(round6((F.count_if(F.abs("s") >= F.abs("observed")) + 1) / 201).alias("p"))


@query("""
WITH p AS (SELECT label, i, sum(round((1 + vec_id % 2)::DOUBLE * embedding[i]::DOUBLE * 16777216)::BIGINT)::DOUBLE / 16777216 AS s FROM embeddings, range(1, 65) r(i) GROUP BY ALL), n AS (SELECT label, sqrt(sum(s * s)) AS n FROM p GROUP BY 1)
SELECT label, i - 1 AS pos, floor(s / n * 1e6 + 0.5) / 1e6 AS value FROM p JOIN n USING (label)""")
def section_vectors(t: Tables) -> DataFrame:
    """A-18, K-10: weighted mean per group, normalised."""
    m = vectors.mean_vector(t.embeddings, ["label"], "embedding", (1 + F.col("vec_id") % 2).cast("double"))
    return m.select("label", F.posexplode("mean").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), round6(F.col("x")).alias("value"))


@query("""
WITH m AS (SELECT vec_id % 3 AS lang, i, avg(embedding[i]::DOUBLE) AS mean FROM embeddings, range(1, 65) r(i) GROUP BY ALL), c AS (SELECT vec_id, i, embedding[i]::DOUBLE - mean AS x FROM embeddings, range(1, 65) r(i) JOIN m USING (i) WHERE lang = vec_id % 3)
SELECT vec_id, floor(sqrt(sum(x * x)) * 1e4 + 0.5) / 1e4 AS length FROM c GROUP BY 1""")
def language_centering(t: Tables) -> DataFrame:
    """K-11: the mean of a language off each of its vectors."""
    rows = t.embeddings.select("vec_id", (F.col("vec_id") % 3).alias("lang"), F.posexplode("embedding").alias("i", "x"))
    means = rows.groupBy("lang", "i").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    off = rows.join(F.broadcast(means), ["lang", "i"]).withColumn("d", F.col("x").cast("double") - F.col("mean"))
    return off.groupBy("vec_id").agg((F.floor(F.sqrt(F.sum(F.col("d") * F.col("d"))) * 1e4 + 0.5) / 1e4).alias("length"))


@query(f"WITH {_DENSE} SELECT least(qid, doc) AS a, greatest(qid, doc) AS b, max(score) AS weight FROM dense WHERE rank <= 5 AND score > 0 GROUP BY ALL")
def knn_graph(t: Tables) -> DataFrame:
    """K-17: undirected, greatest weight; the stated vectors against all."""
    return _dense(t, 5).filter("score > 0").groupBy(F.least("qid", "doc").alias("a"), F.greatest("qid", "doc").alias("b")).agg(F.max("score").alias("weight"))


@query(f"""WITH {_DENSE}, r AS (SELECT qid, d.label, count(*) AS votes, max(score) AS best FROM dense JOIN d USING (doc) WHERE rank <= 9 GROUP BY ALL)
SELECT qid, label AS topic, votes FROM r QUALIFY row_number() OVER (PARTITION BY qid ORDER BY votes DESC, best DESC, label) = 1""")
def topic_by_neighbours(t: Tables) -> DataFrame:
    """K-19, K-20: the topic most of the nearest have."""
    n = _labelled(t, 9).groupBy("qid", "source").agg(F.count(F.lit(1)).alias("votes"), F.max("score").alias("best"))
    w = Window.partitionBy("qid").orderBy(F.desc("votes"), F.desc("best"), "source")
    return n.withColumn("r", F.row_number().over(w)).filter("r = 1").select("qid", F.col("source").alias("topic"), "votes")


@query("""
WITH m AS (SELECT label, i, sum(round(embedding[i]::DOUBLE * 16777216)::BIGINT)::DOUBLE / 16777216 AS s FROM embeddings, range(1, 65) r(i) GROUP BY ALL), n AS (SELECT label, list(s ORDER BY i) AS c, sqrt(sum(s * s)) AS n FROM m GROUP BY 1),
s AS (SELECT vec_id, label, floor(list_inner_product(embedding::DOUBLE[], c) / n * 1e6 + 0.5) / 1e6 AS sim FROM embeddings JOIN n USING (label)) SELECT label, vec_id, sim, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS r FROM s QUALIFY r <= 3""")
def central_units(t: Tables) -> DataFrame:
    """K-18, W-07: the members nearest to their group's mean."""
    means = vectors.mean_vector(t.embeddings, ["label"], "embedding")
    s = t.embeddings.join(F.broadcast(means), "label").select("label", "vec_id", round6(vectors.dot(F.col("embedding"), F.col("mean"))).alias("sim"))
    w = Window.partitionBy("label").orderBy(F.desc("sim"), "vec_id")
    return s.withColumn("r", F.row_number().over(w).cast("long")).filter("r <= 3")


@query(f"""WITH {_DENSE}, {_SHORT}, j AS (SELECT dense.qid, dense.rank AS a, short.rank AS b FROM dense JOIN short ON dense.qid = short.qid AND dense.doc = short.doc WHERE dense.rank <= 20 AND short.rank <= 20)
SELECT qid, count(*) AS common, {_R6.format('count(*) / 20')} AS overlap, sum((a - b) * (a - b))::BIGINT AS squares FROM j GROUP BY 1""")
def rank_agreement(t: Tables) -> DataFrame:
    """R-22: overlap of the first twenty and the squared rank differences Spearman's measure needs."""
    a, b = _dense(t, 20).select("qid", "doc", F.col("rank").alias("a")), _short(t, 20).select("qid", "doc", F.col("rank").alias("b"))
    return a.join(b, ["qid", "doc"]).groupBy("qid").agg(F.count(F.lit(1)).alias("common"), round6(F.count(F.lit(1)) / 20).alias("overlap"), F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("squares"))


@query("""
SELECT count(*) AS n, count(*) FILTER (WHERE len(embedding) <> 64) AS wrong_size, count(*) FILTER (WHERE abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 1e-3) AS off_norm, count(*) - count(DISTINCT vec_id) AS duplicates FROM embeddings""")
def artifact_validation(t: Tables) -> DataFrame:
    """R-23."""
    e = t.embeddings
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("embedding") != 64).alias("wrong_size"), F.count_if(F.abs(vectors.norm(F.col("embedding")) - 1) > 1e-3).alias("off_norm"), (F.count(F.lit(1)) - F.count_distinct("vec_id")).alias("duplicates"))


@query("""
WITH c AS (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] >= 0 THEN (1::HUGEINT << (i - 1)) ELSE 0::HUGEINT END)) AS code FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.code, b.code))::BIGINT AS distance FROM c a JOIN c b ON a.vec_id < b.vec_id AND bit_count(xor(a.code, b.code)) <= 16""")
def hamming_pairs(t: Tables) -> DataFrame:
    """J-18, D-11: sign bits within 16 of 64, by pieces of the code."""
    bits = F.aggregate(F.zip_with("embedding", F.sequence(F.lit(0), F.lit(63)), lambda x, i: F.when(x >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
    return joins.hamming_pairs(t.embeddings.select("vec_id", bits.alias("code")), "vec_id", "code", 16).withColumn("distance", F.col("distance").cast("long"))
