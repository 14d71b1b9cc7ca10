"""Corpus rules: traces, citations, sections, chronology, late re-ordering, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.common import round6, text_list
from ..functions.sequences import alignment, greedy_matching, ordered_length
from ..functions.tables import table_cells_udtf
from ..operators import vectors
from ..tables import current
from .catalog import Catalog, Tables
from .vectors import _DENSE, _SHORT, _dense, _short

catalog = Catalog()
query = catalog.query
QUERIES, ORACLES = catalog.queries, catalog.oracles

_EV = "SELECT * FROM passport_evidence QUALIFY row_number() OVER (PARTITION BY ev_id ORDER BY recorded_at DESC NULLS LAST) = 1"
_PG = "SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY created_at DESC NULLS LAST) = 1"


@query(f"""
SELECT ev_id, e.page_id, page_status, s.lifecycle_status, CASE WHEN e.page_id IS NULL THEN 'NO_PAGE' WHEN p.page_id IS NULL THEN 'LOST_PAGE' WHEN s.source_id IS NULL THEN 'LOST_SOURCE' ELSE 'TRACED' END AS trace
FROM ({_EV}) e LEFT JOIN ({_PG}) p ON p.page_id = e.page_id LEFT JOIN sources s ON s.source_id = e.source_id""")
def provenance_trace(t: Tables) -> DataFrame:
    """PF-02, V-09: each record's page and source, and where its trace ends."""
    e = current(t.spark, t.sf_dir, "passport_evidence", ["page_id", "source_id"]).select("ev_id", "page_id", "source_id")
    p = current(t.spark, t.sf_dir, "pages", ["page_status"]).select(F.col("page_id").alias("pid"), "page_status")
    s = t.sources.select(F.col("source_id").alias("sid"), "lifecycle_status")
    j = e.join(p, F.col("page_id") == F.col("pid"), "left").join(s, F.col("source_id") == F.col("sid"), "left")
    trace = F.when(F.col("page_id").isNull(), "NO_PAGE").when(F.col("pid").isNull(), "LOST_PAGE").when(F.col("sid").isNull(), "LOST_SOURCE").otherwise("TRACED")
    return j.select("ev_id", "page_id", "page_status", "lifecycle_status", trace.alias("trace"))


@query(f"""
WITH w AS (SELECT page_id, count(DISTINCT work_id) AS works, min(work_id) AS work FROM nav_dup_members WHERE regexp_matches(work_id, '^[A-Z]+-WRK-') GROUP BY 1)
SELECT ev_id, CASE WHEN works = 1 THEN work END AS citing_work, CASE WHEN works IS NULL THEN 'NO_LINK' WHEN works = 1 THEN 'UNIQUE_LINK' ELSE 'AMBIGUOUS' END AS basis, coalesce(works, 0) AS candidates FROM ({_EV}) e LEFT JOIN w ON w.page_id = e.page_id""")
def citing_work(t: Tables) -> DataFrame:
    """B-01: the work of an entry's page, if it has just one."""
    w = t.nav_dup_members.filter(F.col("work_id").rlike("^[A-Z]+-WRK-")).groupBy("page_id").agg(F.count_distinct("work_id").alias("works"), F.min("work_id").alias("work"))
    e = current(t.spark, t.sf_dir, "passport_evidence", ["page_id"]).select("ev_id", "page_id").join(w, "page_id", "left")
    basis = F.when(F.col("works").isNull(), "NO_LINK").when(F.col("works") == 1, "UNIQUE_LINK").otherwise("AMBIGUOUS")
    return e.select("ev_id", F.when(F.col("works") == 1, F.col("work")).alias("citing_work"), basis.alias("basis"), F.coalesce("works", F.lit(0)).alias("candidates"))


@query(rf"SELECT source_id, regexp_extract(cited_ref, '\[([0-9]+)\]', 1)::BIGINT AS cited, count(*) AS n, string_agg(DISTINCT parameter_code, ',' ORDER BY parameter_code) AS parameters FROM ({_EV}) WHERE regexp_matches(cited_ref, '^\[[0-9]+\]$') AND source_id IS NOT NULL GROUP BY ALL")
def cites_edges(t: Tables) -> DataFrame:
    """B-04: citations with counts and distinct lists."""
    e = current(t.spark, t.sf_dir, "passport_evidence", ["cited_ref", "source_id", "parameter_code"]).filter(F.col("cited_ref").rlike(r"^\[[0-9]+\]$") & F.col("source_id").isNotNull())
    return e.groupBy("source_id", F.regexp_extract("cited_ref", r"\[([0-9]+)\]", 1).cast("long").alias("cited")).agg(F.count(F.lit(1)).alias("n"), text_list(F.array_sort(F.collect_set("parameter_code"))).alias("parameters"))


@query("""
WITH s AS (SELECT user_id, min(ts) FILTER (WHERE event_type = 'signup') AS born FROM events GROUP BY 1)
SELECT event_id, born IS NULL AS unborn FROM events JOIN s USING (user_id) WHERE event_type = 'purchase' AND (born IS NULL OR ts < born)""")
def chronology_errors(t: Tables) -> DataFrame:
    """F-04: purchases before their owner's beginning."""
    born = t.events.filter("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("born"))
    j = t.events.filter("event_type = 'purchase'").join(born, "user_id", "left").filter("born is null or ts < born")
    return j.select("event_id", F.col("born").isNull().alias("unborn"))


@query("""
WITH i AS (SELECT user_id, min(ts) AS told FROM events WHERE event_type = 'view' AND ts <= TIMESTAMP '2024-01-10' GROUP BY 1)
SELECT event_id FROM events e WHERE (event_type = 'click' AND ts <= TIMESTAMP '2024-01-10') OR (event_type = 'error' AND EXISTS (SELECT 1 FROM i WHERE i.user_id = e.user_id))""")
def known_physical(t: Tables) -> DataFrame:
    """F-03: events known by themselves or revealed by one that is known."""
    told = t.events.filter("event_type = 'view' and ts <= timestamp_ntz'2024-01-10'").select("user_id").distinct()
    own = t.events.filter("event_type = 'click' and ts <= timestamp_ntz'2024-01-10'").select("event_id")
    return own.unionAll(t.events.filter("event_type = 'error'").join(told, "user_id", "left_semi").select("event_id"))


_HEADS = r"""h AS (SELECT DISTINCT b.source_id, p.page_index, b.reading_order, b.object_id, b.normalized_text AS title, CASE WHEN regexp_matches(b.normalized_text, '^[0-9]+\.[0-9]+ \p{Lu}') THEN 2 ELSE 1 END AS level FROM blocks b JOIN (""" + _PG + r""") p ON p.page_id = b.page_id
 WHERE regexp_matches(b.normalized_text, '^[0-9]+\.[0-9]+ \p{Lu}') OR regexp_matches(b.normalized_text, '^(Глава|Раздел|Section|Chapter|Kapitel) [0-9]+'))"""


@query(f"""WITH {_HEADS} SELECT object_id, level::BIGINT AS level, page_index::BIGINT AS first_page, coalesce(CASE WHEN level = 2 THEN lead(page_index) OVER w ELSE min(page_index) FILTER (WHERE level = 1) OVER (PARTITION BY source_id ORDER BY page_index, reading_order, object_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) END, 1000000)::BIGINT AS next_page,
 max(CASE WHEN level = 1 THEN page_index END) OVER (PARTITION BY source_id ORDER BY page_index, reading_order, object_id ROWS UNBOUNDED PRECEDING)::BIGINT AS chapter_page FROM h WINDOW w AS (PARTITION BY source_id ORDER BY page_index, reading_order, object_id)""")
def section_tree(t: Tables) -> DataFrame:
    """K-26, X-19: sections with their end - the next of the same level or above - and their chapter, by windows alone."""
    numbered, chapter = F.col("title").rlike(r"^[0-9]+\.[0-9]+ \p{Lu}"), F.col("title").rlike(r"^(Глава|Раздел|Section|Chapter|Kapitel) [0-9]+")
    pages = current(t.spark, t.sf_dir, "pages", ["page_index"]).select("page_id", "page_index")
    b = t.blocks.select("source_id", "page_id", "reading_order", "object_id", F.col("normalized_text").alias("title")).filter(numbered | chapter).distinct()
    h = b.join(pages, "page_id").withColumn("level", F.when(numbered, 2).otherwise(1))
    w = Window.partitionBy("source_id").orderBy("page_index", "reading_order", "object_id")
    top = F.when(F.col("level") == 1, F.col("page_index"))
    nxt = F.when(F.col("level") == 2, F.lead("page_index").over(w)).otherwise(F.min(top).over(w.rowsBetween(1, Window.unboundedFollowing)))
    return h.select("object_id", F.col("level").cast("long").alias("level"), F.col("page_index").cast("long").alias("first_page"), F.coalesce(nxt, F.lit(1000000)).cast("long").alias("next_page"), F.max(top).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("chapter_page"))


@query(f"""WITH {_DENSE}, {_SHORT}, f AS (SELECT dense.qid, dense.doc, dense.rank, label % 3 AS kind, coalesce(short.score, -9) AS late FROM dense JOIN d ON d.doc = dense.doc LEFT JOIN (SELECT * FROM short WHERE rank <= 20) short ON short.qid = dense.qid AND short.doc = dense.doc WHERE dense.rank <= 20),
sl AS (SELECT qid, kind, rank AS slot, row_number() OVER (PARTITION BY qid, kind ORDER BY rank) AS i FROM f), c AS (SELECT qid, kind, doc, row_number() OVER (PARTITION BY qid, kind ORDER BY late DESC, rank) AS i FROM f)
SELECT sl.qid, c.doc, sl.slot FROM sl JOIN c ON sl.qid = c.qid AND sl.kind = c.kind AND sl.i = c.i""")
def late_reorder(t: Tables) -> DataFrame:
    """R-12, R-13: within each kind its slots are refilled in order of the late score; other kinds stay."""
    late = _short(t, 20).select("qid", "doc", F.col("score").alias("late"))
    f = _dense(t, 20).join(t.embeddings.select(F.col("vec_id").alias("doc"), (F.col("label") % 3).alias("kind")), "doc").join(late, ["qid", "doc"], "left").withColumn("late", F.coalesce("late", F.lit(-9.0)))
    by = Window.partitionBy("qid", "kind")
    s = f.select("qid", "kind", F.col("rank").alias("slot"), F.row_number().over(by.orderBy("rank")).alias("i"))
    c = f.select("qid", "kind", "doc", F.row_number().over(by.orderBy(F.desc("late"), "rank")).alias("i"))
    return s.join(c, ["qid", "kind", "i"]).select("qid", "doc", "slot")


@query("""
WITH p AS (SELECT vec_id % 2 AS side, vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS a, b.vec_id AS b, floor(list_inner_product(a.v, b.v) * 1e6 + 0.5) / 1e6 AS c FROM p a JOIN p b ON a.side = 0 AND b.side = 1),
ra AS (SELECT a, avg(c) AS r FROM (SELECT a, c FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 5) GROUP BY 1), rb AS (SELECT b, avg(c) AS r FROM (SELECT b, c FROM s QUALIFY row_number() OVER (PARTITION BY b ORDER BY c DESC, a) <= 5) GROUP BY 1),
k AS (SELECT a, b, floor((2 * c - ra.r - rb.r) * 1e6 + 0.5) / 1e6 AS csls FROM s JOIN ra USING (a) JOIN rb USING (b) WHERE a % 20 = 0) SELECT a, b, csls FROM k QUALIFY rank() OVER (PARTITION BY a ORDER BY csls DESC) = 1""")
def csls_best_all(t: Tables) -> DataFrame:
    """K-21: for every 20th vector the best of the other side after both neighbourhoods' levels, each over the whole other side, are taken off."""
    e = t.embeddings.select("vec_id", F.col("embedding").alias("v"))
    side_a = e.filter("vec_id % 2 = 0")
    return vectors.csls(e.filter("vec_id % 20 = 0"), side_a, e.filter("vec_id % 2 = 1"), "vec_id", "v")


@query("""
WITH g AS (SELECT i / 4 AS a, j / 4 AS b FROM range(5) x(i), range(5) y(j) WHERE i + j <= 4) SELECT a, b, 1 - a - b AS c FROM g""")
def weight_grid(t: Tables) -> DataFrame:
    """R-09: the simplex in quarters."""
    i = t.spark.range(5).select(F.col("id").alias("i"))
    g = i.select("i", F.explode(F.sequence(F.lit(0), (4 - F.col("i")).cast("int"))).alias("j"))
    return g.select((F.col("i") / 4).alias("a"), (F.col("j") / 4).alias("b"), (1 - F.col("i") / 4 - F.col("j") / 4).alias("c"))


@query("""
WITH l AS (SELECT user_id, event_id, ts, value, lag(ts) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 12 HOUR OR ts = before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM l)
SELECT user_id, seg::BIGINT AS seg, count(*) AS points, max(value) - min(value) AS spread FROM s GROUP BY ALL""")
def trace_segments(t: Tables) -> DataFrame:
    """W-16: a trace broken at gaps and repeated places."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    l = t.events.withColumn("before", F.lag("ts").over(w))  # noqa: E741
    breaks = F.col("before").isNull() | (F.col("ts") > F.col("before") + F.expr("interval 12 hours")) | (F.col("ts") == F.col("before"))
    s = l.withColumn("seg", F.sum(F.when(breaks, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id", "seg").agg(F.count(F.lit(1)).alias("points"), (F.max("value") - F.min("value")).alias("spread"))


@query(r"SELECT doc_id, md5(translate(regexp_replace(replace(lower(text), 'ё', 'е'), '[^\p{L}\p{N}]+', '', 'g'), 'асеорхукмнвт', 'aceopxykmhbt')) AS key FROM documents WHERE text IS NOT NULL")
def norm_keys(t: Tables) -> DataFrame:
    """X-03."""
    return t.documents.filter("text is not null").select("doc_id", F.md5(X.norm_key(F.col("text"))).alias("key"))


@query("""
WITH c AS (SELECT * FROM table_cells QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY created_at DESC NULLS LAST) = 1), g AS (SELECT table_id, row_no, col_no, min(cell_id) AS cell_id FROM c GROUP BY ALL),
k AS (SELECT c.*, dense_rank() OVER (PARTITION BY c.table_id ORDER BY c.row_no) - 1 AS r, row_number() OVER (PARTITION BY c.table_id, c.row_no ORDER BY c.col_no) - 1 AS k FROM c JOIN g USING (table_id, row_no, col_no, cell_id))
SELECT table_id, r AS row, k AS col, coalesce(is_header, false) AS is_header, trim(coalesce(text, '')) AS text FROM k""")
def html_round_trip(t: Tables) -> DataFrame:
    """X-15: tables written as HTML and read back by the table function."""
    c = current(t.spark, t.sf_dir, "table_cells", ["table_id", "row_no", "col_no", "is_header", "text"])
    one = c.groupBy("table_id", "row_no", "col_no").agg(F.min_by(F.struct("is_header", "text"), "cell_id").alias("c"))
    safe = F.replace(F.replace(F.replace(F.coalesce("c.text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = F.when(F.col("c.is_header"), "th").otherwise("td")
    cell = F.concat(F.lit("<"), tag, F.lit(">"), safe, F.lit("</"), tag, F.lit(">"))
    rows = one.select("table_id", "row_no", "col_no", cell.alias("cell")).groupBy("table_id", "row_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "cell"))), lambda s: s["cell"]), "").alias("r"))
    html = rows.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "r"))), lambda s: F.concat(F.lit("<tr>"), s["r"], F.lit("</tr>"))), "").alias("html"))
    return html.lateralJoin(table_cells_udtf()(F.col("html").outer())).select("table_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "is_header", F.trim("text").alias("text"))


@query("""
WITH m AS (SELECT DISTINCT m.cluster_id, m.source_id, p.page_index FROM nav_dup_members m JOIN (SELECT DISTINCT page_id, page_index FROM pages) p ON p.page_id = m.page_id WHERE m.source_id IS NOT NULL), f AS (SELECT cluster_id, min((source_id, page_index)) AS f FROM m GROUP BY 1),
o AS (SELECT f.f[1] AS a, m.source_id AS b, m.page_index - f.f[2] AS off FROM m JOIN f USING (cluster_id) WHERE m.source_id <> f.f[1]), n AS (SELECT a, b, off, count(*) AS n FROM o GROUP BY ALL)
SELECT a, b, off::BIGINT AS offset_pages, n FROM n QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY n DESC, abs(off), off) = 1""")
def aligned_offsets(t: Tables) -> DataFrame:
    """A-20, R-15: the commonest page offset of two sources, each member against its cluster's first."""
    p = t.pages.select("page_id", "page_index").distinct()
    m = t.nav_dup_members.filter("source_id is not null").select("cluster_id", "source_id", "page_id").join(p, "page_id").select("cluster_id", "source_id", "page_index").distinct()
    f = m.groupBy("cluster_id").agg(F.min(F.struct("source_id", "page_index")).alias("f"))
    o = m.join(f, "cluster_id").filter("source_id <> f.source_id").select(F.col("f.source_id").alias("a"), F.col("source_id").alias("b"), (F.col("page_index") - F.col("f.page_index")).cast("long").alias("offset_pages"))
    n = o.groupBy("a", "b", "offset_pages").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("a", "b").orderBy(F.desc("n"), F.abs("offset_pages"), "offset_pages")
    return n.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


@query("""
WITH e AS (SELECT parameter_code AS p, method_used AS m, count(*) AS n FROM (""" + _EV + """) WHERE method_used IS NOT NULL GROUP BY ALL), c AS (SELECT p, m, n / sum(n) OVER (PARTITION BY p) AS conf FROM e)
SELECT p AS parameter_code, floor((1 - product(1 - conf)) * 1e6 + 0.5) / 1e6 AS score, count(*) AS methods FROM c GROUP BY 1""")
def evidence_aggregation(t: Tables) -> DataFrame:
    """K-22, A-16: confidences of several methods as one score."""
    e = current(t.spark, t.sf_dir, "passport_evidence", ["parameter_code", "method_used"]).filter(F.col("method_used").isNotNull())
    n = e.groupBy("parameter_code", "method_used").agg(F.count(F.lit(1)).alias("n"))
    c = n.withColumn("conf", F.col("n") / F.sum("n").over(Window.partitionBy("parameter_code")))
    return c.groupBy("parameter_code").agg(round6(1 - F.product(1 - F.col("conf"))).alias("score"), F.count(F.lit(1)).alias("methods"))


@query()
def quote_alignment(t: Tables) -> DataFrame:
    """J-23, X-23: how well each quote fits anywhere on its page."""
    p = current(t.spark, t.sf_dir, "pages", ["normalized_text"]).filter("normalized_text is not null").select("page_id", "normalized_text")
    e = current(t.spark, t.sf_dir, "passport_evidence", ["quote", "page_id"]).filter("quote is not null").select("ev_id", "page_id", "quote")
    return e.join(p, "page_id").select("ev_id", alignment(F.col("quote"), F.col("normalized_text")).alias("a")).select("ev_id", "a.distance", "a.ends")


@query("""
WITH p AS (SELECT table_id, row_no, min(n_numbers) AS v FROM (SELECT * FROM table_cells QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY created_at DESC NULLS LAST) = 1) WHERE n_numbers IS NOT NULL GROUP BY ALL), a AS (SELECT table_id, list(v ORDER BY row_no) AS v FROM p GROUP BY 1)
SELECT table_id, len(list_filter(v, lambda x: x = 0)) AS zeros FROM a""")
def zero_rows(t: Tables) -> DataFrame:
    """X-14: rows of a table without any number."""
    c = current(t.spark, t.sf_dir, "table_cells", ["table_id", "row_no", "n_numbers"]).filter("n_numbers is not null")
    return c.groupBy("table_id", "row_no").agg(F.min("n_numbers").alias("v")).groupBy("table_id").agg(F.count_if(F.col("v") == 0).alias("zeros"))


@query("""
WITH RECURSIVE o AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, o_totalprice AS v FROM orders),
r AS (SELECT k, i, v, 1 AS n FROM o UNION SELECT r.k, o.i, o.v, r.n + 1 FROM r JOIN o ON o.k = r.k AND o.i > r.i AND o.v >= r.v)
SELECT k AS o_custkey, max(n)::BIGINT AS longest FROM r GROUP BY 1""")
def ordered_stretch(t: Tables) -> DataFrame:
    """W-11: the longest non-decreasing run of amounts among each customer's orders, others between them left out."""
    lists = t.orders.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_totalprice"))), lambda s: s["o_totalprice"]).alias("v"))
    return lists.select("o_custkey", ordered_length(F.col("v")).cast("long").alias("longest"))


@query("""
WITH RECURSIVE s AS (SELECT n_regionkey AS k, s_suppkey AS a, c_nationkey AS b, s_acctbal AS score FROM (SELECT n_regionkey, s_suppkey, s_nationkey, s_acctbal FROM supplier JOIN nation ON n_nationkey = s_nationkey) JOIN (SELECT DISTINCT c_nationkey, n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey) ON r = n_regionkey),
l AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY score DESC, a::VARCHAR, b::VARCHAR) AS i, a, b, score FROM s),
m AS (SELECT k, 0::BIGINT AS i, []::VARCHAR[] AS used, NULL::VARCHAR AS a, NULL::VARCHAR AS b, NULL::DOUBLE AS score FROM (SELECT DISTINCT k FROM l) UNION ALL
 SELECT m.k, l.i, CASE WHEN list_contains(used, 'a' || l.a) OR list_contains(used, 'b' || l.b) THEN used ELSE used || ['a' || l.a, 'b' || l.b] END, CASE WHEN NOT (list_contains(used, 'a' || l.a) OR list_contains(used, 'b' || l.b)) THEN l.a::VARCHAR END, l.b::VARCHAR, l.score FROM m JOIN l ON l.k = m.k AND l.i = m.i + 1)
SELECT k AS regionkey, a, b, score FROM m WHERE a IS NOT NULL""")
def greedy_assignment(t: Tables) -> DataFrame:
    """J-22: within a region each supplier gets one nation with customers at most, the richest suppliers first."""
    n = t.nation.select("n_nationkey", "n_regionkey")
    a = t.supplier.join(n, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("n_regionkey").alias("k"), F.col("s_suppkey").cast("string").alias("a"), F.col("s_acctbal").alias("score"))
    b = t.customer.select("c_nationkey").distinct().join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_regionkey").alias("k"), F.col("c_nationkey").cast("string").alias("b"))
    # A region has few nations, so no more suppliers than that can be matched: the best of them suffice.
    best = Window.partitionBy("k").orderBy(F.desc("score"), "a")
    a = a.join(F.broadcast(b.groupBy("k").agg(F.count(F.lit(1)).alias("most"))), "k").withColumn("r", F.row_number().over(best)).filter("r <= most").drop("r", "most")
    lists = a.join(b, "k").groupBy("k").agg(F.collect_list(F.struct("score", "a", "b")).alias("c"))
    return lists.select(F.col("k").alias("regionkey"), F.explode(greedy_matching(F.col("c"))).alias("x")).select("regionkey", "x.a", "x.b", "x.score")


@query(r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '[0-9A-Za-z_.+-]+@[0-9A-Za-z_-]+\.[0-9A-Za-z_.]+', '[mail]', 'g'), '(?i)\b(key|token|secret|password)\s*[=:]\s*\S+', '[secret]', 'g'), '/(home|Users)/[^/\s]+', '[home]', 'g')) AS h
FROM (SELECT doc_id, text || ' ' || coalesce(source, '-') || '@site.org token=' || doc_id || ' /home/u' || doc_id || '/x' AS t FROM documents WHERE text IS NOT NULL)""")
def redacted_texts(t: Tables) -> DataFrame:
    """X-27: addresses, tokens and home folders, one of each put behind every text, come out."""
    shown = F.concat("text", F.lit(" "), F.coalesce("source", F.lit("-")), F.lit("@site.org token="), "doc_id", F.lit(" /home/u"), "doc_id", F.lit("/x"))
    return t.documents.filter("text is not null").select("doc_id", F.md5(X.redacted(shown)).alias("h"))
