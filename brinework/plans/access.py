"""Filters, pages, lookups, exports and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import filters, joins, order
from ..tables import current
from .catalog import Catalog, Tables

catalog = Catalog()
query = catalog.query
QUERIES, ORACLES = catalog.queries, catalog.oracles

_EV = "SELECT * FROM passport_evidence QUALIFY row_number() OVER (PARTITION BY ev_id ORDER BY recorded_at DESC NULLS LAST) = 1"


@query(f"""
SELECT ev_id FROM ({_EV}) WHERE parameter_code IN ('UCS', 'E_MOD', 'DENS') AND (origin IS NULL OR origin NOT IN ('UNKNOWN')) AND si_min BETWEEN 1 AND 1e9 AND coalesce(recorded_at <= TIMESTAMP '2024-06-30', true)""")
def compiled_filter(t: Tables) -> DataFrame:
    """PF-07, PF-11: typed filters compiled to one pushed-down condition."""
    e = current(t.spark, t.sf_dir, "passport_evidence", ["parameter_code", "origin", "si_min", "recorded_at"])
    kinds = {"parameter_code": "terms", "origin": "not_terms", "si_min": "range", "recorded_at": "available"}
    wanted = {"parameter_code": ["UCS", "E_MOD", "DENS"], "origin": ["UNKNOWN"], "si_min": (1, 1e9), "recorded_at": {"at": "2024-06-30", "unknown": "INCLUDE"}}
    return e.filter(filters.compiled(kinds, wanted)).select("ev_id")


@query("SELECT o_orderkey, o_totalprice, 3::BIGINT AS page FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 250 OFFSET 500")
def third_page(t: Tables) -> DataFrame:
    """PF-16, SC-25: the third page of 250 rows, reached by cursors that are bound to their query."""
    asked = {"table": "orders", "status": "F"}
    rows = t.orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    found, cursor = filters.page(rows, "o_orderkey", 250, asked)
    for _ in range(2):
        # Where pages end early the third one is empty.
        found, cursor = filters.page(rows, "o_orderkey", 250, asked, cursor) if cursor else (found.limit(0), None)
    return found.withColumn("page", F.lit(3).cast("long"))


@query("SELECT o_orderstatus, o_orderkey, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 250)::BIGINT AS page FROM orders")
def page_numbers(t: Tables) -> DataFrame:
    """SC-25: every row's page within its named list, numbered bucket by bucket."""
    rows = order.row_numbers(t.orders.select("o_orderstatus", "o_orderkey"), "o_orderkey", "place", "o_orderstatus")
    return rows.select("o_orderstatus", "o_orderkey", F.floor((F.col("place") - 1) / 250).alias("page"))


@query("""
WITH s AS (SELECT source_id, list_filter(string_split(regexp_replace(lower(coalesce(site_scope_raw, '')), '[^\\p{L}\\p{N}]+', '|', 'g'), '|'), lambda x: x <> '') AS scope, lang_code FROM sources), k AS (SELECT source_id, list_has_any(scope, ['skru', 'скру', 'ural', 'верх']) OR lang_code = 'de' AS kept FROM s)
SELECT source_id, coalesce(kept, false) AS kept FROM k""".replace("\\\\", "\\"))
def scope_filter(t: Tables) -> DataFrame:
    """PF-12: an area widened by named sources, and beside it those that the filter leaves out."""
    scope = F.array_remove(F.split(F.regexp_replace(F.lower(F.coalesce("site_scope_raw", F.lit(""))), r"[^\p{L}\p{N}]+", "|"), r"\|"), "")
    kept = F.arrays_overlap(scope, F.array(*map(F.lit, ("skru", "скру", "ural", "верх")))) | (F.col("lang_code") == "de")
    return t.sources.select("source_id", F.coalesce(kept, F.lit(False)).alias("kept"))


@query("""
WITH b AS (SELECT p_partkey AS id, (p_partkey % 40)::DOUBLE AS x0, (p_partkey % 30)::DOUBLE AS y0, p_partkey % 40 + p_size AS x1, p_partkey % 30 + p_size / 2.0 AS y1, p_partkey % 50 AS page FROM part)
SELECT a.id AS outer_id, b.id AS inner_id FROM b a JOIN b b ON a.page = b.page AND a.id <> b.id AND a.x0 <= b.x0 AND a.y0 <= b.y0 AND a.x1 >= b.x1 AND a.y1 >= b.y1""")
def boxes_within(t: Tables) -> DataFrame:
    """PF-13: boxes of a page that another box of it contains, by comparison of four columns."""
    k, size = F.col("p_partkey"), F.col("p_size")
    b = t.part.select(k.alias("id"), (k % 40).alias("x0"), (k % 30).alias("y0"), (k % 40 + size).alias("x1"), (k % 30 + size / 2.0).alias("y1"), (k % 50).alias("page"))
    return joins.contained_boxes(b, "id", "page")


@query("""
WITH RECURSIVE e AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey // 3 END AS needs FROM customer), h AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < -900), r AS (SELECT id FROM h UNION SELECT e.id FROM r JOIN e ON e.needs = r.id)
SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT id FROM r)""")
def visible_records(t: Tables) -> DataFrame:
    """PF-14: what is hidden hides all that depends on it, directly or through others; the rest is visible."""
    c = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 != 0, F.floor(F.col("c_custkey") / 3)).alias("needs"), "c_acctbal")
    hidden = c.filter("c_acctbal < -900").select("id")
    far = joins.closure(t.spark, c.filter("needs is not null").select("id", "needs"), "id", "needs")
    reached = far.join(hidden.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    return c.select("id").join(hidden.unionByName(reached).distinct(), "id", "left_anti")


@query(r"""
WITH n AS (SELECT c_custkey, lower(regexp_replace(c_name, '[^\p{L}\p{N}]+', ' ', 'g')) AS n FROM customer), k AS (SELECT c_custkey, string_split(n, ' ')[1] AS family, string_split(n, ' ')[2][1:4] AS initials FROM n)
SELECT family, initials, count(*) AS n, min(c_custkey) AS first FROM k GROUP BY ALL HAVING count(*) > 1""")
def name_clusters(t: Tables) -> DataFrame:
    """PF-17, X-21: names of one family and the same beginning stand together, as a lookup by author asks for them."""
    parts = F.split(F.lower(F.regexp_replace("c_name", r"[^\p{L}\p{N}]+", " ")), " ")
    k = t.customer.select("c_custkey", F.get(parts, 0).alias("family"), F.substring(F.get(parts, 1), 1, 4).alias("initials"))
    return k.groupBy("family", "initials").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first")).filter("n > 1")


@query(f"""
WITH e AS ({_EV}), d AS (SELECT parameter_code, scale, count(*) AS n FROM e WHERE parameter_code IS NOT NULL GROUP BY ALL), m AS (SELECT parameter_code, scale AS usual FROM d QUALIFY row_number() OVER (PARTITION BY parameter_code ORDER BY n DESC, scale NULLS LAST) = 1)
SELECT ev_id, CASE WHEN scale IS DISTINCT FROM usual THEN coalesce(scale, '(none)') END AS own_scale FROM e JOIN m USING (parameter_code)""")
def brief_records(t: Tables) -> DataFrame:
    """PF-18: the usual value of a group is said once, records show only what differs from it."""
    e = current(t.spark, t.sf_dir, "passport_evidence", ["parameter_code", "scale"]).filter("parameter_code is not null").select("ev_id", "parameter_code", "scale")
    d = e.groupBy("parameter_code", "scale").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("parameter_code").orderBy(F.desc("n"), F.asc_nulls_last("scale"))
    usual = d.withColumn("r", F.row_number().over(best)).filter("r = 1").select("parameter_code", F.col("scale").alias("usual"))
    return e.join(usual, "parameter_code").select("ev_id", F.when(~F.col("scale").eqNullSafe(F.col("usual")), F.coalesce("scale", F.lit("(none)"))).alias("own_scale"))


@query("SELECT kind, 'members' AS what, count(*) AS n FROM nav_dup_members GROUP BY 1 UNION ALL SELECT kind, 'clusters', count(DISTINCT cluster_id) FROM nav_dup_members GROUP BY 1")
def receipt_counts(t: Tables) -> DataFrame:
    """A-21: what a run reports of its result."""
    g = t.nav_dup_members.groupBy("kind").agg(F.count(F.lit(1)).alias("members"), F.count_distinct("cluster_id").alias("clusters"))
    return g.unpivot("kind", ["members", "clusters"], "what", "n")


@query("""
SELECT event_type, floor(sum(round(value * 16777216)::BIGINT) / 16777216 * 1e4 + 0.5) / 1e4 AS total FROM events GROUP BY 1""")
def totals_per_class(t: Tables) -> DataFrame:
    """A-24: totals per class; ``class_totals`` refuses a sum over classes."""
    return class_totals(t.events, "event_type", "value")


def class_totals(rows: DataFrame, by: str | None, value: str) -> DataFrame:
    if not by:
        raise ValueError("values of several classes have no common total")
    total = F.sum(F.round(F.col(value) * float(1 << 24)).cast("long")) / float(1 << 24)
    return rows.groupBy(by).agg((F.floor(total * 1e4 + 0.5) / 1e4).alias("total"))


@query("""
SELECT 0 AS kind, count(*)::VARCHAR || ' ' || count(s_acctbal)::VARCHAR || ' ' || count(DISTINCT s_suppkey)::VARCHAR AS line, 0::BIGINT AS place FROM supplier UNION ALL SELECT 1, s_suppkey::VARCHAR || ' ' || s_name, row_number() OVER (ORDER BY s_suppkey) FROM supplier
UNION ALL SELECT 2, count(*)::VARCHAR || ' ' || bit_xor(('0x' || md5(s_suppkey::VARCHAR || ' ' || s_name)[1:12])::BIGINT)::VARCHAR, count(*) + 1 FROM supplier""")
def sealed_export(t: Tables) -> DataFrame:
    """SC-12: a census before, the rows in order, and a seal behind them that an aborted export lacks."""
    s = t.supplier.select(F.col("s_suppkey").alias("k"), F.concat_ws(" ", F.col("s_suppkey").cast("string"), "s_name").alias("line"), "s_acctbal")
    text = lambda *c: F.concat_ws(" ", *(x.cast("string") for x in c))
    n = F.count(F.lit(1))
    head = s.agg(text(n, F.count("s_acctbal"), F.count_distinct("k")).alias("line")).select(F.lit(0).alias("kind"), "line", F.lit(0).cast("long").alias("place"))
    rows = order.row_numbers(s, "k", "place").select(F.lit(1).alias("kind"), "line", "place")
    seal = s.agg(text(n, F.bit_xor(F.conv(F.substring(F.md5("line"), 1, 12), 16, 10).cast("long"))).alias("line"), (n + 1).alias("place")).select(F.lit(2).alias("kind"), "line", "place")
    return head.unionByName(rows).unionByName(seal)


@query("""
WITH held AS (SELECT s_suppkey AS k, s_name AS v FROM supplier WHERE s_suppkey % 3 = 0), batch AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 12 = 0 THEN 'other' ELSE s_name END AS v FROM supplier WHERE s_suppkey % 2 = 0)
SELECT b.k, CASE WHEN h.k IS NULL THEN 'INSERTED' WHEN h.v = b.v THEN 'UNCHANGED' ELSE 'CONFLICT' END AS outcome FROM batch b LEFT JOIN held h USING (k)""")
def keyed_apply(t: Tables) -> DataFrame:
    """SC-24: rows applied by key: new ones go in, equal ones are no change, others are a conflict."""
    s = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    held = s.filter("k % 3 = 0").withColumnRenamed("v", "h")
    batch = s.filter("k % 2 = 0").withColumn("v", F.when(F.col("k") % 12 == 0, "other").otherwise(F.col("v")))
    return batch.join(held, "k", "left").select("k", F.when(F.col("h").isNull(), "INSERTED").when(F.col("h") == F.col("v"), "UNCHANGED").otherwise("CONFLICT").alias("outcome"))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY 1")
def bound_select(t: Tables) -> DataFrame:
    """UD-04: a named SELECT that may read its bound views only."""
    sql = "SELECT l_returnflag, count(*) AS n FROM lines JOIN heads ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY l_returnflag"
    return filters.named_select(t.spark, {"lines": t.lineitem.select("l_orderkey", "l_returnflag"), "heads": t.orders.select("o_orderkey", "o_orderstatus")}, sql, 100)


@query("""
WITH j AS (SELECT event_id, user_id, ts, event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS renewed FROM events), q AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 'DONE' WHEN event_type = 'error' THEN 'FAILED' WHEN renewed <= ts + INTERVAL 1 HOUR THEN 'LEASED' ELSE 'OPEN' END AS state FROM j)
SELECT event_id AS claimed, user_id FROM q WHERE state = 'OPEN' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""")
def queue_claims(t: Tables) -> DataFrame:
    """ST-04: of each queue the oldest job that is neither done nor failed nor under a lease renewed within the hour."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    j = t.events.withColumn("renewed", F.lead("ts").over(w))
    state = F.when(F.col("event_type") == "purchase", "DONE").when(F.col("event_type") == "error", "FAILED").when(F.col("renewed") <= F.col("ts") + F.expr("interval 1 hour"), "LEASED").otherwise("OPEN")
    return j.filter(state == "OPEN").withColumn("r", F.row_number().over(w)).filter("r = 1").select(F.col("event_id").alias("claimed"), "user_id")


@query("SELECT event_type, count(*) FILTER (WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR) AS last_day, count(*) FILTER (WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY) AS last_week FROM events GROUP BY 1")
def recent_counts(t: Tables) -> DataFrame:
    """ST-07: counters of the last hours, counted back from the newest event."""
    now = t.events.agg(F.max("ts").alias("now"))
    e = t.events.select("event_type", "ts").crossJoin(F.broadcast(now))
    within = lambda span: F.count_if(F.col("ts") > F.col("now") - F.expr(f"interval {span}"))
    return e.groupBy("event_type").agg(within("24 hours").alias("last_day"), within("7 days").alias("last_week"))


@query("""
WITH s AS (SELECT user_id, event_type, count(*) AS n, max(ts) AS last FROM events GROUP BY ALL) SELECT user_id, sum(n)::BIGINT AS steps, coalesce(sum(n) FILTER (WHERE event_type = 'error'), 0)::BIGINT AS errors, arg_max(event_type, (last, event_type)) AS state FROM s GROUP BY 1""")
def run_status(t: Tables) -> DataFrame:
    """F-19: steps and errors of each run and the state it is in."""
    s = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    return s.groupBy("user_id").agg(F.sum("n").alias("steps"), F.coalesce(F.sum(F.when(F.col("event_type") == "error", F.col("n"))), F.lit(0)).alias("errors"), F.max_by("event_type", F.struct("last", "event_type")).alias("state"))
