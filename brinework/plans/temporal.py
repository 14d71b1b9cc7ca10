"""Times, intervals, folds and scores (F- and W-families)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import round6
from ..tables import current
from .catalog import Catalog, Tables

catalog = Catalog()
query = catalog.query
QUERIES, ORACLES = catalog.queries, catalog.oracles


@query("""
SELECT ev_id, recorded_at::DATE AS day FROM passport_evidence WHERE recorded_at <= TIMESTAMP '2023-09-01' AND ev_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ev_id ORDER BY recorded_at DESC, md5(coalesce(si_min::VARCHAR, ''))) = 1""")
def records_at(t: Tables) -> DataFrame:
    """F-01: the state of a journal at a time."""
    rows = t.passport_evidence.filter("recorded_at <= timestamp_ntz'2023-09-01' and ev_id is not null")
    return rows.groupBy("ev_id").agg(F.max("recorded_at").alias("r")).select("ev_id", F.col("r").cast("date").alias("day"))


@query("""
WITH p AS (SELECT o_orderkey, o_orderdate::DATE AS d, CASE o_orderkey % 4 WHEN 0 THEN 'DAY' WHEN 1 THEN 'MONTH' WHEN 2 THEN 'YEAR' ELSE 'DECADE' END AS precision FROM orders)
SELECT o_orderkey, CASE precision WHEN 'DAY' THEN d WHEN 'MONTH' THEN last_day(d) WHEN 'YEAR' THEN make_date(year(d), 12, 31) ELSE make_date(year(d) - year(d) % 10 + 9, 12, 31) END AS latest FROM p""")
def availability_latest_day(t: Tables) -> DataFrame:
    """F-05, X-29: the latest day a date of given precision can mean."""
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 4
    year = F.year(d)
    latest = F.when(k == 0, d).when(k == 1, F.last_day(d)).when(k == 2, F.make_date(year, F.lit(12), F.lit(31))).otherwise(F.make_date(year - year % 10 + 9, F.lit(12), F.lit(31)))
    return t.orders.select("o_orderkey", latest.alias("latest"))


@query("""
WITH s AS (SELECT ev_id, count(DISTINCT recorded_at::DATE) AS days, min(recorded_at)::DATE AS first_day, max(recorded_at)::DATE AS last_day FROM passport_evidence GROUP BY 1)
SELECT ev_id, days > 1 AS conflict, last_day AS available FROM s""")
def conservative_availability(t: Tables) -> DataFrame:
    """F-02: dates that differ are a conflict, and the latest holds."""
    day = F.col("recorded_at").cast("date")
    return t.passport_evidence.groupBy("ev_id").agg((F.count_distinct(day) > 1).alias("conflict"), F.max(day).alias("available"))


@query("""
WITH i AS (SELECT o_custkey AS k, o_orderdate::DATE AS s, o_orderdate::DATE + 45 AS e FROM orders), m AS (SELECT k, s, e, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT k, g::BIGINT AS g, min(s) AS s, max(e) AS e, count(*) AS n FROM g GROUP BY k, g""")
def interval_union(t: Tables) -> DataFrame:
    """W-12, F-08: overlapping intervals merged."""
    i = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("s"), F.date_add(F.col("o_orderdate").cast("date"), 45).alias("e"))
    w = Window.partitionBy("k").orderBy("s", "e")
    i = i.withColumn("before", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    i = i.withColumn("g", F.sum(F.when(F.col("before").isNull() | (F.col("s") > F.col("before")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return i.groupBy("k", "g").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("n"))


@query("""
WITH p AS (SELECT DISTINCT source_id, page_index FROM pages), g AS (SELECT source_id, page_index, page_index - row_number() OVER (PARTITION BY source_id ORDER BY page_index) AS island FROM p)
SELECT source_id, min(page_index)::BIGINT AS first_page, max(page_index)::BIGINT AS last_page, count(*) AS n FROM g GROUP BY source_id, island""")
def index_runs(t: Tables) -> DataFrame:
    """W-13: consecutive page numbers as runs."""
    p = t.pages.select("source_id", "page_index").distinct()
    island = F.col("page_index") - F.row_number().over(Window.partitionBy("source_id").orderBy("page_index"))
    return p.withColumn("island", island).groupBy("source_id", "island").agg(F.min("page_index").cast("long").alias("first_page"), F.max("page_index").cast("long").alias("last_page"), F.count(F.lit(1)).alias("n")).drop("island")


_SPANS = "s AS (SELECT o_custkey AS k, min(year(o_orderdate)) AS start_min, min(year(o_orderdate)) + 1 AS start_max, max(year(o_orderdate)) - 1 AS end_min, max(year(o_orderdate)) AS end_max FROM orders GROUP BY 1)"


def _spans(t: Tables) -> DataFrame:
    y = F.year("o_orderdate")
    return t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.min(y).alias("start_min"), (F.min(y) + 1).alias("start_max"), (F.max(y) - 1).alias("end_min"), F.max(y).alias("end_max"))


@query(f"WITH {_SPANS}, d AS (SELECT unnest([1990, 2000]) AS d) SELECT k, d::BIGINT AS decade, CASE WHEN start_max <= end_min AND start_max <= d + 9 AND end_min >= d THEN 'ACTIVE' WHEN start_min <= d + 9 AND end_max >= d THEN 'POSSIBLE' ELSE 'NO' END AS state FROM s, d")
def decade_state(t: Tables) -> DataFrame:
    """F-06, F-07: certain core and possible envelope against a decade."""
    s = _spans(t).withColumn("d", F.explode(F.array(F.lit(1990), F.lit(2000))))
    core = (F.col("start_max") <= F.col("end_min")) & (F.col("start_max") <= F.col("d") + 9) & (F.col("end_min") >= F.col("d"))
    state = F.when(core, "ACTIVE").when((F.col("start_min") <= F.col("d") + 9) & (F.col("end_max") >= F.col("d")), "POSSIBLE").otherwise("NO")
    return s.select("k", F.col("d").cast("long").alias("decade"), state.alias("state"))


@query(f"WITH {_SPANS}, c AS (SELECT k % 20 AS g, min(start_min)::BIGINT AS lo, max(end_max)::BIGINT AS hi, max(start_min) > min(end_max) AS conflict FROM s GROUP BY 1) SELECT * FROM c")
def interval_envelope(t: Tables) -> DataFrame:
    """F-06: joint envelope; two envelopes are apart exactly when one starts after another ends."""
    return _spans(t).groupBy((F.col("k") % 20).alias("g")).agg(F.min("start_min").cast("long").alias("lo"), F.max("end_max").cast("long").alias("hi"), (F.max("start_min") > F.min("end_max")).alias("conflict"))


@query("""
WITH d AS (SELECT DISTINCT date_trunc('quarter', o_orderdate)::DATE AS d FROM orders), c AS (SELECT d, row_number() OVER (ORDER BY d) AS n FROM d), k AS (SELECT d FROM c WHERE n >= 5 ORDER BY d DESC LIMIT 5)
SELECT k.d AS cut, count(*) FILTER (WHERE o_orderdate::DATE <= k.d) AS train, count(*) FILTER (WHERE date_trunc('quarter', o_orderdate)::DATE = k.d) AS validation FROM orders, k GROUP BY 1""")
def rolling_origin_folds(t: Tables) -> DataFrame:
    """W-15, F-09: the last five cuts with four earlier dates or more; counted per day first, so the cut list meets days, not rows."""
    day = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    day = day.withColumn("q", F.trunc("day", "quarter"))
    cuts = day.select(F.col("q").alias("cut")).distinct().withColumn("i", F.row_number().over(Window.orderBy("cut"))).filter("i >= 5").orderBy(F.desc("cut")).limit(5).select("cut")
    j = day.crossJoin(F.broadcast(cuts))
    return j.groupBy("cut").agg(F.sum(F.when(F.col("day") <= F.col("cut"), F.col("n")).otherwise(0)).alias("train"), F.sum(F.when(F.col("q") == F.col("cut"), F.col("n")).otherwise(0)).alias("validation"))


@query("""
WITH c AS (SELECT c_nationkey AS g, count(*) AS n FROM customer GROUP BY 1) SELECT g::BIGINT AS fold, n AS validation, (SELECT sum(n) FROM c)::BIGINT - n AS train FROM c""")
def leave_one_group_out(t: Tables) -> DataFrame:
    """F-09: from the group sizes alone."""
    c = t.customer.groupBy(F.col("c_nationkey").cast("long").alias("fold")).agg(F.count(F.lit(1)).alias("validation"))
    total = c.agg(F.sum("validation").alias("total"))
    return c.crossJoin(F.broadcast(total)).select("fold", "validation", (F.col("total") - F.col("validation")).alias("train"))


@query("""
SELECT a.o_orderkey, b.o_orderdate::DATE AS target, b.o_orderkey IS NULL AS censored FROM (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE) AS r FROM orders) a
LEFT JOIN (SELECT o_custkey, o_orderdate, r, min(o_orderkey) AS o_orderkey FROM (SELECT o_custkey, o_orderdate::DATE AS o_orderdate, o_orderkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE) AS r FROM orders) GROUP BY ALL) b ON a.o_custkey = b.o_custkey AND b.r = a.r + 2""")
def planned_target(t: Tables) -> DataFrame:
    """W-14: the second date strictly after the origin; censored where there is none."""
    day = F.col("o_orderdate").cast("date")
    dates = t.orders.select("o_custkey", day.alias("d")).distinct().withColumn("target", F.lead("d", 2).over(Window.partitionBy("o_custkey").orderBy("d")))
    return t.orders.select("o_orderkey", "o_custkey", day.alias("d")).join(dates, ["o_custkey", "d"]).select("o_orderkey", "target", F.col("target").isNull().alias("censored"))


_PRED = "p AS (SELECT l_returnflag AS g, l_extendedprice AS y, p_retailprice * l_quantity AS m, p_retailprice * l_quantity * 0.8 AS l, p_retailprice * l_quantity * 1.2 AS u FROM lineitem JOIN part ON p_partkey = l_partkey)"
_GRID = "floor(sum(round(({}) * 1024)::HUGEINT)::DOUBLE / 1024 / count(*) * 1e3 + 0.5) / 1e3"


def _predicted(t: Tables) -> DataFrame:
    m = F.col("p_retailprice") * F.col("l_quantity")
    return t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("y"), m.alias("m"), (m * 0.8).alias("l"), (m * 1.2).alias("u"))


def _mean3(x):
    """Mean on a grid of 1/1024, to three places: the same in any order."""
    return F.floor(F.sum(F.round(x * 1024).cast("decimal(38,0)")).cast("double") / 1024 / F.count(F.lit(1)) * 1e3 + 0.5) / 1e3


@query(f"WITH {_PRED} SELECT g, count(*) AS n, {_GRID.format('abs(y - m)')} AS mae, {_GRID.format('y - m')} AS bias, floor(avg(CASE WHEN y BETWEEN l AND u THEN 1.0::DOUBLE ELSE 0 END) * 1e6 + 0.5) / 1e6 AS coverage FROM p GROUP BY 1")
def point_metrics(t: Tables) -> DataFrame:
    """F-10, A-14: error, bias and coverage per stratum (F-12)."""
    y, m = F.col("y"), F.col("m")
    return _predicted(t).groupBy("g").agg(F.count(F.lit(1)).alias("n"), _mean3(F.abs(y - m)).alias("mae"), _mean3(y - m).alias("bias"), round6(F.avg(F.when(y.between(F.col("l"), F.col("u")), 1.0).otherwise(0.0))).alias("coverage"))


@query(f"WITH {_PRED} SELECT g, {_GRID.format('(u - l) + 20 * greatest(l - y, 0) + 20 * greatest(y - u, 0)')} AS interval_score, {_GRID.format('(0.5 * abs(y - m) + 0.05 * ((u - l) + 20 * greatest(l - y, 0) + 20 * greatest(y - u, 0))) / 1.5')} AS wis FROM p GROUP BY 1")
def interval_scores(t: Tables) -> DataFrame:
    """F-10: interval score at 0.1, and the weighted score of one interval and the median."""
    y, l, u, m = (F.col(c) for c in ("y", "l", "u", "m"))  # noqa: E741
    score = (u - l) + 20 * F.greatest(l - y, F.lit(0.0)) + 20 * F.greatest(y - u, F.lit(0.0))
    return _predicted(t).groupBy("g").agg(_mean3(score).alias("interval_score"), _mean3((0.5 * F.abs(y - m) + 0.05 * score) / 1.5).alias("wis"))


@query(f"WITH {_PRED}, e AS (SELECT g, abs(y - m) AS r, row_number() OVER (PARTITION BY g ORDER BY abs(y - m)) AS i, count(*) OVER (PARTITION BY g) AS n FROM p) SELECT g, floor(max(r) FILTER (WHERE i = ceil((n + 1) * 0.9)) * 1e3 + 0.5) / 1e3 AS quantile FROM e GROUP BY 1")
def conformal_quantile(t: Tables) -> DataFrame:
    """F-10: the ceil((n + 1) c)-th smallest residual. Residuals are counted by value first, so no group is sorted whole."""
    r = _predicted(t).groupBy("g", F.abs(F.col("y") - F.col("m")).alias("r")).agg(F.count(F.lit(1)).alias("k"))
    n = r.groupBy("g").agg(F.ceil((F.sum("k") + 1) * 0.9).alias("at"))
    upto = r.withColumn("upto", F.sum("k").over(Window.partitionBy("g").orderBy("r")))
    return upto.join(F.broadcast(n), "g").filter("upto >= at").groupBy("g").agg((F.floor(F.min("r") * 1e3 + 0.5) / 1e3).alias("quantile"))


@query("""
WITH c AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS k FROM lineitem GROUP BY 1)
SELECT l_suppkey, floor(((k / n + 1.9208 / n) - 1.96 * sqrt((k / n) * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n) * 1e6 + 0.5) / 1e6 AS low, floor(((k / n + 1.9208 / n) + 1.96 * sqrt((k / n) * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n) * 1e6 + 0.5) / 1e6 AS high FROM c""")
def wilson(t: Tables) -> DataFrame:
    """F-11: Wilson interval of a share."""
    c = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    p, n = F.col("k") / F.col("n"), F.col("n")
    mid, half = p + 1.9208 / n, 1.96 * F.sqrt(p * (1 - p) / n + 0.9604 / (n * n))
    return c.select("l_suppkey", round6((mid - half) / (1 + 3.8416 / n)).alias("low"), round6((mid + half) / (1 + 3.8416 / n)).alias("high"))


@query("""
WITH x AS (SELECT l_suppkey AS k, l_orderkey % 7 AS ens, avg(l_quantity) AS v FROM lineitem GROUP BY ALL), y AS (SELECT k, avg(v) AS obs FROM x GROUP BY 1),
a AS (SELECT k, avg(abs(v - obs)) AS a FROM x JOIN y USING (k) GROUP BY 1), b AS (SELECT x.k, sum(abs(x.v - z.v)) / 2 / (count(DISTINCT x.ens) * count(DISTINCT x.ens)) AS b FROM x JOIN x z ON x.k = z.k GROUP BY 1)
SELECT k, floor((a - b) * 1e4 + 0.5) / 1e4 AS crps FROM a JOIN b USING (k)""")
def crps_ensemble(t: Tables) -> DataFrame:
    """F-10: an ensemble has at most seven members here; its pairs are taken inside the row."""
    x = t.lineitem.groupBy(F.col("l_suppkey").alias("k"), (F.col("l_orderkey") % 7).alias("ens")).agg(F.avg("l_quantity").alias("v"))
    e = x.groupBy("k").agg(F.array_sort(F.collect_list("v")).alias("v"), F.avg("v").alias("obs"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, z: s + z)
    a = total(F.zip_with("v", F.array_repeat("obs", F.size("v")), lambda z, o: F.abs(z - o))) / F.size("v")
    b = total(F.flatten(F.transform("v", lambda p: F.transform("v", lambda q: F.abs(p - q))))) / 2 / (F.size("v") * F.size("v"))
    return e.select("k", (F.floor((a - b) * 1e4 + 0.5) / 1e4).alias("crps"))


@query("""
SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n, floor(sum(round(value * 1024)::BIGINT)::DOUBLE / 1024 * 1e3 + 0.5) / 1e3 AS total FROM events GROUP BY ALL""")
def tumbling_windows(t: Tables) -> DataFrame:
    """An extension: tumbling windows of a day (``streaming.windows`` has the same over a stream)."""
    return t.events.groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), (F.floor(F.sum(F.round(F.col("value") * 1024).cast("long")) / 1024 * 1e3 + 0.5) / 1e3).alias("total")).select("user_id", F.col("w.start").alias("day"), "n", "total")


@query("""
WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS f FROM events),
s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def session_windows(t: Tables) -> DataFrame:
    """An extension: sessions that end after six quiet hours."""
    return t.events.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("""
WITH c AS (SELECT * FROM passport_evidence QUALIFY row_number() OVER (PARTITION BY ev_id ORDER BY recorded_at DESC NULLS LAST) = 1)
SELECT parameter_code, count(*) AS n, count(si_min) AS with_low, min(si_min) AS lo, max(si_max) AS hi, count(*) FILTER (WHERE si_min IS NULL AND si_max IS NULL) AS without FROM c GROUP BY 1""")
def parameter_summary(t: Tables) -> DataFrame:
    """K-25, A-15."""
    c = current(t.spark, t.sf_dir, "passport_evidence", ["parameter_code", "si_min", "si_max"])
    return c.groupBy("parameter_code").agg(F.count(F.lit(1)).alias("n"), F.count("si_min").alias("with_low"), F.min("si_min").alias("lo"), F.max("si_max").alias("hi"), F.count_if(F.col("si_min").isNull() & F.col("si_max").isNull()).alias("without"))


@query("""
WITH c AS (SELECT * FROM passport_evidence QUALIFY row_number() OVER (PARTITION BY ev_id ORDER BY recorded_at DESC NULLS LAST) = 1)
SELECT parameter_code, si_min, si_max, count(*) AS records, count(DISTINCT source_id) AS sources, min(ev_id) AS first_id FROM c WHERE si_min IS NOT NULL AND si_max IS NOT NULL GROUP BY ALL HAVING count(*) > 1""")
def equal_number_clusters(t: Tables) -> DataFrame:
    """F-13, F-14: records of one parameter and equal bounds."""
    c = current(t.spark, t.sf_dir, "passport_evidence", ["parameter_code", "si_min", "si_max", "source_id"]).filter("si_min is not null and si_max is not null")
    return c.groupBy("parameter_code", "si_min", "si_max").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("source_id").alias("sources"), F.min("ev_id").alias("first_id")).filter("records > 1")


@query("""
SELECT a.event_id, floor((sum(b.value / (1 + abs(b.event_id - a.event_id))) / sum(1.0::DOUBLE / (1 + abs(b.event_id - a.event_id)))) * 1e4 + 0.5) / 1e4 AS idw FROM (SELECT * FROM events WHERE event_id % 20 = 0) a JOIN events b ON a.user_id = b.user_id AND a.event_id <> b.event_id GROUP BY 1""")
def inverse_distance(t: Tables) -> DataFrame:
    """F-16: weighted by distance inside a group, for the stated rows."""
    a = t.events.filter("event_id % 20 = 0").select(F.col("event_id").alias("a"), "user_id")
    j = a.join(t.events.select("user_id", F.col("event_id").alias("b"), "value"), "user_id").filter("a <> b")
    w = 1 / (1 + F.abs(F.col("b") - F.col("a")))
    return j.groupBy(F.col("a").alias("event_id")).agg((F.floor(F.sum(F.col("value") * w) / F.sum(w) * 1e4 + 0.5) / 1e4).alias("idw"))
