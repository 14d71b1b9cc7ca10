"""Staged search over documents, and rules on records of observations and histories."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.common import round6
from ..operators import joins, retrieval
from ..tables import current
from .catalog import Catalog, Tables
from .vectors import _DENSE, _SHORT, _dense, _short

catalog = Catalog()
query = catalog.query
QUERIES, ORACLES = catalog.queries, catalog.oracles

_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
_EV = "SELECT * FROM passport_evidence QUALIFY row_number() OVER (PARTITION BY ev_id ORDER BY recorded_at DESC NULLS LAST) = 1"


def _bm25_sql(name: str, words: str, k: int) -> str:
    """CTEs that rank by BM25 over the word lists of a relation dw(doc_id, title, body)."""
    return f"""{name}_p AS (SELECT doc_id, len({words}) AS dl, term, count(*) AS tf FROM (SELECT doc_id, {words}, unnest({words}) AS term FROM dw) GROUP BY ALL), {name}_n AS (SELECT count(*) AS n, avg(len({words})) AS avgdl FROM dw), {name}_df AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY 1),
{name}_s AS (SELECT qid, p.doc_id AS doc, floor(sum(floor(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) * 16777216 + 0.5)) / 16777216 * 1e4 + 0.5) / 1e4 AS score FROM q JOIN {name}_p p USING (term) JOIN {name}_df USING (term), {name}_n WHERE p.doc_id <> qid GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM {name}_s QUALIFY rank <= {k})"""


_FIELDS = f"dw AS (SELECT doc_id, {_WORDS} AS body, {_WORDS}[1:8] AS title FROM documents WHERE text IS NOT NULL), q AS (SELECT doc_id AS qid, unnest(list_distinct(title)) AS term FROM dw WHERE doc_id % 20 = 0)"


def _fields(t: Tables) -> DataFrame:
    w = t.documents.filter("text is not null").select("doc_id", X.words(F.col("text")).alias("body"))
    return w.withColumn("title", F.slice("body", 1, 8))


def _asked(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), F.col("title").alias("terms"))


@query(f"""WITH {_FIELDS}, {_bm25_sql('a', 'title', 50)}, {_bm25_sql('b', 'body', 50)}, m AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.doc, b.doc) AS doc, coalesce(a.score, 0) * 2 AS x, coalesce(b.score, 0) AS y FROM a FULL JOIN b ON a.qid = b.qid AND a.doc = b.doc),
f AS (SELECT qid, doc, floor((greatest(x, y) + 0.2 * least(x, y) + CASE WHEN contains(' ' || array_to_string(d.body, ' ') || ' ', ' ' || array_to_string(o.title[1:3], ' ') || ' ') THEN 1 ELSE 0 END) * 1e4 + 0.5) / 1e4 AS score FROM m JOIN dw d ON d.doc_id = doc JOIN dw o ON o.doc_id = qid)
SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM f QUALIFY rank <= 10""")
def best_fields(t: Tables) -> DataFrame:
    """R-02: two fields ranked apart; the better score and a fifth of the other, a boost where the first words stand as a phrase."""
    d = _fields(t)
    leg = lambda field, name: retrieval.bm25(d, "doc_id", field, _asked(d), 50, places=1e4).select("qid", "doc", F.col("score").alias(name))
    m = leg("title", "x").join(leg("body", "y"), ["qid", "doc"], "full").select("qid", "doc", (F.coalesce("x", F.lit(0.0)) * 2).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    spaced = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    j = m.join(d.select(F.col("doc_id").alias("doc"), spaced(F.col("body")).alias("whole")), "doc").join(d.select(F.col("doc_id").alias("qid"), spaced(F.slice("title", 1, 3)).alias("phrase")), "qid")
    total = F.greatest("x", "y") + 0.2 * F.least("x", "y") + F.when(F.contains("whole", "phrase"), 1.0).otherwise(0.0)
    s = j.select("qid", "doc", (F.floor(total * 1e4 + 0.5) / 1e4).alias("score"))
    return retrieval.ranked(s, k=10).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_FIELDS.replace('q AS', 'q0 AS')}, {_DENSE.replace('WITH ', '')}, {_SHORT}, r1 AS (SELECT qid, doc, rank FROM dense WHERE rank <= 30), r2 AS (SELECT qid, doc, rank FROM short WHERE rank <= 30),
f AS (SELECT coalesce(r1.qid, r2.qid) AS qid, coalesce(r1.doc, r2.doc) AS doc, r1.rank AS dense_rank_, r2.rank AS short_rank_, floor((coalesce(1.0 / (60 + r1.rank), 0) + coalesce(0.5 / (60 + r2.rank), 0)) * 1e9 + 0.5) AS s FROM r1 FULL JOIN r2 ON r1.qid = r2.qid AND r1.doc = r2.doc),
g AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, doc) AS fused FROM f QUALIFY fused <= 20), h AS (SELECT g.*, label, row_number() OVER (PARTITION BY g.qid, label ORDER BY fused) AS inside FROM g JOIN embeddings ON vec_id = doc)
SELECT qid, doc, dense_rank_ AS dense, short_rank_ AS short, fused, row_number() OVER (PARTITION BY qid ORDER BY (inside - 1) // 3, fused) AS final FROM h""")
def traced_search(t: Tables) -> DataFrame:
    """R-11, T-05: fusion, then no more than three of a group per round; each stage leaves its rank beside the result."""
    a, b = _dense(t, 30).select("qid", "doc", F.col("rank").alias("dense")), _short(t, 30).select("qid", "doc", F.col("rank").alias("short"))
    s = F.floor((F.coalesce(1.0 / (60 + F.col("dense")), F.lit(0.0)) + F.coalesce(0.5 / (60 + F.col("short")), F.lit(0.0))) * 1e9 + 0.5)
    order = lambda *c: F.row_number().over(Window.partitionBy("qid").orderBy(*c)).cast("long")
    g = a.join(b, ["qid", "doc"], "full").withColumn("fused", order(s.desc(), "doc")).filter("fused <= 20")
    h = g.join(t.embeddings.select(F.col("vec_id").alias("doc"), "label"), "doc").withColumn("inside", F.row_number().over(Window.partitionBy("qid", "label").orderBy("fused")))
    return h.select("qid", "doc", "dense", "short", "fused", order(F.floor((F.col("inside") - 1) / 3), "fused").alias("final"))


@query("""
WITH o AS (SELECT object_id, page_id, coalesce(label, '') AS label, row_number() OVER (PARTITION BY page_id, coalesce(label, '') ORDER BY is_reference DESC NULLS LAST, object_id) AS r FROM (SELECT object_id, page_id, label, bool_or(is_reference) AS is_reference FROM object_dup_members WHERE page_id IS NOT NULL AND object_type = 'FIGURE' GROUP BY ALL))
SELECT page_id, label, count(*) AS fragments, max(CASE WHEN r = 1 THEN object_id END) AS shown FROM o GROUP BY 1, 2""")
def figure_fragments(t: Tables) -> DataFrame:
    """R-18: figures of one page under one label are shown as one."""
    o = t.object_dup_members.filter("page_id is not null and object_type = 'FIGURE'").groupBy("object_id", "page_id", F.coalesce("label", F.lit("")).alias("label")).agg(F.bool_or("is_reference").alias("ref"))
    first = F.min_by("object_id", F.struct((~F.coalesce("ref", F.lit(False))).alias("a"), "object_id"))
    return o.groupBy("page_id", "label").agg(F.count(F.lit(1)).alias("fragments"), first.alias("shown"))


@query(rf"""
WITH e AS ({_EV}), w AS (SELECT ev_id, parameter_code, recorded_at, length(quote) AS size, CASE WHEN quote ILIKE '%МПа%' OR quote ILIKE '%MPa%' THEN 2 ELSE 1 END AS weight FROM e WHERE quote <> '' AND parameter_code IS NOT NULL),
r AS (SELECT *, sum(size) OVER (PARTITION BY parameter_code ORDER BY weight DESC, size, ev_id ROWS UNBOUNDED PRECEDING) AS used FROM w) SELECT parameter_code, ev_id, used::BIGINT AS used FROM r WHERE used <= 2000""")
def dossier(t: Tables) -> DataFrame:
    """R-24: of each parameter the best quotes that fit 2,000 characters.

    No more than 2,000 quotes of a weight and size can fit, so each parameter
    is first cut to its 2,000 best: a bounded list, whatever its rows.
    """
    e = current(t.spark, t.sf_dir, "passport_evidence", ["parameter_code", "quote"]).filter("quote <> '' and parameter_code is not null")
    w = e.select("ev_id", "parameter_code", F.length("quote").alias("size"), F.when(F.lower("quote").contains("мпа") | F.lower("quote").contains("mpa"), 2).otherwise(1).alias("weight"))
    best = Window.partitionBy("parameter_code").orderBy(F.desc("weight"), "size", "ev_id")
    cut = w.withColumn("r", F.row_number().over(best)).filter("r <= 2000")
    used = F.sum("size").over(best.rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("used", used.cast("long")).filter("used <= 2000").select("parameter_code", "ev_id", "used")


@query(f"""WITH {_DENSE}, own AS (SELECT vec_id AS qid, label AS mine FROM embeddings), t AS (SELECT qid, min(rank) FILTER (WHERE label = mine) AS first, count(DISTINCT label) FILTER (WHERE rank <= 10) AS topics, count(*) FILTER (WHERE label = mine AND rank <= 10) AS hits FROM dense JOIN d USING (doc) JOIN own USING (qid) WHERE rank <= 50 GROUP BY 1),
n AS (SELECT label, count(*) - 1 AS targets FROM embeddings GROUP BY 1) SELECT mine AS topic, count(*) AS queries, floor(avg(hits / least(10, targets)) * 1e6 + 0.5) / 1e6 AS capped_recall, floor(avg(CASE WHEN first <= 10 THEN 1 ELSE 0 END) * 1e6 + 0.5) / 1e6 AS success, floor(avg(coalesce(1.0 / first, 0)) * 1e6 + 0.5) / 1e6 AS mrr FROM t JOIN own USING (qid) JOIN n ON label = mine WHERE targets > 0 GROUP BY 1""")
def topic_benchmark(t: Tables) -> DataFrame:
    """R-27: capped recall, success at ten and reciprocal rank, as means by topic."""
    label = t.embeddings.select("vec_id", "label")
    j = _dense(t, 50).join(label.toDF("doc", "label"), "doc").join(label.toDF("qid", "mine"), "qid")
    same = F.col("label") == F.col("mine")
    q = j.groupBy("qid", "mine").agg(F.min(F.when(same, F.col("rank"))).alias("first"), F.count_if(same & (F.col("rank") <= 10)).alias("hits"))
    n = label.groupBy(F.col("label").alias("mine")).agg((F.count(F.lit(1)) - 1).alias("targets")).filter("targets > 0")
    m = q.join(n, "mine")
    mean = lambda c: round6(F.avg(c))
    return m.groupBy(F.col("mine").alias("topic")).agg(F.count(F.lit(1)).alias("queries"), mean(F.col("hits") / F.least(F.lit(10), F.col("targets"))).alias("capped_recall"), mean(F.when(F.col("first") <= 10, 1.0).otherwise(0.0)).alias("success"), mean(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))


def _nested(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for lists in batches:
        out = []
        for terms in lists:
            kept: list[str] = []
            for x in terms:
                if not any(f" {x} " in f" {k} " or f" {k} " in f" {x} " for k in kept):
                    kept.append(x)
            out.append(kept)
        yield pd.Series(out)


@query(rf"""
WITH RECURSIVE w AS (SELECT parameter_code AS g, list_filter(regexp_split_to_array(lower(quote), '[^\p{{L}}]+'), lambda x: length(x) > 3) AS w FROM ({_EV}) WHERE quote IS NOT NULL AND parameter_code IS NOT NULL), s AS (SELECT g, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
c AS (SELECT g, term, count(*) AS n FROM s GROUP BY g, term), o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, term) AS i FROM c QUALIFY i <= 20),
r AS (SELECT g, 0::BIGINT AS i, []::VARCHAR[] AS kept FROM (SELECT DISTINCT g FROM o) UNION ALL SELECT r.g, o.i, CASE WHEN len(list_filter(kept, lambda k: contains(' ' || k || ' ', ' ' || o.term || ' ') OR contains(' ' || o.term || ' ', ' ' || k || ' '))) > 0 THEN kept ELSE list_append(kept, o.term) END FROM r JOIN o ON o.g = r.g AND o.i = r.i + 1)
SELECT g AS parameter_code, array_to_string(kept, ',') AS terms FROM r QUALIFY row_number() OVER (PARTITION BY g ORDER BY i DESC) = 1""")
def diverse_terms(t: Tables) -> DataFrame:
    """T-08, K-15: of each group's twenty commonest terms those that neither hold nor stand in a commoner one."""
    e = current(t.spark, t.sf_dir, "passport_evidence", ["parameter_code", "quote"]).filter("quote is not null and parameter_code is not null")
    w = e.select(F.col("parameter_code").alias("g"), F.filter(F.split(F.lower("quote"), r"[^\p{L}]+"), lambda x: F.length(x) > 3).alias("w"))
    s = w.select("g", F.explode(F.concat("w", X.shingles(F.col("w"), 2))).alias("term")).groupBy("g", "term").agg(F.count(F.lit(1)).alias("n"))
    top = s.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("n"), "term"))).filter("r <= 20")
    lists = top.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]).alias("l"))
    return lists.select(F.col("g").alias("parameter_code"), F.array_join(F.pandas_udf(_nested, "array<string>")("l"), ",").alias("terms"))


@query("""
WITH h AS (SELECT DISTINCT source_id, page_index FROM pages WHERE primary_text_layer LIKE '%OCR%'), p AS (SELECT DISTINCT source_id, page_index FROM pages WHERE primary_text_layer NOT LIKE '%OCR%')
SELECT h.source_id, h.page_index::BIGINT AS page_index, arg_min(p.page_index, (abs(p.page_index - h.page_index), p.page_index))::BIGINT AS nearest FROM h JOIN p USING (source_id) GROUP BY 1, 2""")
def nearest_clean_page(t: Tables) -> DataFrame:
    """J-20: to each scanned page the nearest clean one of its source: the one before and the one after, by two as-of joins."""
    p = t.pages.filter("primary_text_layer not like '%OCR%'").select("source_id", F.col("page_index").alias("p")).distinct()
    h = t.pages.filter("primary_text_layer like '%OCR%'").select("source_id", "page_index").distinct()
    before = joins.latest_before(h, p, "source_id", "page_index", "p", "p").select("source_id", "page_index", "p")
    back = joins.latest_before(h.withColumn("at", -F.col("page_index")), p.withColumn("q", -F.col("p")), "source_id", "at", "q", "q").select("source_id", "page_index", "p")
    return before.unionByName(back).groupBy("source_id", "page_index").agg(F.min_by("p", F.struct(F.abs(F.col("p") - F.col("page_index")), "p")).alias("nearest")).select("source_id", F.col("page_index").cast("long").alias("page_index"), F.col("nearest").cast("long").alias("nearest"))


@query("""
WITH r AS (SELECT p_partkey AS id, p_brand AS seam, p_partkey % 60 AS x0, p_partkey % 60 + p_size % 7 AS x1, 1950 + p_partkey % 70 AS y0, 1950 + p_partkey % 70 + p_size % 5 AS y1 FROM part)
SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.seam = b.seam AND a.id < b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1""")
def overlapping_workings(t: Tables) -> DataFrame:
    """J-26: workings of one seam that overlap in place and in time; cells of both axes make it an equi-join, each pair is told once."""
    k, size = F.col("p_partkey"), F.col("p_size")
    r = t.part.select(k.alias("id"), F.col("p_brand").alias("seam"), (k % 60).alias("x0"), (k % 60 + size % 7).alias("x1"), (1950 + k % 70).alias("y0"), (1950 + k % 70 + size % 5).alias("y1"))
    cell = lambda lo, hi, w: F.explode(F.sequence(F.floor(F.col(lo) / w), F.floor(F.col(hi) / w)))
    c = r.withColumn("cx", cell("x0", "x1", 8)).withColumn("cy", cell("y0", "y1", 6))
    a, b = (c.select(F.col("id").alias(n), "seam", "cx", "cy", *(F.col(v).alias(n + v) for v in ("x0", "x1", "y0", "y1"))) for n in ("a", "b"))
    met = a.join(b, ["seam", "cx", "cy"]).filter("a < b and ax0 <= bx1 and bx0 <= ax1 and ay0 <= by1 and by0 <= ay1")
    # Of all cells that two workings share, the one of their common corner tells of them.
    first = (F.col("cx") == F.floor(F.greatest("ax0", "bx0") / 8)) & (F.col("cy") == F.floor(F.greatest("ay0", "by0") / 6))
    return met.filter(first).select("a", "b")


@query("""
WITH RECURSIVE l AS (SELECT user_id AS id, CASE WHEN user_id > 1 THEN user_id // 2 END AS parent, min(ts) FILTER (WHERE event_type = 'signup') AS born, min(ts) FILTER (WHERE event_type = 'purchase') AS used FROM events GROUP BY 1),
u AS (SELECT id, parent AS up FROM l WHERE parent IS NOT NULL UNION SELECT u.id, l.parent FROM u JOIN l ON l.id = u.up WHERE l.parent IS NOT NULL) SELECT l.id, count(*) AS ancestors_later FROM l JOIN u USING (id) JOIN l p ON p.id = u.up WHERE p.born > l.used GROUP BY 1""")
def lineage_errors(t: Tables) -> DataFrame:
    """F-04: used before an ancestor of its line existed."""
    l = t.events.groupBy(F.col("user_id").alias("id")).agg(F.min(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("born"), F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("used"))  # noqa: E741
    parent = l.select("id", F.when(F.col("id") > 1, F.floor(F.col("id") / 2)).alias("up")).filter("up is not null")
    # A parent that isn't in the table ends a line, as it does where the line is followed row by row.
    far = joins.closure(t.spark, parent, "id", "up").select(F.col("src").alias("id"), F.col("dst").alias("up"))
    j = far.join(l.select("id", "used"), "id").join(l.select(F.col("id").alias("up"), "born"), "up").filter("born > used")
    return j.groupBy("id").agg(F.count(F.lit(1)).alias("ancestors_later"))


@query("""
WITH e AS (SELECT user_id AS station, ts, event_id, value, first_value(value) OVER w AS base, lag(value) OVER w AS before, lag(ts) OVER w AS last_ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, floor((value - base) * 1e6 + 0.5) / 1e6 AS displacement, floor(((value - base) * 0.8 + (value - before) * 0.6) * 1e6 + 0.5) / 1e6 AS line_of_sight, CASE WHEN ts > last_ts THEN floor((value - before) / (epoch(ts - last_ts) / 86400.0) * 1e4 + 0.5) / 1e4 END AS rate FROM e WHERE before IS NOT NULL""")
def relative_displacements(t: Tables) -> DataFrame:
    """F-15: against the first epoch, along a line of sight, and per day since the last."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t.events.select("event_id", "ts", "value", F.first("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("base"), F.lag("value").over(w).alias("before"), F.lag("ts").over(w).alias("at")).filter("before is not null")
    off = F.col("value") - F.col("base")
    step = F.col("value") - F.col("before")
    days = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) / 1e6 / 86400.0
    rate = F.when(F.col("ts") > F.col("at"), F.floor(step / F.nullif(days, F.lit(0.0)) * 1e4 + 0.5) / 1e4)
    return e.select("event_id", round6(off).alias("displacement"), round6(off * 0.8 + step * 0.6).alias("line_of_sight"), rate.alias("rate"))


@query(f"""
WITH e AS (SELECT parameter_code, coalesce(method_used, '-') AS factor, si_min AS v FROM ({_EV}) WHERE si_min IS NOT NULL AND parameter_code IS NOT NULL AND NOT isnan(si_min)), g AS (SELECT parameter_code, factor, median(v) AS m FROM e GROUP BY 1, 2), s AS (SELECT parameter_code, max(m) - min(m) AS swing, count(*) AS factors FROM g GROUP BY 1), a AS (SELECT parameter_code, median(v) AS mid, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS spread FROM e GROUP BY 1)
SELECT parameter_code, factors, swing / nullif(spread, 0) > 3 AS implausible, floor(swing / nullif(spread, 0) * 1e4 + 0.5) / 1e4 AS ratio FROM s JOIN a USING (parameter_code)""")
def swing_budget(t: Tables) -> DataFrame:
    """F-17: how far the medians of a factor's levels lie apart, against the spread of all values."""
    e = current(t.spark, t.sf_dir, "passport_evidence", ["parameter_code", "method_used", "si_min"]).filter("si_min is not null and parameter_code is not null and not isnan(si_min)").select("parameter_code", F.coalesce("method_used", F.lit("-")).alias("factor"), F.col("si_min").alias("v"))
    g = e.groupBy("parameter_code", "factor").agg(F.median("v").alias("m"))
    s = g.groupBy("parameter_code").agg((F.max("m") - F.min("m")).alias("swing"), F.count(F.lit(1)).alias("factors"))
    a = e.groupBy("parameter_code").agg((F.percentile("v", 0.75) - F.percentile("v", 0.25)).alias("spread"))
    ratio = F.col("swing") / F.nullif("spread", F.lit(0.0))
    return s.join(a, "parameter_code").select("parameter_code", "factors", (ratio > 3).alias("implausible"), (F.floor(ratio * 1e4 + 0.5) / 1e4).alias("ratio"))


@query(r"""
WITH t AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, regexp_matches(t, '(?:литератур|список источников|references|bibliograph|literatur)') AS bibliographic, regexp_matches(t, '(?:рис\.|рисун|fig\.|figure|abb\.|bild)') AS visual,
 regexp_extract(t, '(?:табл\.|таблица|table|tabelle|рис\.|рисунок|fig\.|figure|abb\.)\s*([0-9]+(?:\.[0-9]+)?)', 1) AS object_number FROM t""")
def intent_cues(t: Tables) -> DataFrame:
    """X-20: what a text asks for: references, pictures, a numbered object."""
    x = F.lower("text")
    number = F.regexp_extract(x, r"(?:табл\.|таблица|table|tabelle|рис\.|рисунок|fig\.|figure|abb\.)\s*([0-9]+(?:\.[0-9]+)?)", 1)
    return t.documents.filter("text is not null").select("doc_id", x.rlike("(?:литератур|список источников|references|bibliograph|literatur)").alias("bibliographic"), x.rlike(r"(?:рис\.|рисун|fig\.|figure|abb\.|bild)").alias("visual"), number.alias("object_number"))


@query(r"""
WITH p AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(normalized_text, '<[^>\n]{1,80}>', ' ', 'g'), '!\[[^\]\n]*\]\([^)\n]*\)', ' ', 'g'), '[*_#`]{1,6}', '', 'g'), '[ \t]+', ' ', 'g')) AS t, normalized_text AS o FROM (SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY created_at DESC NULLS LAST) = 1) WHERE normalized_text IS NOT NULL)
SELECT page_id, md5(t) AS cleaned, contains(o, chr(65533)) AS broken, regexp_matches(o, '(?:[^\p{L}\p{N}\s]){6,}') AS noisy, length(t) < 20 AS nearly_empty FROM p""")
def recognised_markup(t: Tables) -> DataFrame:
    """X-30: tags and marks of a recogniser's output off, and flags for what looks wrong."""
    p = current(t.spark, t.sf_dir, "pages", ["normalized_text"]).filter("normalized_text is not null")
    c = F.col("normalized_text")
    for pattern, by in ((r"<[^>\n]{1,80}>", " "), (r"!\[[^\]\n]*\]\([^)\n]*\)", " "), (r"[*_#`]{1,6}", ""), (r"[ \t]+", " ")):
        c = F.regexp_replace(c, pattern, by)
    c = F.trim(c)
    return p.select("page_id", F.md5(c).alias("cleaned"), F.col("normalized_text").contains("�").alias("broken"), F.col("normalized_text").rlike(r"(?:[^\p{L}\p{N}\s]){6,}").alias("noisy"), (F.length(c) < 20).alias("nearly_empty"))


@query("""
WITH o AS (SELECT DISTINCT object_id, source_id, page_id, object_type AS kind, coalesce(label, '') AS label FROM object_dup_members WHERE object_id IS NOT NULL UNION SELECT DISTINCT unit_id, source_id, page_id, 'UNIT', '' FROM nav_dup_members WHERE unit_id IS NOT NULL)
SELECT object_id, source_id, page_id, min(kind) AS kind, max(label) AS label FROM o GROUP BY 1, 2, 3""")
def entity_index(t: Tables) -> DataFrame:
    """K-35: one row per object, source and page."""
    a = t.object_dup_members.filter("object_id is not null").select("object_id", "source_id", "page_id", F.col("object_type").alias("kind"), F.coalesce("label", F.lit("")).alias("label"))
    b = t.nav_dup_members.filter("unit_id is not null").select(F.col("unit_id").alias("object_id"), "source_id", "page_id", F.lit("UNIT").alias("kind"), F.lit("").alias("label"))
    return a.unionByName(b).groupBy("object_id", "source_id", "page_id").agg(F.min("kind").alias("kind"), F.max("label").alias("label"))
