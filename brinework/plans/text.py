"""Text rules, duplicates, terms and lexical search over the corpus tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoint import Workspace
from ..functions import packing
from ..functions import text as X
from ..functions.common import round6, text_list
from ..operators import duplicates, retrieval, terms
from ..tables import current
from .catalog import Catalog, Tables

catalog = Catalog()
query = catalog.query
QUERIES, ORACLES = catalog.queries, catalog.oracles

_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
_PAGES = "SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY created_at DESC NULLS LAST) = 1"


def _texts(t: Tables) -> DataFrame:
    return t.documents.filter("text is not null").select("doc_id", "source", "lang", "text")


def _words(t: Tables) -> DataFrame:
    return _texts(t).withColumn("w", X.words(F.col("text")))


@query(r"""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(text, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'),
  '[\x{00AD}\x{200B}\x{200C}\x{200D}\x{FEFF}\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}]', '', 'g'), '(\pL)-\r?\n(\p{Ll})', '\1\2', 'g'), '[\t\n\x{0B}\f\r ]+', ' ', 'g'))) AS h FROM documents WHERE text IS NOT NULL""")
def text_normalize(t: Tables) -> DataFrame:
    """X-01 without composition (``functions.text.composed`` adds it)."""
    return _texts(t).select("doc_id", F.md5(X.normalize_text(F.col("text"))).alias("h"))


@query(r"SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS capitals, length(text) - length(replace(text, chr(10), '')) AS line_ends FROM documents WHERE text IS NOT NULL")
def char_stats(t: Tables) -> DataFrame:
    """X-08, X-24."""
    n = lambda c: F.length(F.regexp_replace("text", c, "")).cast("long")
    return _texts(t).select("doc_id", F.length("text").cast("long").alias("n"), n("[^0-9]").alias("digits"), n(r"[^\p{L}]").alias("letters"), n(r"[^\p{Lu}]").alias("capitals"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("long").alias("line_ends"))


@query(r"""
WITH n AS (SELECT doc_id, lang, length(regexp_replace(text, '[^А-Яа-яЁё]', '', 'g')) AS c, length(regexp_replace(text, '[^A-Za-zÄÖÜäöüß]', '', 'g')) AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN c > 2 * l THEN 'cyrillic' WHEN l > 2 * c THEN 'latin' ELSE 'mixed' END AS script, lower(lang) = 'ru' AS said_ru FROM n""")
def language_majority(t: Tables) -> DataFrame:
    """X-07."""
    return _texts(t).select("doc_id", X.language_majority(F.col("text")).alias("script"), (F.lower("lang") == "ru").alias("said_ru"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
SELECT doc_id, count(*) FILTER (WHERE trim(line) <> '') AS lines, count(*) FILTER (WHERE regexp_matches(line, '\[[0-9]+\]')) AS cited, count(*) FILTER (WHERE regexp_matches(line, '^[0-9]+[.)] ')) AS numbered FROM l GROUP BY 1""")
def bib_line_share(t: Tables) -> DataFrame:
    """X-09: lines that cite, and numbered lines; counted inside the row, nothing is exploded."""
    lines = F.split("text", "\n")
    count = lambda test: F.size(F.filter(lines, test)).cast("long")
    return _texts(t).select("doc_id", count(lambda x: F.trim(x) != "").alias("lines"), count(lambda x: x.rlike(r"\[[0-9]+\]")).alias("cited"), count(lambda x: x.rlike(r"^[0-9]+[.)] ")).alias("numbered"))


@query(r"""
WITH b AS (SELECT DISTINCT object_id, page_id, reading_order, block_type, normalized_text FROM blocks WHERE is_primary_layer AND normalized_text IS NOT NULL AND block_type NOT IN ('PAGE_HEADER', 'PAGE_FOOTER', 'PAGE_NUMBER'))
SELECT page_id, sha256(string_agg(normalized_text, chr(10) || chr(10) ORDER BY reading_order, object_id)) AS text_sha, length(string_agg(normalized_text, chr(10) || chr(10) ORDER BY reading_order, object_id)) AS char_count FROM b GROUP BY 1""")
def page_text_rebuild(t: Tables) -> DataFrame:
    """X-02: a page's text from its primary blocks in reading order, furniture left out."""
    b = t.blocks.filter("is_primary_layer and normalized_text is not null and block_type not in ('PAGE_HEADER', 'PAGE_FOOTER', 'PAGE_NUMBER')").select("object_id", "page_id", "reading_order", "block_type", "normalized_text").distinct()
    whole = b.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "object_id", "normalized_text"))), lambda s: s["normalized_text"]), "\n\n").alias("text"))
    return whole.select("page_id", F.sha2("text", 256).alias("text_sha"), F.length("text").cast("long").alias("char_count"))


@query(f"""
WITH p AS (SELECT page_id, source_id, sha256(normalized_text) AS h FROM ({_PAGES}) WHERE length(normalized_text) >= 200)
SELECT h, count(*) AS pages, count(DISTINCT source_id) AS sources, min(page_id) AS first_page FROM p GROUP BY 1 HAVING count(DISTINCT source_id) > 1""")
def duplicate_groups(t: Tables) -> DataFrame:
    """J-10, D-16: equal page texts of two sources or more."""
    p = current(t.spark, t.sf_dir, "pages", ["source_id", "normalized_text"]).filter("length(normalized_text) >= 200").select("page_id", "source_id", F.sha2("normalized_text", 256).alias("h"))
    return p.groupBy("h").agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("source_id").alias("sources"), F.min("page_id").alias("first_page")).filter("sources > 1")


@query("""
WITH u AS (SELECT DISTINCT cluster_id, source_id FROM nav_dup_members WHERE source_id IS NOT NULL AND cluster_id IS NOT NULL)
SELECT a.source_id AS source_a, b.source_id AS source_b, count(*) AS clusters FROM u a JOIN u b ON a.cluster_id = b.cluster_id AND a.source_id < b.source_id GROUP BY ALL""")
def source_overlap(t: Tables) -> DataFrame:
    """D-08c: sources by shared clusters; a cluster gives pairs of sources, not of members."""
    u = t.nav_dup_members.filter("source_id is not null and cluster_id is not null").select("cluster_id", "source_id").distinct()
    return u.alias("a").join(u.alias("b"), "cluster_id").filter("a.source_id < b.source_id").groupBy(F.col("a.source_id").alias("source_a"), F.col("b.source_id").alias("source_b")).agg(F.count(F.lit(1)).alias("clusters"))


@query("""
WITH m AS (SELECT * FROM nav_dup_members QUALIFY row_number() OVER (PARTITION BY cluster_id, unit_id ORDER BY recorded_at DESC NULLS LAST) = 1)
SELECT cluster_id, count(*) AS members, count(DISTINCT work_id) AS works, CASE WHEN count(DISTINCT work_id) = 1 THEN 'SAME_WORK_COPY' WHEN count(DISTINCT work_id) >= 3 AND min(containment) < 0.6 THEN 'BOILERPLATE' WHEN count(DISTINCT work_id) >= 2 AND min(containment) >= 0.8 THEN 'REPRINT' ELSE 'PARTIAL_OVERLAP' END AS kind FROM m GROUP BY 1""")
def dup_cluster_kinds(t: Tables) -> DataFrame:
    """D-08: kinds by ordered rules."""
    m = current(t.spark, t.sf_dir, "nav_dup_members", ["work_id", "containment"])
    n = m.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members"), F.count_distinct("work_id").alias("works"), F.min("containment").alias("least"))
    kind = F.when(F.col("works") == 1, "SAME_WORK_COPY").when((F.col("works") >= 3) & (F.col("least") < 0.6), "BOILERPLATE").when((F.col("works") >= 2) & (F.col("least") >= 0.8), "REPRINT").otherwise("PARTIAL_OVERLAP")
    return n.select("cluster_id", "members", "works", kind.alias("kind"))


@query(rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) >= 5), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2), e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c / (x.n + y.n - c) >= 0.8), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS id, a AS far FROM u UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.far) SELECT id AS doc_id, min(far) AS cluster_id FROM r GROUP BY 1""")
def minhash_clusters(t: Tables) -> DataFrame:
    """D-01 .. D-03, D-05 .. D-07: shingles of five words, bands, exact verification at 0.8, groups by least member.

    Equal sets are one; all others of a bucket meet.  32 bands of 3 rows miss a
    pair of 0.8 with a probability of 10^-10, so the SQL, which compares all
    pairs, has the same rows.
    """
    units = _words(t).select(F.col("doc_id").alias("u"), X.shingles(F.col("w"), 5).alias("s"))
    units = Workspace(t.spark, "minhash").cut(units.select("u", F.array_distinct(F.transform("s", lambda s: F.xxhash64(s))).alias("s")), "units").filter("size(s) > 0")
    sets, copies = duplicates.equal_sets(t.spark, units, "u", "s")
    bands = Workspace(t.spark, "minhash").cut(duplicates.minhash_bands(sets, "u", "s"), "bands")
    pairs = duplicates.bucket_candidates(bands, sets.select("u", F.size("s").alias("n")), "u", 0.8)
    good = duplicates.verified(pairs, sets, "u", "s").filter("jaccard >= 0.8")
    labels = duplicates.label_propagation(t.spark, good.select("a", "b"))
    of_copies = copies.join(labels.withColumnRenamed("id", "first"), "first", "left").select(F.col("u").alias("doc_id"), F.coalesce("label", "first").alias("cluster_id"))
    return of_copies.unionByName(labels.join(copies, F.col("id") == F.col("u"), "left_anti").select(F.col("id").alias("doc_id"), F.col("label").alias("cluster_id")))


@query(rf"""
WITH w AS (SELECT doc_id, source, unnest({_WORDS}) AS term FROM documents WHERE text IS NOT NULL AND source IS NOT NULL), tf AS (SELECT source, term, count(*) AS tf FROM w GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(DISTINCT source) AS n FROM tf), s AS (SELECT source, tf.term, tf, floor(tf * ln(n / df) * 1e6 + 0.5) / 1e6 AS score FROM tf JOIN df USING (term), n)
SELECT source, term, tf, score, r FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, term) AS r FROM s) WHERE r <= 5""")
def tfidf_key_terms(t: Tables) -> DataFrame:
    """A-19, K-04, K-15, K-16."""
    w = _words(t).filter("source is not null").select("source", F.explode("w").alias("term"))
    return terms.top_per(terms.tf_idf(w, "source"), "source", "score", "term", 5).select("source", "term", "tf", "score", "r")


@query(rf"""
WITH w AS (SELECT doc_id, coalesce(doc_kind, '-') AS g, unnest({_WORDS}) AS term FROM documents WHERE text IS NOT NULL), b AS (SELECT g, term, count(*) AS tf, count(DISTINCT doc_id) AS n_sec FROM w GROUP BY ALL),
tot AS (SELECT g, sum(tf)::BIGINT AS total FROM b GROUP BY 1), sz AS (SELECT g, count(DISTINCT doc_id) AS size FROM w GROUP BY 1), f AS (SELECT term, sum(tf)::BIGINT AS f FROM b GROUP BY 1), a AS (SELECT avg(total) AS avg_total FROM tot),
s AS (SELECT b.g, b.term, floor(tf / total * ln(1 + avg_total / f) * (0.5 + 0.5 * n_sec / size) * 1e6 + 0.5) / 1e6 AS score FROM b JOIN f USING (term) JOIN tot USING (g) JOIN sz USING (g), a WHERE n_sec >= least(2, size))
SELECT g AS kind, term, score, r FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, term) AS r FROM s) WHERE r <= 8""")
def ctfidf_labels(t: Tables) -> DataFrame:
    """K-14."""
    w = t.documents.filter("text is not null").select("doc_id", F.coalesce("doc_kind", F.lit("-")).alias("kind"), F.explode(X.words(F.col("text"))).alias("term"))
    return terms.top_per(terms.c_tf_idf(w, "kind", "doc_id"), "kind", "score", "term", 8).select("kind", "term", "score", "r")


@query("""
WITH o AS (SELECT DISTINCT l_orderkey AS u, l_partkey AS t FROM lineitem), n AS (SELECT count(DISTINCT u) AS n FROM o), df AS (SELECT t, count(*) AS df FROM o GROUP BY 1),
p AS (SELECT x.t AS a, y.t AS b, count(*) AS shared FROM o x JOIN o y ON x.u = y.u AND x.t < y.t GROUP BY ALL HAVING count(*) >= 2),
v AS (SELECT a, b, shared, floor(CASE WHEN shared >= n THEN 1.0 ELSE ln(shared * n / (da.df * db.df)) / -ln(shared / n) END * 1e6 + 0.5) / 1e6 AS npmi FROM p JOIN df da ON da.t = a JOIN df db ON db.t = b, n)
SELECT a, b, shared, npmi, floor(npmi * shared / (shared + 2) * 1e6 + 0.5) / 1e6 AS score FROM v WHERE npmi >= 0.2""")
def cooccurrence_npmi(t: Tables) -> DataFrame:
    """J-09, K-05, A-22: parts of one order."""
    return terms.npmi(t.lineitem, "l_orderkey", "l_partkey", 2, 0.2)


@query(r"""
WITH w AS (SELECT list_filter(regexp_split_to_array(lower(quote), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM passport_evidence WHERE quote IS NOT NULL),
g AS (SELECT unnest(list_transform(range(1, len(w) - 0), lambda i: array_to_string(w[i:i + 1], ' '))) AS term FROM w WHERE len(w) >= 2 UNION ALL SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) FROM w WHERE len(w) >= 3 UNION ALL SELECT unnest(w) FROM w),
c AS (SELECT term, count(*) AS tf FROM g WHERE NOT regexp_matches(term, '[0-9]') GROUP BY 1 HAVING count(*) >= 3),
i AS (SELECT a.term, avg(b.tf) AS mean, max(b.tf) AS most FROM c a JOIN c b ON a.term <> b.term AND contains(' ' || b.term || ' ', ' ' || a.term || ' ') GROUP BY 1),
v AS (SELECT c.term, tf, floor(log2(len(string_split(c.term, ' ')) + 1) * (tf - coalesce(mean, 0)) * 1e6 + 0.5) / 1e6 AS cvalue, coalesce(most, 0) AS most FROM c LEFT JOIN i USING (term))
SELECT term, tf, cvalue FROM v WHERE cvalue > 0 AND most < 0.9 * tf""")
def c_value_terms(t: Tables) -> DataFrame:
    """X-10, X-11, K-03: candidates of one to three words."""
    w = t.passport_evidence.filter("quote is not null").select(X.words(F.col("quote")).alias("w"))
    grams = w.select(F.explode(F.concat("w", X.shingles(F.col("w"), 2), X.shingles(F.col("w"), 3))).alias("term")).filter(~F.col("term").rlike("[0-9]"))
    return terms.c_value(grams.groupBy("term").agg(F.count(F.lit(1)).alias("tf")).filter("tf >= 3"))


@query(rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, len(w) AS dl, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM w) GROUP BY ALL),
n AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1), q AS (SELECT doc_id AS qid, unnest(list_distinct(w)) AS term FROM w WHERE doc_id % 20 = 0),
s AS (SELECT qid, p.doc_id AS doc, floor(sum(floor(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) * 16777216 + 0.5)) / 16777216 * 1e4 + 0.5) / 1e4 AS score FROM q JOIN p USING (term) JOIN df USING (term), n WHERE p.doc_id <> qid GROUP BY ALL)
SELECT qid, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 5""")
def bm25_topk(t: Tables) -> DataFrame:
    """R-01: every twentieth document asks with all its words; scores are summed on a dyadic grid."""
    docs = _words(t)
    asked = docs.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), F.col("w").alias("terms"))
    return retrieval.bm25(docs, "doc_id", "w", asked, 5, places=1e4).select("qid", "doc", "score", F.col("rank").cast("long").alias("rank"))


@query(rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS w, length(text) AS n FROM documents WHERE text IS NOT NULL), g AS (SELECT doc_id, len(w) AS tokens, unnest(list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i:i + 5], ' '))) AS g FROM w WHERE len(w) >= 6 AND n >= 300),
c AS (SELECT doc_id, tokens, g, count(*) AS k FROM g GROUP BY ALL) SELECT doc_id, max(k) AS most, max(k) >= 8 AND max(k) * 6.0 / any_value(tokens) >= 0.5 AS degenerate FROM c GROUP BY doc_id""")
def repetition_flags(t: Tables) -> DataFrame:
    """X-31: the most frequent run of six words of a text."""
    g = _words(t).filter("length(text) >= 300 and size(w) >= 6").select("doc_id", F.size("w").alias("tokens"), F.explode(X.shingles(F.col("w"), 6)).alias("g"))
    c = g.groupBy("doc_id", "tokens", "g").agg(F.count(F.lit(1)).alias("k"))
    return c.groupBy("doc_id", "tokens").agg(F.max("k").alias("most")).select("doc_id", "most", ((F.col("most") >= 8) & (F.col("most") * 6.0 / F.col("tokens") >= 0.5)).alias("degenerate"))


@query(rf"""
WITH w AS (SELECT doc_id, doc_kind, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, doc_kind, unnest(range(1, len(w) - 10)) AS i, w FROM w WHERE len(w) >= 12), g AS (SELECT doc_id, doc_kind, i, array_to_string(w[i:i + 11], ' ') AS g FROM s),
known AS (SELECT DISTINCT g FROM g WHERE doc_kind = 'abstract'), h AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM g WHERE doc_kind = 'report' AND g IN (SELECT g FROM known)),
r AS (SELECT doc_id, min(i) AS start, max(i) - min(i) + 12 AS words FROM h GROUP BY doc_id, island) SELECT doc_id, start, words FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, start) = 1""")
def longest_leak_run(t: Tables) -> DataFrame:
    """X-26, W-13: the longest stretch of a report that abstracts have too, by runs of twelve words."""
    g = t.documents.filter("text is not null").select("doc_id", "doc_kind", F.posexplode(X.shingles(X.words(F.col("text")), 12)).alias("i", "g")).withColumn("i", F.col("i").cast("long") + 1)
    known = g.filter("doc_kind = 'abstract'").select("g").distinct()
    hit = g.filter("doc_kind = 'report'").join(known, "g", "left_semi")
    island = F.col("i") - F.row_number().over(Window.partitionBy("doc_id").orderBy("i"))
    runs = hit.withColumn("island", island).groupBy("doc_id", "island").agg(F.min("i").alias("start"), (F.max("i") - F.min("i") + 12).alias("words"))
    best = runs.groupBy("doc_id").agg(F.min(F.struct((-F.col("words")).alias("m"), "start", "words")).alias("b"))
    return best.select("doc_id", "b.start", "b.words")


@query(f"""
WITH p AS ({_PAGES}), e AS (SELECT * FROM passport_evidence QUALIFY row_number() OVER (PARTITION BY ev_id ORDER BY recorded_at DESC NULLS LAST) = 1),
j AS (SELECT ev_id, regexp_extract_all(quote, '[0-9]+') AS q, regexp_extract_all(normalized_text, '[0-9]+') AS p FROM e JOIN p USING (page_id) WHERE quote IS NOT NULL AND normalized_text IS NOT NULL)
SELECT ev_id, len(list_distinct(q)) AS numbers, len(list_intersect(list_distinct(q), list_distinct(p))) AS on_page FROM j""")
def quote_numbers_on_page(t: Tables) -> DataFrame:
    """X-23: numbers of a quote that its page has."""
    p = current(t.spark, t.sf_dir, "pages", ["normalized_text"]).filter("normalized_text is not null").select("page_id", F.array_distinct(F.regexp_extract_all("normalized_text", F.lit("[0-9]+"), F.lit(0))).alias("p"))
    e = current(t.spark, t.sf_dir, "passport_evidence", ["quote", "page_id"]).filter("quote is not null").select("ev_id", "page_id", F.array_distinct(F.regexp_extract_all("quote", F.lit("[0-9]+"), F.lit(0))).alias("q"))
    return e.join(p, "page_id").select("ev_id", F.size("q").cast("long").alias("numbers"), F.size(F.array_intersect("q", "p")).cast("long").alias("on_page"))


@query(r"SELECT DISTINCT label, regexp_extract(label, '([0-9]+)', 1) AS number, CASE WHEN regexp_matches(label, '^(Рис|Fig|Abb)') THEN 'FIGURE' WHEN regexp_matches(label, '^(Табл|Table|Tab)') THEN 'TABLE' ELSE 'OTHER' END AS kind FROM object_dup_members WHERE label IS NOT NULL")
def label_keys(t: Tables) -> DataFrame:
    """X-22."""
    kind = F.when(F.col("label").rlike("^(Рис|Fig|Abb)"), "FIGURE").when(F.col("label").rlike("^(Табл|Table|Tab)"), "TABLE").otherwise("OTHER")
    return t.object_dup_members.filter("label is not null").select("label").distinct().select("label", F.regexp_extract("label", r"([0-9]+)", 1).alias("number"), kind.alias("kind"))


@query(r"""
WITH s AS (SELECT doc_id, list_filter(string_split_regex(text, '[.!?]\s+'), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(s) AS sentences, list_max(list_transform(s, lambda x: len(list_filter(string_split(x, ' '), lambda y: y <> '')))) AS most_words FROM s WHERE len(s) > 0""")
def sentence_stats(t: Tables) -> DataFrame:
    """X-04."""
    s = F.filter(F.split("text", r"[.!?]\s+"), lambda x: x != "")
    rows = _texts(t).select("doc_id", s.alias("s")).filter("size(s) > 0")
    return rows.select("doc_id", F.size("s").cast("long").alias("sentences"), F.array_max(F.transform("s", lambda x: F.size(F.filter(F.split(x, " "), lambda y: y != "")))).cast("long").alias("most_words"))


@query("""
WITH c AS (SELECT * FROM table_cells QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY created_at DESC NULLS LAST) = 1)
SELECT table_id, max(row_no)::BIGINT + 1 AS row_span, max(col_no)::BIGINT + 1 AS col_span, count(*) FILTER (WHERE is_header) AS headers, count(*) FILTER (WHERE regexp_matches(text, '[0-9]')) AS numeric_cells, string_agg(DISTINCT property_key, ',' ORDER BY property_key) AS properties FROM c GROUP BY 1""")
def table_profiles(t: Tables) -> DataFrame:
    """X-14, K-28: shape, header zone and properties of each table."""
    c = current(t.spark, t.sf_dir, "table_cells", ["table_id", "row_no", "col_no", "is_header", "text", "property_key"])
    return c.groupBy("table_id").agg((F.max("row_no").cast("long") + 1).alias("row_span"), (F.max("col_no").cast("long") + 1).alias("col_span"), F.count_if("is_header").alias("headers"), F.count_if(F.col("text").rlike("[0-9]")).alias("numeric_cells"), F.nullif(text_list(F.array_sort(F.collect_set("property_key"))), F.lit("")).alias("properties"))


_FURNITURE = "'PAGE_HEADER', 'PAGE_FOOTER', 'PAGE_NUMBER'"


@query("SELECT k AS page_id, unit_no, n_blocks, text_md5 FROM (" + packing.units_sql(f"""
SELECT page_id AS k, row_number() OVER (PARTITION BY page_id ORDER BY reading_order NULLS FIRST, object_id) AS i, h, t FROM (SELECT DISTINCT page_id, object_id, reading_order, coalesce(block_type = 'TITLE', false) AS h, normalized_text AS t FROM blocks
  WHERE is_primary_layer AND normalized_text IS NOT NULL AND page_id IS NOT NULL AND block_type NOT IN ({_FURNITURE}))""") + ")")
def unit_packing(t: Tables) -> DataFrame:
    """X-25 per page: the blocks of a page are one array, as long as a page is."""
    b = t.blocks.filter(f"is_primary_layer and normalized_text is not null and page_id is not null and block_type not in ({_FURNITURE})")
    b = b.select("page_id", "object_id", "reading_order", F.coalesce(F.col("block_type") == "TITLE", F.lit(False)).alias("heading"), F.col("normalized_text").alias("text")).distinct()
    return _units(b, "page_id", F.array_sort(F.collect_list(F.struct(F.coalesce("reading_order", F.lit(-1)).alias("o"), "object_id", "heading", "text"))))


@query("SELECT k AS doc_id, unit_no, n_blocks, text_md5 FROM (" + packing.units_sql("SELECT doc_id AS k, unnest(range(1, len(l) + 1)) AS i, false AS h, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS l FROM documents WHERE text IS NOT NULL)") + ")")
def paragraph_packing(t: Tables) -> DataFrame:
    """X-25, UD-06 over paragraphs of documents, the long ones cut between sentences."""
    b = _texts(t).select("doc_id", F.transform(F.split("text", "\n\n"), lambda p: F.struct(F.lit(False).alias("heading"), p.alias("text"))).alias("b"))
    return _exploded(b.select("doc_id", packing.units(F.col("b")).alias("u")), "doc_id")


def _units(blocks: DataFrame, key: str, ordered: Column) -> DataFrame:
    packed = blocks.groupBy(key).agg(ordered.alias("b")).select(key, packing.units(F.transform("b", lambda x: F.struct(x["heading"].alias("heading"), x["text"].alias("text")))).alias("u"))
    return _exploded(packed, key)


def _exploded(units: DataFrame, key: str) -> DataFrame:
    return units.select(key, F.posexplode("u").alias("unit_no", "x")).select(key, F.col("unit_no").cast("long").alias("unit_no"), F.col("x.n").cast("long").alias("n_blocks"), F.md5("x.text").alias("text_md5"))


@query(r"""
WITH w AS (SELECT doc_id, regexp_replace(unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')), '^(.{4,}?)(?:ing|ed|es|s)$', '\1') AS stem FROM documents WHERE text IS NOT NULL)
SELECT stem, count(*) AS n, count(DISTINCT doc_id) AS docs FROM w WHERE stem <> '' GROUP BY 1 HAVING count(*) >= 5""")
def stem_counts(t: Tables) -> DataFrame:
    """X-05, X-06 with the English endings."""
    w = _texts(t).select("doc_id", F.explode(X.words(F.col("text"), r"[^\p{L}]+")).alias("w"))
    s = w.select("doc_id", F.regexp_replace("w", r"^(.{4,}?)(?:ing|ed|es|s)$", "$1").alias("stem"))
    return s.groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs")).filter("n >= 5")


@query("SELECT doc_id, position('МПа' IN text) AS pos, substr(text, greatest(1, position('МПа' IN text) - 20), 40) AS snippet FROM documents WHERE contains(text, 'МПа')")
def snippets(t: Tables) -> DataFrame:
    """X-33: what stands around the first hit."""
    at = F.locate("МПа", "text")
    return _texts(t).filter(F.col("text").contains("МПа")).select("doc_id", at.cast("long").alias("pos"), F.substring("text", F.greatest(F.lit(1), at - 20), F.lit(40)).alias("snippet"))


@query("""
WITH c AS (SELECT source, doc_id, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE source IS NOT NULL), r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) AS r FROM c)
SELECT source, doc_id FROM r WHERE r <= 3""")
def stratified_selection(t: Tables) -> DataFrame:
    """R-25: a budget of three per stratum, in the order of a hash."""
    w = Window.partitionBy("source").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    return t.documents.filter("source is not null").select("source", "doc_id", F.row_number().over(w).alias("r")).filter("r <= 3").drop("r")


@query("""
WITH m AS (SELECT unit_id, max(cosine) FILTER (WHERE NOT isnan(cosine)) AS best, count(DISTINCT cluster_id) AS clusters FROM nav_dup_members GROUP BY 1)
SELECT unit_id, clusters, floor(best * 1e6 + 0.5) / 1e6 AS best FROM m WHERE clusters > 1""")
def copies_of(t: Tables) -> DataFrame:
    """D-08b, D-17: units in several clusters with their best cosine."""
    real = F.when(~F.isnan("cosine"), F.col("cosine"))
    return t.nav_dup_members.groupBy("unit_id").agg(F.count_distinct("cluster_id").alias("clusters"), round6(F.max(real)).alias("best")).filter("clusters > 1")


