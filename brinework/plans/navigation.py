"""Topics, concepts, dictionaries, sections, table chains and evidence of duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.common import round6
from ..operators import communities, duplicates, joins, vectors
from ..tables import current
from .catalog import Catalog, Tables
from .vectors import _DENSE, _dense

catalog = Catalog()
query = catalog.query
QUERIES, ORACLES = catalog.queries, catalog.oracles

_R6 = "floor(({}) * 1e6 + 0.5) / 1e6"
_CELLS = "SELECT * FROM table_cells QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY created_at DESC NULLS LAST) = 1"
_EV = "SELECT * FROM passport_evidence QUALIFY row_number() OVER (PARTITION BY ev_id ORDER BY recorded_at DESC NULLS LAST) = 1"
_MEMBERS = "SELECT * FROM nav_dup_members QUALIFY row_number() OVER (PARTITION BY cluster_id, unit_id ORDER BY recorded_at DESC NULLS LAST) = 1"
_WORDS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}]+'), lambda w: w <> '')"


@query()
def topic_levels(t: Tables) -> DataFrame:
    """K-12, K-13, K-17: nested communities of the graph of nearest neighbours (every twentieth vector against all)."""
    edges = _dense(t, 5).filter("score > 0").select(F.col("qid").alias("a"), F.col("doc").alias("b"), F.col("score").alias("weight"))
    return communities.louvain(t.spark, edges)


_CENTROIDS = """m AS (SELECT label, i, sum(round(embedding[i]::DOUBLE * 16777216)::BIGINT)::DOUBLE / 16777216 AS s FROM embeddings, range(1, 65) r(i) GROUP BY ALL), n AS (SELECT label, list(s ORDER BY i) AS c, sqrt(sum(s * s)) AS n FROM m GROUP BY 1)"""


@query(f"WITH {_CENTROIDS} SELECT a.label AS a, b.label AS b, {_R6.format('list_inner_product(a.c, b.c) / a.n / b.n')} AS similarity FROM n a JOIN n b ON a.label < b.label WHERE list_inner_product(a.c, b.c) / a.n / b.n > 0")
def topic_edges(t: Tables) -> DataFrame:
    """K-19: topics whose means point the same way. Topics are few: their means are one row each."""
    m = vectors.mean_vector(t.embeddings, ["label"], "embedding")
    a, b = m.toDF("a", "x"), m.toDF("b", "y")
    s = a.join(b, F.col("a") < F.col("b")).select("a", "b", vectors.dot(F.col("x"), F.col("y")).alias("s"))
    return s.filter("s > 0").select("a", "b", round6(F.col("s")).alias("similarity"))


@query(f"""WITH {_DENSE}, own AS (SELECT vec_id AS qid, label AS mine FROM embeddings) SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM dense JOIN d USING (doc) JOIN own USING (qid) WHERE rank <= 50 AND label <> mine QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) <= 5""")
def similar_elsewhere(t: Tables) -> DataFrame:
    """K-20: the nearest of other topics, among the fifty nearest."""
    label = t.embeddings.select(F.col("vec_id").alias("doc"), "label")
    j = _dense(t, 50).drop("rank").join(label, "doc").join(label.toDF("qid", "mine"), "qid").filter("label <> mine")
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc")).cast("long")).filter("rank <= 5").select("qid", "doc", "score", "rank")


_HEAD = r"regexp_matches(normalized_text, '^[0-9]+(\.[0-9]+)* \p{Lu}') OR block_type = 'TITLE'"
_UNITS = f"""b AS (SELECT DISTINCT source_id, page_id, reading_order, object_id, normalized_text, coalesce({_HEAD}, false) AS h FROM blocks WHERE normalized_text IS NOT NULL AND page_id IS NOT NULL),
u AS (SELECT *, page_id || '#' || sum(h::INT) OVER (PARTITION BY page_id ORDER BY reading_order, object_id ROWS UNBOUNDED PRECEDING)::VARCHAR AS unit FROM b)"""


def _concept_units(t: Tables) -> DataFrame:
    heading = F.col("normalized_text").rlike(r"^[0-9]+(\.[0-9]+)* \p{Lu}") | (F.col("block_type") == "TITLE")
    b = t.blocks.filter("normalized_text is not null and page_id is not null").select("source_id", "page_id", "reading_order", "object_id", "normalized_text", F.coalesce(heading, F.lit(False)).alias("h")).distinct()
    # Groups are of one page, so no window grows beyond it.
    w = Window.partitionBy("page_id").orderBy("reading_order", "object_id").rowsBetween(Window.unboundedPreceding, 0)
    return b.withColumn("unit", F.concat("page_id", F.lit("#"), F.sum(F.col("h").cast("int")).over(w).cast("string")))


@query(f"WITH {_UNITS} SELECT unit, count(*) AS blocks, sum(length(normalized_text))::BIGINT AS chars FROM u GROUP BY 1")
def concept_units(t: Tables) -> DataFrame:
    """K-01, W-05: headings open a new unit of co-occurrence; a page without any is one unit."""
    return _concept_units(t).groupBy("unit").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("normalized_text")).cast("long").alias("chars"))


_TERMS = f"""{_UNITS}, x AS (SELECT unit, source_id, unnest({_WORDS.format('normalized_text')}) AS term FROM u), c AS (SELECT term, count(*) AS tf, count(DISTINCT unit) AS df_units, count(DISTINCT source_id) AS df_sources FROM x WHERE length(term) >= 5 GROUP BY 1)"""


def _terms(t: Tables) -> DataFrame:
    return _concept_units(t).select("unit", "source_id", F.explode(X.words(F.col("normalized_text"), r"[^\p{L}]+")).alias("term")).filter(F.length("term") >= 5)


@query(f"WITH {_TERMS}, s AS (SELECT DISTINCT unnest({_WORDS.format('label_en')}) AS term FROM passport_parameters) SELECT term, tf, df_units, df_sources, s.term IS NOT NULL AS seed FROM c LEFT JOIN s USING (term) WHERE s.term IS NOT NULL OR (tf >= 5 AND df_units >= 3 AND df_sources >= 2)")
def concept_candidates(t: Tables) -> DataFrame:
    """K-02: how often and how widely a term stands; seeds are exempt from the thresholds."""
    c = _terms(t).groupBy("term").agg(F.count(F.lit(1)).alias("tf"), F.count_distinct("unit").alias("df_units"), F.count_distinct("source_id").alias("df_sources"))
    seeds = t.passport_parameters.select(F.explode(X.words(F.col("label_en"), r"[^\p{L}]+")).alias("term")).distinct().withColumn("seed", F.lit(True))
    j = c.join(F.broadcast(seeds), "term", "left").withColumn("seed", F.coalesce("seed", F.lit(False)))
    return j.filter("seed or (tf >= 5 and df_units >= 3 and df_sources >= 2)").select("term", "tf", "df_units", "df_sources", "seed")


@query(rf"""
WITH l AS (SELECT parameter_code, lower(label_en) AS en, lower(label_ru) AS ru FROM passport_parameters), p AS (SELECT parameter_code, material_as_printed AS m, count(*) AS n FROM ({_EV}) WHERE parameter_code IS NOT NULL AND material_as_printed IS NOT NULL GROUP BY ALL)
SELECT 'SAME_AS' AS kind, en AS a, ru AS b, 1::BIGINT AS n FROM l UNION ALL SELECT 'CONTAINS', a.en, b.en, 1 FROM l a JOIN l b ON a.en <> b.en AND contains(' ' || a.en || ' ', ' ' || b.en || ' ') UNION ALL SELECT 'CO_OCCURS', en, m, n FROM p JOIN l USING (parameter_code) WHERE n >= 3 UNION ALL SELECT 'DEFINED_AS', parameter_code, en, 1 FROM l""")
def concept_edges(t: Tables) -> DataFrame:
    """K-07: four kinds of edges between terms, in one relation."""
    l = t.passport_parameters.select("parameter_code", F.lower("label_en").alias("en"), F.lower("label_ru").alias("ru"))  # noqa: E741
    one = F.lit(1).cast("long").alias("n")
    e = current(t.spark, t.sf_dir, "passport_evidence", ["parameter_code", "material_as_printed"]).filter("parameter_code is not null and material_as_printed is not null")
    p = e.groupBy("parameter_code", F.col("material_as_printed").alias("m")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")
    around = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    x, y = l.select(F.col("en").alias("a")), l.select(F.col("en").alias("b"))
    # The table of parameters is fixed and small.
    inside = x.join(F.broadcast(y), (F.col("a") != F.col("b")) & F.contains(around(F.col("a")), around(F.col("b"))))
    same = l.select(F.lit("SAME_AS").alias("kind"), F.col("en").alias("a"), F.col("ru").alias("b"), one)
    return same.unionByName(inside.select(F.lit("CONTAINS").alias("kind"), "a", "b", one)).unionByName(p.join(F.broadcast(l), "parameter_code").select(F.lit("CO_OCCURS").alias("kind"), F.col("en").alias("a"), F.col("m").alias("b"), "n")).unionByName(l.select(F.lit("DEFINED_AS").alias("kind"), F.col("parameter_code").alias("a"), F.col("en").alias("b"), one))


_PAIRED = f"""p AS (SELECT DISTINCT material_as_printed AS term, source_id AS unit FROM ({_EV}) WHERE material_as_printed IS NOT NULL AND source_id IS NOT NULL), n AS (SELECT count(DISTINCT unit) AS n FROM p), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
c AS (SELECT a.term AS a, b.term AS b, count(*) AS shared FROM p a JOIN p b ON a.unit = b.unit AND a.term <> b.term GROUP BY ALL HAVING count(*) >= 3)"""


@query(f"""WITH {_PAIRED}, v AS (SELECT a, b, shared, CASE WHEN shared >= n THEN 1 ELSE ln(shared * n / (x.df * y.df)) / -ln(shared / n) END AS npmi FROM c JOIN f x ON x.term = a JOIN f y ON y.term = b, n WHERE shared < n)
SELECT a, b, shared, {_R6.format('npmi * shared / (shared + 2)')} AS score FROM v QUALIFY row_number() OVER (PARTITION BY a ORDER BY {_R6.format('npmi * shared / (shared + 2)')} DESC, shared DESC, b) <= 5""")
def concept_neighbours(t: Tables) -> DataFrame:
    """K-09: of each term its five best neighbours by score = npmi * n / (n + 2); a source has few different terms."""
    p = current(t.spark, t.sf_dir, "passport_evidence", ["material_as_printed", "source_id"]).filter("material_as_printed is not null and source_id is not null").select(F.col("material_as_printed").alias("term"), F.col("source_id").alias("unit")).distinct()
    n = p.agg(F.count_distinct("unit").alias("n"))
    f = p.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    c = p.toDF("a", "unit").join(p.toDF("b", "unit"), "unit").filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).filter("shared >= 3")
    j = c.join(f.toDF("a", "dx"), "a").join(f.toDF("b", "dy"), "b").crossJoin(F.broadcast(n)).filter("shared < n")
    npmi = F.log(F.col("shared") * F.col("n") / (F.col("dx") * F.col("dy"))) / -F.log(F.col("shared") / F.col("n"))
    s = j.withColumn("score", round6(npmi * F.col("shared") / (F.col("shared") + 2)))
    w = Window.partitionBy("a").orderBy(F.desc("score"), F.desc("shared"), "b")
    return s.withColumn("r", F.row_number().over(w)).filter("r <= 5").select("a", "b", "shared", "score")


_DICTIONARY = f"d AS (SELECT material_as_printed AS a, parameter_code AS b, count(*) AS n FROM ({_EV}) WHERE material_as_printed IS NOT NULL AND parameter_code IS NOT NULL GROUP BY ALL), k AS (SELECT a, b, n / max(n) OVER (PARTITION BY a) AS s FROM d)"


def _dictionary(t: Tables) -> DataFrame:
    """a, b, s: a dictionary of evidence: what a word is met with, as a share of its commonest partner."""
    e = current(t.spark, t.sf_dir, "passport_evidence", ["material_as_printed", "parameter_code"]).filter("material_as_printed is not null and parameter_code is not null")
    d = e.groupBy(F.col("material_as_printed").alias("a"), F.col("parameter_code").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return d.select("a", "b", (F.col("n") / F.max("n").over(Window.partitionBy("a"))).alias("s"))


@query(f"WITH {_DICTIONARY} SELECT x.a AS a, y.a AS b, count(*) AS pivots, {_R6.format('max(x.s * y.s)')} AS score FROM k x JOIN k y ON x.b = y.b AND x.a < y.a WHERE x.s >= 0.8 AND y.s >= 0.8 GROUP BY 1, 2")
def pivot_synonyms(t: Tables) -> DataFrame:
    """K-23: two words that share a sure translation; the dictionary holds each word once per translation."""
    k = _dictionary(t).filter("s >= 0.8")
    j = k.toDF("a", "p", "x").join(k.toDF("b", "p", "y"), "p").filter("a < b")
    return j.groupBy("a", "b").agg(F.count(F.lit(1)).alias("pivots"), round6(F.max(F.col("x") * F.col("y"))).alias("score"))


@query(f"WITH {_DICTIONARY}, h AS (SELECT x.a AS a, y.b AS b, max(x.s * z.s * y.s) AS s FROM k x JOIN k z ON z.b = x.b JOIN k y ON y.a = z.a WHERE x.s >= 0.9 AND z.s >= 0.9 AND y.s >= 0.9 GROUP BY 1, 2) SELECT a, b, {_R6.format('s')} AS score FROM h WHERE s >= 0.75")
def two_hop_translations(t: Tables) -> DataFrame:
    """K-24: translations over a synonym, the best walk of each pair; weak hops end a walk."""
    k = _dictionary(t).filter("s >= 0.9")
    near = k.toDF("a", "p", "x").join(k.toDF("m", "p", "z"), "p").groupBy("a", "m").agg(F.max(F.col("x") * F.col("z")).alias("xz"))
    far = near.join(k.toDF("m", "b", "y"), "m").groupBy("a", "b").agg(F.max(F.col("xz") * F.col("y")).alias("s"))
    return far.filter("s >= 0.75").select("a", "b", round6(F.col("s")).alias("score"))


_SECTIONS = rf"""s AS (SELECT DISTINCT object_id, source_id, normalized_text AS title FROM blocks WHERE regexp_matches(normalized_text, '^[0-9]+(\.[0-9]+)* \p{{Lu}}') OR block_type = 'TITLE'), w AS (SELECT object_id, length(title) AS size, unnest(list_distinct({_WORDS.format('title')})) AS lemma FROM s), n AS (SELECT count(*) AS n FROM s),
i AS (SELECT lemma, ln((n + 1) / (count(*) + 1)) + 1 AS idf FROM w, n GROUP BY lemma, n)"""


@query(rf"""WITH {_SECTIONS}, q AS (SELECT parameter_code, unnest(list_distinct({_WORDS.format("label_en || ' ' || label_ru")})) AS lemma FROM passport_parameters), qi AS (SELECT parameter_code, lemma, coalesce(idf, (SELECT ln((n + 1) / 1) + 1 FROM n)) AS idf FROM q LEFT JOIN i USING (lemma)), tot AS (SELECT parameter_code, sum(idf) AS total FROM qi GROUP BY 1),
h AS (SELECT parameter_code, object_id, any_value(size) AS size, sum(round(idf * 16777216)::BIGINT) / 16777216 AS got FROM qi JOIN w USING (lemma) GROUP BY ALL)
SELECT parameter_code, object_id, {_R6.format('got / total')} AS score FROM h JOIN tot USING (parameter_code) QUALIFY row_number() OVER (PARTITION BY parameter_code ORDER BY {_R6.format('got / total')} DESC, size, object_id) <= 3""")
def section_search(t: Tables) -> DataFrame:
    """K-27: titles by the share of the question's words, weighted by rarity; parameters' names ask."""
    heading = F.col("normalized_text").rlike(r"^[0-9]+(\.[0-9]+)* \p{Lu}") | (F.col("block_type") == "TITLE")
    s = t.blocks.filter(heading).select("object_id", "source_id", F.col("normalized_text").alias("title")).distinct()
    words = lambda c: F.array_distinct(X.words(c, r"[^\p{L}]+"))
    w = s.select("object_id", F.length("title").alias("size"), F.explode(words(F.col("title"))).alias("lemma"))
    n = s.agg(F.count(F.lit(1)).alias("n"))
    i = w.groupBy("lemma").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("lemma", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    q = t.passport_parameters.select("parameter_code", F.explode(words(F.concat("label_en", F.lit(" "), "label_ru"))).alias("lemma"))
    # Questions are a fixed, small table; only their words are joined to titles.
    qi = F.broadcast(q).join(i, "lemma", "left").crossJoin(F.broadcast(n)).select("parameter_code", "lemma", F.coalesce("idf", F.log((F.col("n") + 1) / 1) + 1).alias("idf"))
    total = qi.groupBy("parameter_code").agg(F.sum("idf").alias("total"))
    h = w.join(qi, "lemma").groupBy("parameter_code", "object_id", "size").agg((F.sum(F.round(F.col("idf") * float(1 << 24)).cast("long")) / float(1 << 24)).alias("got"))
    r = h.join(total, "parameter_code").withColumn("score", round6(F.col("got") / F.col("total")))
    best = Window.partitionBy("parameter_code").orderBy(F.desc("score"), "size", "object_id")
    return r.withColumn("r", F.row_number().over(best)).filter("r <= 3").select("parameter_code", "object_id", "score")


_HEADED = f"""c AS ({_CELLS}), t AS (SELECT table_id, source_id, min(regexp_extract(page_id, 'p([0-9]+)$', 1))::BIGINT AS page, md5(string_agg(coalesce(text, ''), '|' ORDER BY row_no, col_no, cell_id)) AS head FROM c WHERE is_header AND page_id IS NOT NULL AND source_id IS NOT NULL GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {_HEADED}, l AS (SELECT a.table_id AS a, min(b.table_id) AS b FROM t a JOIN t b ON a.source_id = b.source_id AND a.head = b.head AND b.page = a.page + 1 GROUP BY 1),
r AS (SELECT table_id AS start, table_id AS id, 0 AS steps FROM t WHERE table_id NOT IN (SELECT b FROM l) UNION ALL SELECT r.start, l.b, steps + 1 FROM r JOIN l ON l.a = r.id) SELECT start, count(DISTINCT id) AS tables FROM r GROUP BY 1 HAVING count(DISTINCT id) > 1""")
def table_chains(t: Tables) -> DataFrame:
    """K-29: a table goes on where the next page of the source begins one under the same heading; chains by closure."""
    c = current(t.spark, t.sf_dir, "table_cells", ["table_id", "source_id", "page_id", "row_no", "col_no", "text", "is_header"]).filter("is_header and page_id is not null and source_id is not null")
    h = c.groupBy("table_id", "source_id").agg(F.min(F.regexp_extract("page_id", "p([0-9]+)$", 1)).cast("long").alias("page"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "col_no", "cell_id", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "|")).alias("head"))
    after = h.select(F.col("table_id").alias("b"), "source_id", "head", (F.col("page") - 1).alias("page"))
    l = h.join(after, ["source_id", "head", "page"]).groupBy(F.col("table_id").alias("a")).agg(F.min("b").alias("b"))  # noqa: E741
    starts = h.select(F.col("table_id").alias("src")).join(l.select(F.col("b").alias("src")), "src", "left_anti")
    far = joins.closure(t.spark, l, "a", "b").join(starts, "src", "left_semi")
    return far.groupBy(F.col("src").alias("start")).agg((F.count_distinct("dst") + 1).alias("tables"))


@query(f"""WITH m AS ({_MEMBERS}), f AS (SELECT DISTINCT unit_id FROM m WHERE containment >= 0.8 AND NOT isnan(containment) AND NOT coalesce(is_primary, false)) SELECT source_id, count(DISTINCT unit_id) AS units, count(DISTINCT unit_id) FILTER (WHERE unit_id IN (SELECT unit_id FROM f)) AS left_out FROM m WHERE source_id IS NOT NULL GROUP BY 1""")
def copy_filter(t: Tables) -> DataFrame:
    """D-08d: units that stand elsewhere for the most part and aren't the reference don't count in statistics."""
    m = current(t.spark, t.sf_dir, "nav_dup_members", ["source_id", "containment", "is_primary"])
    f = m.filter("containment >= 0.8 and not isnan(containment) and not coalesce(is_primary, false)").select("unit_id").distinct().withColumn("out", F.lit(True))
    return m.filter("source_id is not null").join(f, "unit_id", "left").groupBy("source_id").agg(F.count_distinct("unit_id").alias("units"), F.count_distinct(F.when(F.col("out"), F.col("unit_id"))).alias("left_out"))


@query(r"""
WITH s AS (SELECT doc_id, coalesce(source, '') AS source, unnest(list_filter(string_split_regex(text, '[.!?]\s+'), lambda x: length(x) >= 40)) AS s FROM documents WHERE text IS NOT NULL), d AS (SELECT DISTINCT source, md5(s) AS h FROM s), n AS (SELECT h, count(*) AS sources FROM d GROUP BY 1)
SELECT doc_id, count(*) AS sentences, count(*) FILTER (WHERE sources > 1) AS shared FROM s JOIN n ON n.h = md5(s.s) GROUP BY 1 HAVING count(*) FILTER (WHERE sources > 1) * 2 >= count(*)""")
def shared_sentences(t: Tables) -> DataFrame:
    """D-08e: texts half of whose sentences other sources have too; only their hashes are shuffled."""
    s = t.documents.filter("text is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.explode(F.filter(F.split("text", r"[.!?]\s+"), lambda x: F.length(x) >= 40)).alias("s")).select("doc_id", "source", F.md5("s").alias("h"))
    n = s.groupBy("h").agg(F.count_distinct("source").alias("sources"))
    return s.join(n, "h").groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.count_if(F.col("sources") > 1).alias("shared")).filter("shared * 2 >= sentences")


@query(f"""
WITH v AS (SELECT table_id, row_no, col_no, regexp_replace(replace(text, ',', '.'), '[^0-9.]', '', 'g') AS x FROM ({_CELLS}) WHERE regexp_full_match(text, '[0-9][0-9 ]*([.,][0-9]+)?')), g AS (SELECT table_id, list(x ORDER BY row_no, col_no) AS l FROM v GROUP BY 1),
w AS (SELECT DISTINCT table_id, array_to_string(l[i:i + 2], ' ') AS g FROM g, LATERAL (SELECT unnest(range(1, len(l) - 1)) AS i) r WHERE len(list_filter(l[i:i + 2], lambda x: contains(x, '.') OR length(x) >= 3)) >= 2 AND len(l) >= 3)
SELECT a.table_id AS a, b.table_id AS b, count(*) AS shared FROM w a JOIN w b ON a.g = b.g AND a.table_id < b.table_id GROUP BY ALL""")
def number_windows(t: Tables) -> DataFrame:
    """D-09, D-13: tables that share runs of three numbers, two of them informative."""
    v = current(t.spark, t.sf_dir, "table_cells", ["table_id", "row_no", "col_no", "text"]).filter(F.col("text").rlike("^[0-9][0-9 ]*([.,][0-9]+)?$"))
    x = F.regexp_replace(F.replace("text", F.lit(","), F.lit(".")), "[^0-9.]", "")
    g = v.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "col_no", "cell_id", x.alias("x")))), lambda s: s["x"]).alias("l")).filter("size(l) >= 3")
    runs = F.transform(F.sequence(F.lit(1), F.size("l") - 2), lambda i: F.slice("l", i, 3))
    kept = F.filter(runs, lambda r: F.size(F.filter(r, lambda y: F.contains(y, F.lit(".")) | (F.length(y) >= 3))) >= 2)
    w = g.select("table_id", F.explode(F.array_distinct(F.transform(kept, lambda r: F.array_join(r, " ")))).alias("g"))
    return w.toDF("a", "g").join(w.toDF("b", "g"), "g").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT a.source_id AS a, b.source_id AS b FROM nav_dup_members a JOIN nav_dup_members b ON a.cluster_id = b.cluster_id AND a.source_id <> b.source_id WHERE a.kind = 'REPRINT' AND b.kind = 'REPRINT'), r AS (SELECT a AS id, a AS far FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.far)
SELECT id AS source_id, min(far) AS publication FROM r GROUP BY 1""")
def publication_groups(t: Tables) -> DataFrame:
    """D-15: sources that reprint one another, directly or through others; each member is linked to its cluster's first source."""
    m = t.nav_dup_members.filter("kind = 'REPRINT' and source_id is not null").select("cluster_id", "source_id").distinct()
    first = m.groupBy("cluster_id").agg(F.min("source_id").alias("a"))
    links = m.join(first, "cluster_id").filter("source_id <> a").select("a", F.col("source_id").alias("b")).distinct()
    return duplicates.label_propagation(t.spark, links).select(F.col("id").alias("source_id"), F.col("label").alias("publication"))


@query("""
WITH m AS (SELECT DISTINCT cluster_id, object_id, page_id, max(CASE WHEN isnan(caption_similarity) THEN NULL ELSE caption_similarity END) OVER (PARTITION BY cluster_id, object_id) AS c FROM object_dup_members WHERE page_id IS NOT NULL), k AS (SELECT cluster_id, count(DISTINCT object_id) AS objects, count(DISTINCT page_id) AS pages, max(c) AS best, count(DISTINCT object_id) FILTER (WHERE c >= 0.7) AS alike FROM m GROUP BY 1)
SELECT cluster_id, objects, pages, alike, floor(best * 1e6 + 0.5) / 1e6 AS best FROM k WHERE alike >= 2 OR pages = 1""")
def caption_evidence(t: Tables) -> DataFrame:
    """D-12: clusters of objects that at least two captions or one page speak for."""
    c = F.when(~F.isnan("caption_similarity"), F.col("caption_similarity"))
    m = t.object_dup_members.filter("page_id is not null").groupBy("cluster_id", "object_id", "page_id").agg(F.max(c).alias("c"))
    own = m.groupBy("cluster_id", "object_id").agg(F.max("c").alias("c"))
    k = own.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("objects"), F.max("c").alias("best"), F.count_if(F.col("c") >= 0.7).alias("alike"))
    pages = m.groupBy("cluster_id").agg(F.count_distinct("page_id").alias("pages"))
    return k.join(pages, "cluster_id").filter("alike >= 2 or pages = 1").select("cluster_id", "objects", "pages", "alike", round6(F.col("best")).alias("best"))
