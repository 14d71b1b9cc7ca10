"""What texts mention: references, parameters with their numbers, definitions, seams, names, terms of headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import text_list
from ..operators import retrieval
from ..tables import current
from .catalog import Catalog, Tables
from .vectors import _DENSE, _dense

catalog = Catalog()
query = catalog.query
QUERIES, ORACLES = catalog.queries, catalog.oracles

_LINES = r"(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no FROM documents WHERE text IS NOT NULL)"
_REFERENCE = r"^\s*(?:\[[0-9]+\]|[0-9]+[.)])\s+\S"


def _lines(t: Tables) -> DataFrame:
    return t.documents.filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line")).withColumn("no", F.col("no") + 1)


@query(rf"""
SELECT doc_id, no::BIGINT AS no, regexp_extract(line, '^\s*(?:\[([0-9]+)\]|([0-9]+)[.)])', 1) || regexp_extract(line, '^\s*(?:\[([0-9]+)\]|([0-9]+)[.)])', 2) AS number, regexp_extract(line, '\b((?:19|20)[0-9]{{2}})\b', 1) AS year, regexp_extract(lower(line), '(10\.[0-9]{{4,9}}/[^\s,;]+)', 1) AS doi,
 regexp_replace(regexp_extract(line, '(?i)isbn[: ]*([0-9xX-]{{10,17}})', 1), '-', '', 'g') AS isbn, len(regexp_extract_all(line, '\p{{Lu}}\p{{Ll}}+,? \p{{Lu}}\.')) AS authors FROM {_LINES} WHERE regexp_matches(line, '{_REFERENCE}')""")
def reference_fields(t: Tables) -> DataFrame:
    """X-18: numbered lines of lists with the year, DOI, ISBN and authors they name."""
    line = F.col("line")
    number = F.concat(*(F.regexp_extract(line, r"^\s*(?:\[([0-9]+)\]|([0-9]+)[.)])", g) for g in (1, 2)))
    rows = _lines(t).filter(line.rlike(_REFERENCE))
    return rows.select(
        "doc_id", F.col("no").cast("long").alias("no"), number.alias("number"), F.regexp_extract(line, r"\b((?:19|20)[0-9]{2})\b", 1).alias("year"), F.regexp_extract(F.lower(line), r"(10\.[0-9]{4,9}/[^\s,;]+)", 1).alias("doi"),
        F.regexp_replace(F.regexp_extract(line, r"(?i)isbn[: ]*([0-9xX-]{10,17})", 1), "-", "").alias("isbn"), F.size(F.regexp_extract_all(line, F.lit(r"\p{Lu}\p{Ll}+,? \p{Lu}\."), F.lit(0))).cast("long").alias("authors"),
    )


@query("""
WITH l AS (SELECT parameter_code, lower(label_ru) AS label FROM passport_parameters UNION SELECT parameter_code, lower(label_en) FROM passport_parameters), b AS (SELECT DISTINCT object_id, lower(normalized_text) AS t FROM blocks WHERE normalized_text IS NOT NULL),
h AS (SELECT object_id, parameter_code, t, label, position(label IN t) AS place FROM b JOIN l ON contains(t, label)) SELECT object_id, parameter_code, min(place)::BIGINT AS place, max(regexp_extract(substr(t, place + length(label), 60), '([0-9]+(?:[.,][0-9]+)?)', 1)) AS number FROM h GROUP BY 1, 2""")
def parameter_mentions(t: Tables) -> DataFrame:
    """X-13: parameters named in a block and the number that follows within sixty characters."""
    p = t.passport_parameters
    # The names of the fixed table of parameters, a few dozen rows.
    l = F.broadcast(p.select("parameter_code", F.lower("label_ru").alias("label")).union(p.select("parameter_code", F.lower("label_en"))).distinct())  # noqa: E741
    b = t.blocks.filter("normalized_text is not null").select("object_id", F.lower("normalized_text").alias("t")).distinct()
    h = b.join(l, F.contains("t", "label")).withColumn("place", F.position("label", "t"))
    number = F.regexp_extract(F.substring("t", F.col("place") + F.length("label"), F.lit(60)), r"([0-9]+(?:[.,][0-9]+)?)", 1)
    return h.groupBy("object_id", "parameter_code").agg(F.min("place").cast("long").alias("place"), F.max(number).alias("number"))


_SEAM = r"(?:пласт[а-я]*|seams?|bed|Flöz[a-z]*)\s+([A-ZА-Я][A-Za-zА-Яа-я]{0,2}-?[0-9]{1,2})"


@query(rf"""
WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_SEAM}', 1)) AS raw FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, raw, replace(translate(upper(raw), 'АВЕКМНОРСТХ', 'ABEKMHOPCTX'), '-', '') AS key FROM s)
SELECT key, count(*) AS n, count(DISTINCT doc_id) AS docs, string_agg(DISTINCT raw, ',' ORDER BY raw) AS spellings FROM k GROUP BY 1""")
def seam_keys(t: Tables) -> DataFrame:
    """X-28: names of seams under one key, whatever script and hyphen they are written with."""
    s = t.documents.filter("text is not null").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_SEAM), F.lit(1))).alias("raw"))
    k = s.withColumn("key", F.replace(F.translate(F.upper("raw"), "АВЕКМНОРСТХ", "ABEKMHOPCTX"), F.lit("-"), F.lit("")))
    return k.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"), text_list(F.array_sort(F.collect_set("raw"))).alias("spellings"))


@query(r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:где|where|wobei|here)\s+([^.;\n]{3,80})[.;\n]', 1)) AS said FROM documents WHERE text IS NOT NULL) SELECT doc_id, said, regexp_extract(said, '^(\S{1,12})\s+(?:[-–—=]|is|ist)\s', 1) AS symbol FROM d""")
def definitions(t: Tables) -> DataFrame:
    """X-17: what stands behind "where", and the symbol it explains if it names one."""
    said = F.explode(F.regexp_extract_all("text", F.lit(r"(?:где|where|wobei|here)\s+([^.;\n]{3,80})[.;\n]"), F.lit(1)))
    return t.documents.filter("text is not null").select("doc_id", said.alias("said")).withColumn("symbol", F.regexp_extract("said", r"^(\S{1,12})\s+(?:[-–—=]|is|ist)\s", 1))


# Cyrillic letters and the Latin ones of a rough skeleton.
_CYRILLIC, _LATIN = "абвгдезийклмнопрстуфхыэ", "abvgdeziiklmnoprstufhye"


@query(rf"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\p{{Lu}}\p{{L}}{{3,}}')) AS name FROM documents WHERE text IS NOT NULL), k AS (SELECT name, regexp_replace(regexp_replace(translate(replace(lower(name), 'ё', 'е'), '{_CYRILLIC}', '{_LATIN}'), '[^a-z]', '', 'g'), '[aeiouy]', '', 'g') AS k FROM w)
SELECT k AS skeleton, count(*) AS names, min(name) AS first FROM k WHERE length(k) >= 3 GROUP BY 1 HAVING count(*) > 1""")
def name_skeletons(t: Tables) -> DataFrame:
    """X-21: names of either script that share their consonants."""
    w = t.documents.filter("text is not null").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{L}{3,}"), F.lit(0))).alias("name")).distinct()
    k = F.regexp_replace(F.regexp_replace(F.translate(F.replace(F.lower("name"), F.lit("ё"), F.lit("е")), _CYRILLIC, _LATIN), "[^a-z]", ""), "[aeiouy]", "")
    return w.withColumn("skeleton", k).filter(F.length("skeleton") >= 3).groupBy("skeleton").agg(F.count(F.lit(1)).alias("names"), F.min("name").alias("first")).filter("names > 1")


@query(r"""
WITH l AS (SELECT parameter_code, string_split(lower(label_ru), ' ') AS w, lower(label_ru) AS term FROM passport_parameters), q AS (SELECT ev_id, lower(quote) AS t FROM (SELECT * FROM passport_evidence QUALIFY row_number() OVER (PARTITION BY ev_id ORDER BY recorded_at DESC NULLS LAST) = 1) WHERE quote IS NOT NULL),
m AS (SELECT ev_id, parameter_code, CASE WHEN contains(t, term) THEN 'FULL' WHEN contains(t, list_reduce(w[1:greatest(1, len(w) - 1)], lambda a, b: a || ' ' || b)) THEN 'PREFIX' ELSE 'SUBSPAN' END AS how, CASE WHEN contains(t, term) THEN 1 WHEN contains(t, list_reduce(w[1:greatest(1, len(w) - 1)], lambda a, b: a || ' ' || b)) THEN 2 ELSE 3 END AS rank FROM q JOIN l ON contains(t, term) OR contains(t, list_reduce(w[1:greatest(1, len(w) - 1)], lambda a, b: a || ' ' || b)) OR contains(t, w[len(w)]))
SELECT ev_id, parameter_code, how FROM m QUALIFY row_number() OVER (PARTITION BY ev_id ORDER BY rank, parameter_code) = 1""")
def definition_terms(t: Tables) -> DataFrame:
    """GR-09: the term a quote names whole, by its beginning or by its last word, the surest first."""
    w = F.split(F.lower("label_ru"), " ")
    l = F.broadcast(t.passport_parameters.select("parameter_code", F.lower("label_ru").alias("term"), F.array_join(F.slice(w, F.lit(1), F.greatest(F.lit(1), F.size(w) - 1)), " ").alias("head"), F.element_at(w, -1).alias("last")))  # noqa: E741
    q = current(t.spark, t.sf_dir, "passport_evidence", ["quote"]).filter("quote is not null").select("ev_id", F.lower("quote").alias("t"))
    full, head, last = (F.contains("t", c) for c in ("term", "head", "last"))
    m = q.join(l, full | head | last).withColumn("rank", F.when(full, 1).when(head, 2).otherwise(3))
    best = Window.partitionBy("ev_id").orderBy("rank", "parameter_code")
    return m.withColumn("r", F.row_number().over(best)).filter("r = 1").select("ev_id", "parameter_code", F.element_at(F.array(F.lit("FULL"), F.lit("PREFIX"), F.lit("SUBSPAN")), F.col("rank")).alias("how"))


@query(f"""WITH {_DENSE}, own AS (SELECT vec_id AS qid, label AS mine FROM embeddings), f AS (SELECT qid, doc, rank, label = mine AND doc % 3 = 0 AS named FROM dense JOIN d USING (doc) JOIN own USING (qid) WHERE rank <= 20)
SELECT qid, doc, named, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN rank <= 10 AND named THEN 0 WHEN rank <= 10 THEN 1 ELSE 2 END, rank) AS position FROM f""")
def named_route(t: Tables) -> DataFrame:
    """R-17, T-06: what the question names by its group and number comes first among the first ten."""
    label = t.embeddings.select("vec_id", "label")
    f = _dense(t, 20).join(label.toDF("doc", "label"), "doc").join(label.toDF("qid", "mine"), "qid").withColumn("named", (F.col("label") == F.col("mine")) & (F.col("doc") % 3 == 0))
    return retrieval.head_promotion(f, "named", 10).select("qid", "doc", "named", F.col("position").cast("long").alias("position"))
