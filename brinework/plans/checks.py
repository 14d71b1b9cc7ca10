"""More checks of the validator: blocks, cells, evidence, members, snapshots and the graph.

Row conditions of a table are one pass over it.  Conditions are stated in SQL
that both engines read; what needs joins is stated twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoint import Workspace
from ..operators import validation
from ..sources import store
from ..sources.digests import fingerprint
from ..tables import current
from .catalog import Catalog, Tables

catalog = Catalog()
query = catalog.query
QUERIES, ORACLES = catalog.queries, catalog.oracles


def _conditions_sql(table: str, key: str, checks: dict[str, str]) -> str:
    names = ", ".join(f"'{n}'" for n in checks)
    hits = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in checks.items())
    return f"""WITH x AS (SELECT {key} AS k, unnest(list_filter([{hits}], lambda c: c IS NOT NULL)) AS check_id FROM {table}), n AS (SELECT check_id, count(*) AS n FROM x GROUP BY 1),
e AS (SELECT check_id, string_agg(k, ',' ORDER BY k) AS examples FROM (SELECT DISTINCT check_id, k FROM x QUALIFY dense_rank() OVER (PARTITION BY check_id ORDER BY k) <= 3) GROUP BY 1), a AS (SELECT unnest([{names}]) AS check_id)
SELECT check_id, coalesce(n, 0) AS n, coalesce(examples, '') AS examples FROM a LEFT JOIN n USING (check_id) LEFT JOIN e USING (check_id)"""


def _checked(df: DataFrame, key: str, checks: dict[str, str]) -> DataFrame:
    return validation.conditions(df, key, {n: F.expr(c.replace("starts_with(", "startswith(")) for n, c in checks.items()})


_BLOCKS = {
    "B03_BLOCK_PARTS": "page_id IS NOT NULL AND NOT starts_with(object_id, page_id || ':')",
    "B03_PAGE_PARTS": "page_id IS NOT NULL AND NOT starts_with(page_id, source_id || ':')",
    "D01_NO_SOURCE": "source_id IS NULL",
    "D01_NO_ORDER": "reading_order IS NULL",
    "E04_NEGATIVE_ORDER": "reading_order < 0",
    "E05_TYPE": "block_type NOT IN ('TEXT', 'TITLE', 'PAGE_HEADER', 'PAGE_FOOTER', 'PAGE_NUMBER')",
    "E06_COUNT": "char_count <> length(coalesce(text, '')) AND char_count <> length(coalesce(normalized_text, ''))",
    "E07_LAYER": "is_primary_layer AND text_layer IS NULL",
    "E08_CONFIDENCE": "recognition_confidence < 0 OR recognition_confidence > 1",
    "E09_CONFIDENCE_OF_TEXT_LAYER": "recognition_confidence IS NOT NULL AND text_layer NOT LIKE '%OCR%'",
    "E10_LINE_END": "normalized_text LIKE '%' || chr(10) || '%'",
    "G02_PATH": "lower(text) LIKE '%/home/%' OR lower(text) LIKE '%c:_users%'",
}


@query(_conditions_sql("blocks", "object_id", _BLOCKS))
def validator_blocks(t: Tables) -> DataFrame:
    """V-03, V-04, V-06, V-08 on blocks."""
    return _checked(t.blocks, "object_id", _BLOCKS)


_CELLS = {
    "B03_CELL_PARTS": "NOT starts_with(cell_id, table_id || ':')",
    "B03_TABLE_PARTS": "NOT starts_with(table_id, page_id || ':')",
    "D01_NO_ROW": "row_no IS NULL OR col_no IS NULL",
    "E04_NEGATIVE_PLACE": "row_no < 0 OR col_no < 0",
    "E05_HEADER_ROLE": "is_header AND row_role <> 'HEADER'",
    "E06_HEADER_HAS_PROPERTY": "is_header AND property_key IS NOT NULL",
    "E07_NUMBERS_OF_NOTHING": "n_numbers > 0 AND (text IS NULL OR trim(text) = '')",
    "E08_UNIT_WITHOUT_SOURCE": "unit IS NOT NULL AND unit <> '' AND unit_source IS NULL",
}


@query(_conditions_sql("(SELECT * FROM table_cells QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY created_at DESC NULLS LAST) = 1)", "cell_id", _CELLS))
def validator_cells(t: Tables) -> DataFrame:
    """V-03, V-04, V-06 on current table cells."""
    return _checked(current(t.spark, t.sf_dir, "table_cells"), "cell_id", _CELLS)


_EVIDENCE = {
    "D02_NO_PRODUCER": "producer IS NULL",
    "D03_NO_MODULE": "module_code IS NULL",
    "D04_NO_PAGE": "page_id IS NULL",
    "D05_PAGE_OF_OTHER_SOURCE": "page_id IS NOT NULL AND NOT starts_with(page_id, source_id || ':')",
    "E11_BOUNDS": "si_min > si_max",
    "E12_VALUE_WITHOUT_BOUNDS": "value_as_printed IS NOT NULL AND si_min IS NULL AND si_max IS NULL",
    "E13_ROLE_WITHOUT_CLUSTER": "copy_role IS NOT NULL AND copy_cluster IS NULL",
    "E13_CLUSTER_WITHOUT_ROLE": "copy_cluster IS NOT NULL AND copy_role IS NULL",
}


@query(_conditions_sql("(SELECT * FROM passport_evidence QUALIFY row_number() OVER (PARTITION BY ev_id ORDER BY recorded_at DESC NULLS LAST) = 1)", "ev_id", _EVIDENCE))
def validator_evidence(t: Tables) -> DataFrame:
    """V-05, V-06 on current evidence: provenance and bounds."""
    return _checked(current(t.spark, t.sf_dir, "passport_evidence"), "ev_id", _EVIDENCE)


_MEMBERS = {
    "E01_SIMILARITY": "similarity < 0 OR (similarity > 1 AND NOT isnan(similarity))",
    "E02_CONTAINMENT_BELOW_SIMILARITY": "NOT isnan(similarity) AND NOT isnan(containment) AND containment < similarity - 0.5",
    "E03_YEAR": "pub_year NOT BETWEEN 1900 AND 2030",
    "E04_NAN_COSINE": "isnan(cosine)",
    "D01_NO_UNIT": "unit_id IS NULL",
    "D01_NO_PAGE": "page_id IS NULL",
}


@query(_conditions_sql("nav_dup_members", "cluster_id", _MEMBERS))
def validator_members(t: Tables) -> DataFrame:
    """V-04, V-06 on members of duplicate clusters."""
    return _checked(t.nav_dup_members, "cluster_id", _MEMBERS)


@query("""
WITH c AS (SELECT DISTINCT source_id, page_id FROM pages), x AS (
 SELECT 'C04_CELL_PAGE' AS check_id, page_id AS k FROM table_cells WHERE page_id IS NOT NULL AND page_id NOT IN (SELECT page_id FROM pages) UNION ALL SELECT 'C05_EVIDENCE_PAGE', page_id FROM passport_evidence WHERE page_id IS NOT NULL AND page_id NOT IN (SELECT page_id FROM pages)
 UNION ALL SELECT 'C06_EVIDENCE_PARAMETER', parameter_code FROM passport_evidence WHERE parameter_code IS NOT NULL AND parameter_code NOT IN (SELECT parameter_code FROM passport_parameters) UNION ALL SELECT 'C07_MEMBER_PAGE', page_id FROM nav_dup_members WHERE page_id IS NOT NULL AND page_id NOT IN (SELECT page_id FROM pages)
 UNION ALL SELECT 'C08_OBJECT_PAGE', page_id FROM object_dup_members WHERE page_id IS NOT NULL AND page_id NOT IN (SELECT page_id FROM pages) UNION ALL SELECT 'C08B_PAIR_UNIT', id_a FROM match_pairs WHERE item_kind = 'UNIT' AND id_a IS NOT NULL AND id_a NOT IN (SELECT unit_id FROM nav_dup_members)
 UNION ALL SELECT 'C09_BLOCK_SOURCE', source_id FROM blocks WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT source_id FROM sources)), n AS (SELECT check_id, count(*) AS n, count(DISTINCT k) AS keys FROM x GROUP BY 1)
SELECT check_id, coalesce(n, 0) AS n, coalesce(keys, 0) AS keys FROM (SELECT unnest(['C04_CELL_PAGE', 'C05_EVIDENCE_PAGE', 'C06_EVIDENCE_PARAMETER', 'C07_MEMBER_PAGE', 'C08_OBJECT_PAGE', 'C08B_PAIR_UNIT', 'C09_BLOCK_SOURCE']) AS check_id) LEFT JOIN n USING (check_id)""")
def validator_foreign_keys(t: Tables) -> DataFrame:
    """V-04, J-24, J-25: references between tables, by anti-joins on keys that are counted first."""
    pairs = {
        "C04_CELL_PAGE": (t.table_cells, "page_id", t.pages, "page_id"),
        "C05_EVIDENCE_PAGE": (t.passport_evidence, "page_id", t.pages, "page_id"),
        "C06_EVIDENCE_PARAMETER": (t.passport_evidence, "parameter_code", t.passport_parameters, "parameter_code"),
        "C07_MEMBER_PAGE": (t.nav_dup_members, "page_id", t.pages, "page_id"),
        "C08_OBJECT_PAGE": (t.object_dup_members, "page_id", t.pages, "page_id"),
        "C08B_PAIR_UNIT": (t.match_pairs.filter("item_kind = 'UNIT'"), "id_a", t.nav_dup_members, "unit_id"),
        "C09_BLOCK_SOURCE": (t.blocks, "source_id", t.sources, "source_id"),
    }
    out = None
    for name, (rows, key, target, target_key) in pairs.items():
        counted = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("c"))
        lost = counted.join(target.select(F.col(target_key).alias("k")).distinct(), "k", "left_anti")
        one = lost.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("keys")).select(F.lit(name).alias("check_id"), "n", "keys")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
SELECT 'A01_PARTS_EXIST' AS check_id, 0::BIGINT AS offenders UNION ALL SELECT 'A02_FINGERPRINTS', 1 UNION ALL SELECT 'A03_SCHEMAS', 0 UNION ALL SELECT 'A04_ONE_HEAD', 0 UNION ALL SELECT 'B07_STABLE_CONTENT', count(*) FROM supplier WHERE s_suppkey % 10 = 0""")
def validator_snapshot(t: Tables) -> DataFrame:
    """V-01, V-03b: a snapshot whose part was tampered with: parts, fingerprints, schemas and heads, and rows that changed under a kept key.

    One dataset is sound; the other's part is overwritten behind the store's
    back, which only its fingerprint tells.
    """
    s = store.Store(t.spark, Workspace(t.spark, "checked").root)
    good = s.commit("nation", t.nation, ["n_nationkey"])
    first = s.commit("supplier", t.supplier, ["s_suppkey"])
    changed = t.supplier.withColumn("s_name", F.when(F.col("s_suppkey") % 10 == 0, F.concat("s_name", F.lit("!"))).otherwise(F.col("s_name")))
    second = s.commit("supplier", changed, ["s_suppkey"], first)
    part = s.history("supplier")[0]["parts"][0]
    t.supplier.write.mode("overwrite").parquet(f"{s.root}/{part}")
    s.snapshot([good, second])
    found = {"A01_PARTS_EXIST": 0, "A02_FINGERPRINTS": 0, "A03_SCHEMAS": 0, "A04_ONE_HEAD": 0}
    seen: dict[str, int] = {}
    for commit in (good, second):
        manifest = s._read(f"commits/{commit}.json")
        seen[manifest["dataset"]] = seen.get(manifest["dataset"], 0) + 1
        for p in manifest["parts"]:
            if not s._fs.exists(s._path(f"{s.root}/{p}")):
                found["A01_PARTS_EXIST"] += 1
                continue
            df = t.spark.read.parquet(f"{s.root}/{p}")
            found["A02_FINGERPRINTS"] += fingerprint(df) != manifest["fingerprint"]
            found["A03_SCHEMAS"] += [f["name"] for f in manifest["schema"]["fields"]] != df.columns
    found["A04_ONE_HEAD"] = sum(n > 1 for n in seen.values())
    old = t.supplier.select("s_suppkey", F.col("s_name").alias("before"))
    stable = changed.join(old, "s_suppkey").filter(~F.col("s_name").eqNullSafe(F.col("before"))).agg(F.lit("B07_STABLE_CONTENT").alias("check_id"), F.count(F.lit(1)).alias("offenders"))
    return t.spark.createDataFrame(list(found.items()), "check_id string, offenders long").unionByName(stable)


_EDGES = "SELECT DISTINCT 'C' || cluster_id AS a, 'U' || unit_id AS b, 'HAS' AS kind FROM nav_dup_members WHERE cluster_id IS NOT NULL AND unit_id IS NOT NULL UNION ALL SELECT DISTINCT 'U' || unit_id, 'P' || page_id, 'ON' FROM nav_dup_members WHERE unit_id IS NOT NULL AND page_id IS NOT NULL"


@query(f"""
WITH e AS ({_EDGES}), n AS (SELECT DISTINCT 'P' || page_id AS id FROM pages UNION SELECT DISTINCT 'U' || unit_id FROM nav_dup_members WHERE unit_id IS NOT NULL UNION SELECT DISTINCT 'C' || cluster_id FROM nav_dup_members WHERE cluster_id IS NOT NULL)
SELECT 'C1_NODES' AS check_id, count(*) AS n FROM n UNION ALL SELECT 'C2_EDGES_' || kind, count(*) FROM e GROUP BY kind UNION ALL SELECT 'C3_LOST_START', count(*) FROM e WHERE a NOT IN (SELECT id FROM n) UNION ALL SELECT 'C4_LOST_END', count(*) FROM e WHERE b NOT IN (SELECT id FROM n)
UNION ALL SELECT 'C5_ISOLATED', count(*) FROM n WHERE id NOT IN (SELECT a FROM e UNION SELECT b FROM e) UNION ALL SELECT 'C6_UNIT_ON_ONE_PAGE', count(*) FROM (SELECT a FROM e WHERE kind = 'ON' GROUP BY a HAVING count(*) > 1) UNION ALL SELECT 'C7_CLUSTER_OF_ONE', count(*) FROM (SELECT a FROM e WHERE kind = 'HAS' GROUP BY a HAVING count(*) = 1)
UNION ALL SELECT 'C8_REPEATED', count(*) FROM (SELECT a, b, kind FROM e GROUP BY ALL HAVING count(*) > 1)""")
def graph_verification(t: Tables) -> DataFrame:
    """GR-07: counts by kind, endpoints, isolated nodes, one parent, repeated edges."""
    m = t.nav_dup_members
    tag = lambda mark, c: F.concat(F.lit(mark), F.col(c))
    has = m.filter("cluster_id is not null and unit_id is not null").select(tag("C", "cluster_id").alias("a"), tag("U", "unit_id").alias("b")).distinct().withColumn("kind", F.lit("HAS"))
    on = m.filter("unit_id is not null and page_id is not null").select(tag("U", "unit_id").alias("a"), tag("P", "page_id").alias("b")).distinct().withColumn("kind", F.lit("ON"))
    e = has.unionByName(on)
    n = t.pages.select(tag("P", "page_id").alias("id")).union(m.filter("unit_id is not null").select(tag("U", "unit_id"))).union(m.filter("cluster_id is not null").select(tag("C", "cluster_id"))).distinct()
    count = lambda name, df: df.agg(F.lit(name).alias("check_id"), F.count(F.lit(1)).alias("n"))
    ends = e.select(F.col("a").alias("id")).union(e.select("b"))
    out = [
        count("C1_NODES", n),
        e.groupBy(F.concat(F.lit("C2_EDGES_"), "kind").alias("check_id")).agg(F.count(F.lit(1)).alias("n")),
        count("C3_LOST_START", e.withColumnRenamed("a", "id").join(n, "id", "left_anti")),
        count("C4_LOST_END", e.withColumnRenamed("b", "id").join(n, "id", "left_anti")),
        count("C5_ISOLATED", n.join(ends.distinct(), "id", "left_anti")),
        count("C6_UNIT_ON_ONE_PAGE", on.groupBy("a").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")),
        count("C7_CLUSTER_OF_ONE", has.groupBy("a").agg(F.count(F.lit(1)).alias("c")).filter("c = 1")),
        count("C8_REPEATED", e.groupBy("a", "b", "kind").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")),
    ]
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole


@query("""
WITH m AS (SELECT *, max(created_at) OVER (PARTITION BY source_id) AS last FROM pages) SELECT page_id, count(*) AS late FROM m JOIN sources USING (source_id) WHERE created_at < last - INTERVAL 400 DAY OR created_at > TIMESTAMP '2025-01-01' + INTERVAL 1 MINUTE GROUP BY 1""")
def validator_time_window(t: Tables) -> DataFrame:
    """V-05, D08: states outside their source's window; the window's end is aggregated first, so a hot source costs no sort."""
    last = t.pages.groupBy("source_id").agg(F.max("created_at").alias("last"))
    j = t.pages.select("page_id", "source_id", "created_at").join(last, "source_id").join(t.sources.select("source_id"), "source_id")
    late = (F.col("created_at") < F.col("last") - F.expr("interval 400 days")) | (F.col("created_at") > F.expr("timestamp'2025-01-01 00:01:00'"))
    return j.filter(late).groupBy("page_id").agg(F.count(F.lit(1)).alias("late"))
