"""Validation reports, fingerprints and incremental plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import validation
from ..sources import digests
from ..tables import current
from .catalog import Catalog, Tables

catalog = Catalog()
query = catalog.query
QUERIES, ORACLES = catalog.queries, catalog.oracles


@query("""
WITH x AS (
 SELECT 'B01_ORDERS' AS check_id, o_orderkey::VARCHAR AS k FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
 UNION ALL SELECT 'B01_PAGES', page_id FROM (SELECT page_id FROM pages GROUP BY 1 HAVING count(*) > 1)
 UNION ALL SELECT 'C01_PAGE_SOURCE', source_id FROM pages WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT source_id FROM sources)
 UNION ALL SELECT 'C02_BLOCK_PAGE', page_id FROM blocks WHERE page_id IS NOT NULL AND page_id NOT IN (SELECT page_id FROM pages)
 UNION ALL SELECT 'C03_LINE_ORDER', l_orderkey::VARCHAR FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)),
n AS (SELECT check_id, count(*) AS n FROM x GROUP BY 1), e AS (SELECT check_id, string_agg(k, ',' ORDER BY k) AS examples FROM (SELECT DISTINCT check_id, k FROM x QUALIFY dense_rank() OVER (PARTITION BY check_id ORDER BY k) <= 3) GROUP BY 1),
a AS (SELECT unnest(['B01_ORDERS', 'B01_PAGES', 'C01_PAGE_SOURCE', 'C02_BLOCK_PAGE', 'C03_LINE_ORDER']) AS check_id)
SELECT check_id, coalesce(n, 0) AS n, coalesce(examples, '') AS examples, CASE WHEN coalesce(n, 0) = 0 THEN 'PASS' WHEN check_id IN ('C01_PAGE_SOURCE') THEN 'WARN' ELSE 'FAIL' END AS status FROM a LEFT JOIN n USING (check_id) LEFT JOIN e USING (check_id)""")
def validator_references(t: Tables) -> DataFrame:
    """V-02, V-04, V-10: keys and references."""
    report = validation.offenders(
        {
            "B01_ORDERS": validation.duplicate_keys(t.orders, "o_orderkey"),
            "B01_PAGES": validation.duplicate_keys(t.pages, "page_id"),
            "C01_PAGE_SOURCE": validation.missing_targets(t.pages, "source_id", t.sources, "source_id"),
            "C02_BLOCK_PAGE": validation.missing_targets(t.blocks, "page_id", t.pages, "page_id"),
            "C03_LINE_ORDER": validation.missing_targets(t.lineitem, "l_orderkey", t.orders, "o_orderkey"),
        }
    )
    return validation.verdict(report, ["C01_PAGE_SOURCE"])


@query(r"""
WITH x AS (SELECT page_id AS k, unnest(list_filter([CASE WHEN NOT regexp_full_match(page_id, '[A-Z]+-SRC-[0-9]+:p[0-9]{7}') THEN 'B02_GRAMMAR' END, CASE WHEN NOT starts_with(page_id, source_id || ':') THEN 'B03_PARTS' END, CASE WHEN primary_text_origin IS NULL THEN 'D01_NULL' END,
 CASE WHEN page_status IN ('FAILED', 'OCR_REQUIRED', 'NOT_PROCESSED') AND normalized_text IS NOT NULL THEN 'E01_STATUS' END, CASE WHEN char_count <> coalesce(length(normalized_text), 0) THEN 'E02_COUNT' END, CASE WHEN normalized_text IS NOT NULL AND text_sha256 IS NOT NULL AND text_sha256 <> sha256(normalized_text) THEN 'E03_HASH' END], lambda c: c IS NOT NULL)) AS check_id FROM pages),
n AS (SELECT check_id, count(*) AS n FROM x GROUP BY 1), e AS (SELECT check_id, string_agg(k, ',' ORDER BY k) AS examples FROM (SELECT DISTINCT check_id, k FROM x QUALIFY dense_rank() OVER (PARTITION BY check_id ORDER BY k) <= 3) GROUP BY 1), a AS (SELECT unnest(['B02_GRAMMAR', 'B03_PARTS', 'D01_NULL', 'E01_STATUS', 'E02_COUNT', 'E03_HASH']) AS check_id)
SELECT check_id, coalesce(n, 0) AS n, coalesce(examples, '') AS examples FROM a LEFT JOIN n USING (check_id) LEFT JOIN e USING (check_id)""")
def validator_pages(t: Tables) -> DataFrame:
    """V-03, V-05, V-06, V-08: row conditions on pages, in one pass."""
    c = F.col
    return validation.conditions(
        t.pages,
        "page_id",
        {
            "B02_GRAMMAR": ~c("page_id").rlike(r"^[A-Z]+-SRC-[0-9]+:p[0-9]{7}$"),
            "B03_PARTS": ~c("page_id").startswith(F.concat("source_id", F.lit(":"))),
            "D01_NULL": c("primary_text_origin").isNull(),
            "E01_STATUS": c("page_status").isin("FAILED", "OCR_REQUIRED", "NOT_PROCESSED") & c("normalized_text").isNotNull(),
            "E02_COUNT": c("char_count") != F.coalesce(F.length("normalized_text"), F.lit(0)),
            "E03_HASH": c("text_sha256") != F.sha2("normalized_text", 256),
        },
    )


@query("""
WITH s AS (SELECT source_id, count(DISTINCT page_index) AS pages, min(page_index) AS lo, max(page_index) AS hi, count(DISTINCT page_index) FILTER (WHERE page_status IN ('FAILED', 'NOT_PROCESSED', 'OCR_REQUIRED')) AS failed, count(DISTINCT page_index) FILTER (WHERE page_status = 'NEEDS_REVIEW') AS review FROM pages GROUP BY 1)
SELECT s.source_id, pages, CASE WHEN x.lifecycle_status <> 'ACTIVE' THEN 'SKIPPED_BY_REGISTER' WHEN x.file_status <> 'PRESENT_VERIFIED' THEN 'FAILED' WHEN lo <> 1 OR hi <> pages THEN 'PARTIAL' WHEN failed > 0 THEN 'PARTIAL' WHEN review > 0 THEN 'NEEDS_REVIEW' ELSE 'COMPLETE' END AS status FROM s LEFT JOIN sources x ON x.source_id = s.source_id""")
def source_completeness(t: Tables) -> DataFrame:
    """V-07, PF-04, A-11: the roll-up of a source's pages, first rule that holds."""
    bad = F.col("page_status").isin("FAILED", "NOT_PROCESSED", "OCR_REQUIRED")
    s = t.pages.groupBy("source_id").agg(F.count_distinct("page_index").alias("pages"), F.min("page_index").alias("lo"), F.max("page_index").alias("hi"), F.count_distinct(F.when(bad, F.col("page_index"))).alias("failed"), F.count_distinct(F.when(F.col("page_status") == "NEEDS_REVIEW", F.col("page_index"))).alias("review"))
    j = s.join(t.sources.select("source_id", "lifecycle_status", "file_status"), "source_id", "left")
    status = F.when(F.col("lifecycle_status") != "ACTIVE", "SKIPPED_BY_REGISTER").when(F.col("file_status") != "PRESENT_VERIFIED", "FAILED").when((F.col("lo") != 1) | (F.col("hi") != F.col("pages")), "PARTIAL").when(F.col("failed") > 0, "PARTIAL").when(F.col("review") > 0, "NEEDS_REVIEW").otherwise("COMPLETE")
    return j.select("source_id", "pages", status.alias("status"))


@query("""
WITH h AS (SELECT sha256(concat_ws('|', 'p_brand=' || coalesce('''' || p_brand || '''', 'null'), 'p_partkey=' || coalesce('''' || p_partkey || '''', 'null'), 'p_size=' || coalesce('''' || p_size || '''', 'null'))) AS h FROM part)
SELECT count(*) AS n, """ + ", ".join(f"sum(('0x' || h[{1 + 8 * k}:{8 + 8 * k}])::BIGINT)::BIGINT AS lane{k}" for k in range(8)) + " FROM h")
def row_digest_lanes(t: Tables) -> DataFrame:
    """A-17: a table's digest in additive lanes."""
    return digests.lanes(t.part, ["p_brand", "p_partkey", "p_size"])


@query("""
SELECT source_id, 'BML-' || left(sha256(source_id || ':' || coalesce(format_detected, '')), 16) AS derived_id, lower(trim(site_scope_raw)) AS scope, row_number() OVER (PARTITION BY lower(trim(site_scope_raw)) ORDER BY source_id) AS n FROM sources""")
def derived_ids(t: Tables) -> DataFrame:
    """Identity rules of the data model: ids from hashes, normalised scopes."""
    scope = F.lower(F.trim("site_scope_raw"))
    mark = F.concat(F.lit("BML-"), F.left(F.sha2(F.concat("source_id", F.lit(":"), F.coalesce("format_detected", F.lit(""))), 256), F.lit(16)))
    return t.sources.select("source_id", mark.alias("derived_id"), scope.alias("scope"), F.row_number().over(Window.partitionBy(scope).orderBy("source_id")).cast("long").alias("n"))


@query("""
WITH c AS (SELECT * FROM table_cells QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY created_at DESC NULLS LAST) = 1), v AS (SELECT table_id, col_no, row_no, text FROM c WHERE regexp_full_match(text, '[0-9]+([.,][0-9]+)?')),
d AS (SELECT table_id, col_no, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '[.,]')) AS decimals FROM v GROUP BY ALL)
SELECT v.table_id, v.col_no::BIGINT AS col_no, v.row_no::BIGINT AS row_no FROM v JOIN d USING (table_id, col_no) WHERE n >= 3 AND decimals >= 2 AND decimals >= 0.7 * n AND NOT regexp_matches(text, '[.,]')""")
def decimal_suspects(t: Tables) -> DataFrame:
    """K-31: whole numbers in a column of decimals."""
    v = current(t.spark, t.sf_dir, "table_cells", ["table_id", "col_no", "row_no", "text"]).filter(F.col("text").rlike(r"^[0-9]+([.,][0-9]+)?$"))
    d = v.groupBy("table_id", "col_no").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").rlike("[.,]")).alias("decimals")).filter("n >= 3 and decimals >= 2 and decimals >= 0.7 * n")
    return v.join(d, ["table_id", "col_no"]).filter(~F.col("text").rlike("[.,]")).select("table_id", F.col("col_no").cast("long").alias("col_no"), F.col("row_no").cast("long").alias("row_no"))
