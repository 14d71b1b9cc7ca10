"""Problem 5: the best representative of each duplicate group.

Rows of a group are compared on three axes: the source's trust (with the
PRIMARY mark as a class above it), recency, and completeness.  For a single
field completeness is "has a value", so a field's candidates are the rows that
really have one.  The skyline of the candidates (those that no other row beats
or equals on every axis) is resolved by the lexicographic policy mark, trust,
recency, id; where a group's own first layer has no value, the skyline of the
field's candidates lies in a later layer and the value comes from there.

``layers`` tells the layer of each value's row: the skyline of the group's rows
is layer 1, that of the rest layer 2 and so on; a value of layer 3 filled what
two layers had left null.

Peeling the layers field by field is needed: filling strictly from the layers
of whole records can prefer a row of an early layer that the policy ranks
below one of a later layer.

A group may hold any share of all rows.  Before anything is gathered, rows are
reduced to the latest one per (group, field, mark, trust): no other row can be
undominated.  What is gathered per group is bounded by twice the number of
trust ranks, not by the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import current, load

# Marks and words that stand for a missing value.
STAND_INS = ["-", "—", "–", "−", "?", "...", "…", "n/a", "na", "n.a.", "none", "null", "nan", "н/д", "нет данных", "не указано", "нет", "без данных", "unknown", "not available", "not given", "no data", "k.a.", "keine angabe"]
#: Trust of a source without a rank, or not listed: after every rank.
UNKNOWN_TRUST = 2**31 - 1
YEARS = (1900, 2030)


def real_text(c: Column) -> Column:
    """The text, or null if it is blank or stands for a missing value."""
    bare = F.lower(F.regexp_replace(c.cast("string"), r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", ""))
    return F.when((bare != "") & ~bare.isin(STAND_INS), c.cast("string"))


def real_number(c: Column) -> Column:
    return F.when(c.isNotNull() & ~F.isnan(c.cast("double")), c.cast("string"))


def real_year(c: Column) -> Column:
    return F.when(c.between(*YEARS), c.cast("string"))


def candidates(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Latest valued row per (group_id, field_name, mark, trust), then least id.

    rows: group_id, record_id, mark (boolean), trust (int), recency (timestamp)
    and the fields, null where there is no value.
    """
    one = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields))).alias("f")
    long = rows.select("group_id", "record_id", "mark", "trust", "recency", one).select("*", "f.field_name", "f.value").drop("f").filter("value is not null")
    # Times as a number, null before all, so that one ordering serves max and ties.
    at = F.coalesce(F.unix_micros(F.col("recency").cast("timestamp")), F.lit(-(2**62)))
    long = long.withColumn("at", at)
    # The latest row and of these the one of the least id: one ordering, so one aggregation, reduced before its shuffle.
    row = F.min(F.struct((-F.col("at")).alias("age"), "record_id", "value")).alias("row")
    return long.groupBy("group_id", "field_name", "mark", "trust").agg(row).select("group_id", "field_name", "mark", "trust", (-F.col("row.age")).alias("at"), "row.record_id", "row.value")


def skyline_winners(cands: DataFrame) -> DataFrame:
    """group_id, field_name, record_id, value, mark, trust, at, undominated: the policy's choice from each field's skyline."""
    beats = lambda y, x: (y["mark"] >= x["mark"]) & (y["trust"] <= x["trust"]) & (y["at"] >= x["at"]) & ((y["mark"] > x["mark"]) | (y["trust"] < x["trust"]) | (y["at"] > x["at"]))
    rows = cands.groupBy("group_id", "field_name").agg(F.collect_list(F.struct((~F.col("mark")).alias("unmarked"), "trust", (-F.col("at")).alias("age"), "record_id", "value", "mark", "at")).alias("rows"))
    top = F.filter("rows", lambda x: ~F.exists("rows", lambda y: beats(y, x)))
    return rows.select("group_id", "field_name", top.alias("skyline")).select("group_id", "field_name", F.array_min("skyline").alias("best"), F.size("skyline").alias("undominated")).select("group_id", "field_name", "best.record_id", "best.value", "best.mark", "best.trust", "best.at", "undominated")


def survivors(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Per group and field the row that supplies the value.

    Groups with a null key are left out; a field without a value in its group
    gives no row; ties of mark, trust and time go to the smaller record_id.
    """
    return skyline_winners(candidates(rows.filter("group_id is not null"), fields))


def layers(rows: DataFrame, won: DataFrame) -> DataFrame:
    """``won`` with mark, trust, at of each value's row, plus its dominance layer among all rows of the group, from 1.

    Rows of one mark and trust form a class, which stands where its latest row
    does; a row's layer is one more than the deepest class that dominates it.
    A group has at most twice as many classes as there are trust ranks.
    """
    at = F.coalesce(F.unix_micros(F.col("recency").cast("timestamp")), F.lit(-(2**62)))
    classes = rows.filter("group_id is not null").groupBy("group_id", (~F.col("mark")).alias("unmarked"), "trust").agg(F.max(at).alias("at"))
    placed = "struct<unmarked:boolean,trust:int,at:bigint,layer:int>"

    def above(done: Column, x: Column) -> Column:
        over = F.filter(done, lambda y: (y["unmarked"] <= x["unmarked"]) & (y["trust"] <= x["trust"]) & (y["at"] >= x["at"]) & ((y["unmarked"] < x["unmarked"]) | (y["trust"] < x["trust"]) | (y["at"] > x["at"])))
        return F.coalesce(F.array_max(F.transform(over, lambda y: y["layer"])), F.lit(0))

    def place(done: Column, x: Column) -> Column:
        return F.concat(done, F.array(F.struct(x["unmarked"].alias("unmarked"), x["trust"].cast("int").alias("trust"), x["at"].alias("at"), (above(done, x) + 1).alias("layer")).cast(placed)))

    # In this order whatever dominates a class comes before it.
    ordered = F.array_sort(F.collect_list(F.struct("unmarked", "trust", (-F.col("at")).alias("age"), "at")))
    peeled = classes.groupBy("group_id").agg(F.aggregate(ordered, F.array().cast(f"array<{placed}>"), place).alias("classes"))
    row = F.struct((~F.col("mark")).alias("unmarked"), "trust", "at")
    return won.join(peeled, "group_id").withColumn("layer", above(F.col("classes"), row) + 1).drop("classes")


EVIDENCE_FIELDS = ["value_as_printed", "unit_as_printed", "material_as_printed", "conditions", "method_used", "n_samples", "cited_ref"]
UNIT_FIELDS = ["work_id", "pub_year", "cosine"]


def _trusted(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds the source's trust; a source listed twice counts by its best rank."""
    ranks = sources.filter("trust_rank is not null").groupBy("source_id").agg(F.min("trust_rank").alias("trust"))
    return rows.join(ranks, "source_id", "left").withColumn("trust", F.coalesce("trust", F.lit(UNKNOWN_TRUST)))


def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = current(spark, sf_dir, "passport_evidence", ["copy_cluster", "copy_role", "source_id", *EVIDENCE_FIELDS])
    key = F.upper(F.trim("copy_cluster"))
    rows = rows.select(F.when(key != "", key).alias("group_id"), F.col("ev_id").alias("record_id"), F.coalesce(F.upper(F.trim("copy_role")) == "PRIMARY", F.lit(False)).alias("mark"), "source_id", F.col("recorded_at").alias("recency"), *(real_text(F.col(f)).alias(f) for f in EVIDENCE_FIELDS))
    return _trusted(rows, load(spark, sf_dir, "sources"))


def unit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = current(spark, sf_dir, "nav_dup_members", ["is_primary", "source_id", *UNIT_FIELDS])
    rows = rows.select(F.col("cluster_id").alias("group_id"), F.col("unit_id").alias("record_id"), F.coalesce("is_primary", F.lit(False)).alias("mark"), "source_id", F.col("recorded_at").alias("recency"), real_text(F.col("work_id")).alias("work_id"), real_year(F.col("pub_year")).alias("pub_year"), real_number(F.col("cosine")).alias("cosine"))
    return _trusted(rows, load(spark, sf_dir, "sources"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = survivors(evidence_rows(spark, sf_dir), EVIDENCE_FIELDS)
    two = survivors(unit_rows(spark, sf_dir), UNIT_FIELDS)
    return one.unionByName(two).select("group_id", "field_name", "record_id")


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving evidence records themselves: a column per field, and beside it the dominance layer its value came from."""
    rows = evidence_rows(spark, sf_dir)
    won = layers(rows, survivors(rows, EVIDENCE_FIELDS))
    of = lambda f, c: F.max(F.when(F.col("field_name") == f, F.col(c)))
    return won.groupBy("group_id").agg(*(x for f in EVIDENCE_FIELDS for x in (of(f, "value").alias(f), of(f, "layer").alias(f"{f}_layer"))))


_ORACLE_RANKS = "SELECT source_id, min(trust_rank) AS trust FROM sources WHERE trust_rank IS NOT NULL GROUP BY source_id"
# Fixed values, stated again for the SQL: what stands for a missing value.
_NO_VALUE = """'-', '—', '–', '−', '?', '...', '…', 'n/a', 'na', 'n.a.', 'none', 'null', 'nan', 'н/д', 'нет данных', 'не указано', 'нет', 'без данных', 'unknown', 'not available', 'not given', 'no data', 'k.a.', 'keine angabe'"""


def _oracle_branch(rows: str, fields: list[tuple[str, str]], record: str, time: str) -> str:
    values = " UNION ALL ".join(f"SELECT *, '{f}' AS field_name FROM r WHERE {has}" for f, has in fields)
    return f"""SELECT group_id, field_name, {record} AS record_id FROM (
      WITH r AS (SELECT q.*, coalesce(s.trust, {UNKNOWN_TRUST}) AS trust FROM ({rows}) q LEFT JOIN ({_ORACLE_RANKS}) s USING (source_id))
      SELECT * FROM ({values}) v WHERE group_id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY group_id, field_name ORDER BY mark DESC, trust, {time} DESC NULLS LAST, {record}) = 1)"""


def _text_has(f: str) -> str:
    return f"trim({f}, chr(32) || chr(9) || chr(10) || chr(13) || chr(160) || chr(8239)) <> '' AND lower(trim({f}, chr(32) || chr(9) || chr(10) || chr(13) || chr(160) || chr(8239))) NOT IN ({_NO_VALUE})"


P5_ORACLE = (
    _oracle_branch(
        "SELECT *, nullif(upper(trim(copy_cluster)), '') AS group_id, coalesce(upper(trim(copy_role)) = 'PRIMARY', false) AS mark FROM passport_evidence QUALIFY row_number() OVER (PARTITION BY ev_id ORDER BY recorded_at DESC NULLS LAST) = 1",
        [(f, _text_has(f)) for f in EVIDENCE_FIELDS],
        "ev_id",
        "recorded_at",
    )
    + " UNION ALL "
    + _oracle_branch(
        "SELECT *, cluster_id AS group_id, coalesce(is_primary, false) AS mark FROM nav_dup_members QUALIFY row_number() OVER (PARTITION BY cluster_id, unit_id ORDER BY recorded_at DESC NULLS LAST) = 1",
        [("work_id", _text_has("work_id")), ("pub_year", f"pub_year BETWEEN {YEARS[0]} AND {YEARS[1]}"), ("cosine", "cosine IS NOT NULL AND NOT isnan(cosine)")],
        "unit_id",
        "recorded_at",
    )
)
