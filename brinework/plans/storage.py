"""The store, its formats and the streaming forms, run over whole tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..checkpoint import Workspace
from ..sources import store
from ..streaming import windows
from .catalog import Catalog, Tables

catalog = Catalog()
query = catalog.query
QUERIES, ORACLES = catalog.queries, catalog.oracles


def _store(t: Tables) -> store.Store:
    return store.Store(t.spark, Workspace(t.spark, "store").root)


@query("SELECT s_suppkey, s_name, s_acctbal, NULL::VARCHAR AS note FROM supplier")
def store_read_back(t: Tables) -> DataFrame:
    """SC-01, SC-02, SC-04, SC-05, SC-07: a table committed and read back through its manifest under a wider schema."""
    s = _store(t)
    s.snapshot([s.commit("supplier", t.supplier.select("s_suppkey", "s_name", "s_acctbal"), ["s_suppkey"])])
    return s.read("supplier", StructType([StructField("s_suppkey", LongType()), StructField("s_name", StringType()), StructField("s_acctbal", DoubleType()), StructField("note", StringType())]))


@query("""
SELECT * FROM (SELECT 1::BIGINT AS version, count(*) AS n, false AS again FROM supplier UNION ALL SELECT 2, count(*), false FROM supplier WHERE s_suppkey > 1 UNION ALL SELECT 3, count(*), true FROM supplier)""")
def store_revisions(t: Tables) -> DataFrame:
    """SC-06, U-07: a table, a part of it, the whole table again: three commits, the last with the first one's content; repeating one is no change."""
    s, whole = _store(t), t.supplier
    some = whole.filter("s_suppkey > 1")
    one = s.commit("supplier", whole, ["s_suppkey"])
    two = s.commit("supplier", some, ["s_suppkey"], s.commit("supplier", whole, ["s_suppkey"], one))
    s.commit("supplier", whole, ["s_suppkey"], two)
    kept = s.history("supplier")[::-1]
    rows = [t.spark.read.parquet(*(f"{s.root}/{p}" for p in c["parts"])).agg(F.lit(k).cast("long").alias("version"), F.count(F.lit(1)).alias("n"), F.lit(c["fingerprint"] in [x["fingerprint"] for x in kept[: k - 1]]).alias("again")) for k, c in enumerate(kept, 1)]
    return reduce(DataFrame.unionByName, rows)


@query("SELECT 'supplier' AS dataset, 1::BIGINT AS parts, count(*) AS n FROM supplier UNION ALL SELECT 'nation', 1, count(*) FROM nation UNION ALL SELECT 'orphans', 1, 0")
def store_census(t: Tables) -> DataFrame:
    """SC-03, SC-08, SC-14: views over a snapshot of two datasets, its parts, and a part that no commit names."""
    s = _store(t)
    s.snapshot([s.commit("supplier", t.supplier, ["s_suppkey"]), s.commit("nation", t.nation, ["n_nationkey"])])
    t.region.write.parquet(f"{s.root}/parts/region/stray")
    store.attach(t.spark, s, ["supplier", "nation"], "census_")
    counted = t.spark.sql("SELECT 'supplier' AS dataset, count(*) AS n FROM census_supplier UNION ALL SELECT 'nation', count(*) FROM census_nation")
    parts = t.spark.table("census_snapshot_parts").groupBy("dataset").agg(F.count(F.lit(1)).alias("parts"))
    lost = t.spark.range(1).select(F.lit("orphans").alias("dataset"), F.lit(len(s.orphans())).cast("long").alias("parts"), F.lit(0).cast("long").alias("n"))
    return parts.join(counted, "dataset").select("dataset", "parts", "n").unionByName(lost)


@query("SELECT c_custkey::VARCHAR AS Id, c_name AS name, nullif(c_mktsegment, 'BUILDING') AS NAME_2 FROM customer")
def catalogue_read_back(t: Tables) -> DataFrame:
    """SC-09, SC-10: a table written as CSV under names that differ by case only, and typed again."""
    path = Workspace(t.spark, "catalogue").root
    cut = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    lines = t.customer.select(F.col("c_custkey").cast("string").alias("a"), F.col("c_name").alias("b"), cut.alias("c")).select(F.concat_ws(",", F.col("a"), F.concat(F.lit('"'), F.replace("b", F.lit('"'), F.lit('""')), F.lit('"')), F.coalesce("c", F.lit(""))).alias("value"))

    def headed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Every file of a folder has its own header.
        yield pd.DataFrame({"value": ["Id,name,NAME"]})
        yield from batches

    lines.mapInPandas(headed, "value string").write.text(path + "/csv")
    return store.read_catalogue(t.spark, path + "/csv")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_read_back(t: Tables) -> DataFrame:
    """SC-11, SC-13: JSON lines in ranges of the key, read back."""
    path = Workspace(t.spark, "lines").root + "/nation"
    store.write_json_lines(t.nation, path, ["n_nationkey"])
    return t.spark.read.schema(t.nation.schema).json(path).select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_latest_state(t: Tables) -> DataFrame:
    """ST-01, ST-03, ST-05: events as immutable parts, read as a stream, the latest state of each user upserted."""
    root = Workspace(t.spark, "stream").root
    rows = t.events.select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("at"))
    rows.repartition(6, "event_id").write.parquet(root + "/parts")
    windows.upsert_latest(t.spark, windows.parts_stream(t.spark, root + "/parts", rows.schema, 2), root + "/state", root + "/offsets", ["user_id"], "at")
    return t.spark.read.parquet(root + "/state/v2").select("user_id", "event_id", "event_type")
