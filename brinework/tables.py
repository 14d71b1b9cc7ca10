"""Reading the corpus tables and taking their current rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Key and time columns of the tables that keep older states of a row.
CURRENT_KEYS = {
    "pages": (["page_id"], "created_at"),
    "table_cells": (["cell_id"], "created_at"),
    "passport_evidence": (["ev_id"], "recorded_at"),
    "nav_dup_members": (["cluster_id", "unit_id"], "recorded_at"),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest_per_key(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """One row per key: that of the latest time.

    Null times are older than any other; rows of one key and time are told
    apart by a hash of all columns, so the choice doesn't depend on the
    partitioning.  ``row_number() = 1`` lets Spark drop losers before the
    shuffle (WindowGroupLimit), so a key of very many rows stays harmless.
    """
    order = Window.partitionBy(*keys).orderBy(F.col(time).desc_nulls_last(), F.xxhash64(*df.columns))
    return df.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn")


def current(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """The table's current rows, reading only the columns asked for."""
    df = load(spark, sf_dir, name)
    if name not in CURRENT_KEYS:
        return df.select(*columns).distinct() if columns else df.distinct()
    keys, time = CURRENT_KEYS[name]
    if columns:
        df = df.select(*dict.fromkeys([*keys, time, *columns]))
    return latest_per_key(df, keys, time)


def hash_sample(df: DataFrame, columns: list[str], most: int, seed: str = "sample") -> DataFrame:
    """About ``most`` rows (all, if there are fewer), chosen by a hash of ``columns``.

    A threshold on the hash needs no sort, and no task hands over more than
    its share; the choice doesn't depend on the partitioning.
    """
    n = df.count()
    if n <= most:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 31)) < int(most / n * (1 << 31)))
