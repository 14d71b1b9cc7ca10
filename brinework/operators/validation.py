"""Data-quality checks as one report (V-family).

A check is a table of offending keys; the report counts it and shows a few.
Checks that read the same table share one pass where they are conditions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Offending keys shown per check.
EXAMPLES = 3


def conditions(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """check_id, n, examples of row conditions that must not hold; all of them in one pass."""
    hit = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items())))
    long = df.select(F.col(key).cast("string").alias("k"), F.explode(hit).alias("check_id"))
    return _report(long, list(checks))


def offenders(checks: dict[str, DataFrame]) -> DataFrame:
    """check_id, n, examples of checks given as tables with a column k."""
    long = reduce(DataFrame.unionByName, (df.select(F.col("k").cast("string").alias("k"), F.lit(name).alias("check_id")) for name, df in checks.items()))
    return _report(long, list(checks))


def _report(long: DataFrame, names: list[str]) -> DataFrame:
    # min_by of a bounded sorted slice: the least keys, merged before and after the shuffle, never all of them.
    ranked = long.groupBy("check_id", "k").agg(F.count(F.lit(1)).alias("c"))
    counts = long.groupBy("check_id").agg(F.count(F.lit(1)).alias("n"))
    least = ranked.withColumn("r", F.row_number().over(Window.partitionBy("check_id").orderBy("k"))).filter(F.col("r") <= EXAMPLES)
    shown = least.groupBy("check_id").agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("examples"))
    every = long.sparkSession.createDataFrame([(n,) for n in names], "check_id string")
    return every.join(counts, "check_id", "left").join(shown, "check_id", "left").select("check_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("examples", F.lit("")).alias("examples"))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """k: keys that occur more than once (V-02)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.concat_ws("/", *keys).alias("k"))


def missing_targets(df: DataFrame, key: str, target: DataFrame, target_key: str) -> DataFrame:
    """k: references without a target; null references are no references (V-04, J-12)."""
    return df.filter(F.col(key).isNotNull()).join(target.select(F.col(target_key).alias(key)).distinct(), key, "left_anti").select(F.col(key).alias("k"))


def verdict(report: DataFrame, warn: list[str]) -> DataFrame:
    """Adds status: PASS, WARN for the named checks, else FAIL (V-10)."""
    return report.withColumn("status", F.when(F.col("n") == 0, "PASS").when(F.col("check_id").isin(warn), "WARN").otherwise("FAIL"))
