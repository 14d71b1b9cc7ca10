"""Term statistics: tf-idf, class-based tf-idf, co-occurrence and nested candidates (K-family)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import round6


def tf_idf(terms: DataFrame, unit: str, total: int | None = None) -> DataFrame:
    """unit, term, tf, df, score = tf * ln(N / df) (A-19, K-04). terms: unit, term."""
    tf = terms.groupBy(unit, "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = tf.agg(F.count_distinct(unit).alias("n")) if total is None else None
    joined = tf.join(df, "term")
    joined = joined.crossJoin(F.broadcast(n)) if n is not None else joined.withColumn("n", F.lit(total))
    return joined.withColumn("score", round6(F.col("tf") * F.log(F.col("n") / F.col("df")))).drop("n")


def c_tf_idf(terms: DataFrame, group: str, unit: str) -> DataFrame:
    """group, term, score = tf/total * ln(1 + avg/f) * (0.5 + 0.5 * share of units) (K-14). terms: group, unit, term."""
    by = terms.groupBy(group, "term").agg(F.count(F.lit(1)).alias("tf"), F.count_distinct(unit).alias("n_sec"))
    totals = by.groupBy(group).agg(F.sum("tf").alias("total"))
    sizes = terms.groupBy(group).agg(F.count_distinct(unit).alias("size"))
    overall = by.groupBy("term").agg(F.sum("tf").alias("f"))
    avg = totals.agg(F.avg("total").alias("avg_total"))
    j = by.join(overall, "term").join(totals, group).join(sizes, group).crossJoin(F.broadcast(avg))
    score = F.col("tf") / F.col("total") * F.log(1 + F.col("avg_total") / F.col("f")) * (0.5 + 0.5 * F.col("n_sec") / F.col("size"))
    return j.filter(F.col("n_sec") >= F.least(F.lit(2), F.col("size"))).select(group, "term", round6(score).alias("score"))


def npmi(units: DataFrame, unit: str, term: str, least_shared: int, least: float) -> DataFrame:
    """a < b, shared, npmi, score of terms that share units (K-05, J-09, A-22). Units must be small by nature."""
    one = units.select(F.col(unit).alias("u"), F.col(term).alias("t")).distinct()
    n = one.agg(F.count_distinct("u").alias("n"))
    df = one.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    pairs = one.alias("x").join(one.alias("y"), "u").filter("x.t < y.t").groupBy(F.col("x.t").alias("a"), F.col("y.t").alias("b")).agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least_shared)
    j = pairs.join(df.select(F.col("t").alias("a"), F.col("df").alias("da")), "a").join(df.select(F.col("t").alias("b"), F.col("df").alias("db")), "b").crossJoin(F.broadcast(n))
    value = F.when(F.col("shared") >= F.col("n"), 1.0).otherwise(F.log(F.col("shared") * F.col("n") / (F.col("da") * F.col("db"))) / -F.log(F.col("shared") / F.col("n")))
    j = j.withColumn("npmi", round6(value)).filter(F.col("npmi") >= least)
    return j.select("a", "b", "shared", "npmi", round6(F.col("npmi") * F.col("shared") / (F.col("shared") + 2)).alias("score"))


def c_value(candidates: DataFrame) -> DataFrame:
    """term, tf, cvalue = log2(words + 1) * (tf - mean tf of the longer candidates around it) (K-03, X-11). candidates: term, tf.

    A longer candidate is split into the runs of words inside it; the join on
    those runs replaces a search of every term in every other.
    """
    words = F.split("term", " ")
    n = F.size("w")
    runs = candidates.select("term", "tf", words.alias("w")).filter(F.size("w") > 1)
    inner = runs.select(F.col("tf").alias("outer_tf"), F.col("term").alias("outer_term"), F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice("w", i, k), " ")))))).alias("term"))
    around = inner.join(candidates.select("term"), "term", "left_semi").groupBy("term").agg(F.avg("outer_tf").alias("mean"), F.max("outer_tf").alias("most"))
    j = candidates.join(around, "term", "left")
    value = F.log2(F.size(words) + 1) * (F.col("tf") - F.coalesce("mean", F.lit(0.0)))
    return j.withColumn("cvalue", round6(value)).filter((F.col("cvalue") > 0) & (F.coalesce("most", F.lit(0)) < 0.9 * F.col("tf"))).select("term", "tf", "cvalue")


def top_per(rows: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie)).cast("long")).filter(F.col("r") <= k)
