import pytest
from pyspark.sql import functions as F

from brinework.llm import mixing as M


def documents(spark, sizes):
    rows = [(f"{s}{i}", s, "word" + " word" * (n - 1)) for s, (count, n) in sizes.items() for i in range(count)]
    return spark.createDataFrame(rows, "doc_id string, source string, text string").selectExpr("*", "'clash' AS share", "1 AS budget", "2 AS tokens")


def test_exact_shares(spark):
    docs = documents(spark, {"a": (300, 10), "b": (400, 12), "c": (50, 8)})
    docs = docs.unionByName(spark.createDataFrame([("n", None, "x"), ("e", "a", ""), ("z", "a", None), ("o", "other", "y y")], "doc_id string, source string, text string").selectExpr("*", "'clash' AS share", "1 AS budget", "2 AS tokens"))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.25, 1), ("c", 0.2, 3), ("gone", 0.1, 2), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    uses, report = M.mix(spark, docs, targets)
    rows = {r["source"]: r for r in report.collect()}
    assert rows["gone"]["used"] == 0 and rows["gone"]["actual_share"] == 0
    for s, share in (("a", 0.5), ("b", 0.25), ("c", 0.2)):
        assert rows[s]["actual_share"] == pytest.approx(share / 0.95, abs=0.01)
        assert rows[s]["most_copies"] <= rows[s]["repeats"]
    u = {r["source"]: r["t"] for r in uses.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t")).collect()}
    assert u == {s: rows[s]["used"] for s in "abc"}
    assert uses.filter("doc_id in ('n', 'e', 'z', 'o')").count() == 0 and uses.groupBy("doc_id").count().filter("count > 1").count() == 0


def test_total_with_caps(spark):
    docs = documents(spark, {"a": (400, 10), "b": (10, 10)})
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    _, report = M.mix(spark, docs, targets, 2000)
    rows = {r["source"]: r for r in report.collect()}
    assert rows["b"]["used"] == 300 and rows["b"]["most_copies"] == 3
    assert rows["a"]["used"] == pytest.approx(1700, abs=10)
    _, report = M.mix(spark, docs, targets, 10**9)
    assert {r["source"]: r["used"] for r in report.collect()} == {"a": 8000, "b": 300}


def test_nested(spark):
    docs = documents(spark, {"a": (300, 10), "b": (300, 10)})
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    small, large = ({r["doc_id"] for r in M.mix(spark, docs, targets, n)[0].collect()} for n in (1000, 3000))
    assert small < large


def test_nulls_and_repeats_in_targets(spark):
    docs = documents(spark, {"a": (20, 10)})
    targets = spark.createDataFrame([("a", 0.1, None), ("a", 0.5, 2), ("x", None, None), ("y", -1.0, 0)], "source string, target_share double, max_repeats int")
    uses, report = M.mix(spark, docs, targets)
    assert report.count() == 3 and uses.agg(F.sum(F.col("copies"))).first()[0] == 40
    assert M.mix(spark, docs.limit(0), targets)[0].count() == 0 and M.mix(spark, docs, targets.limit(0))[0].count() == 0


def test_invariants(spark, sf_dir):
    rows = M.p7_invariants(spark, sf_dir).collect()
    assert rows and all(r["within_cap"] and r["within_one_text"] for r in rows)
