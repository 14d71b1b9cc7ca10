"""Typed filters, cursors, bound SELECTs, row numbers and reference matching on small cases."""

import pytest
from pyspark.sql import functions as F

from brinework.operators import bibliography, filters, order
from brinework.plans import access


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", 1.0, True, ["x"]), (2, None, None, False, None), (3, "b", 5.0, True, ["y", "x"])], "id int, c string, v double, b boolean, l array<string>")
    kinds = {"c": "terms", "v": "range", "b": "bool", "l": "overlaps"}
    assert ids(df.filter(filters.compiled(kinds, {"c": ["a", "b"], "v": (None, 4), "b": True}))) == [1]
    assert ids(df.filter(filters.compiled(kinds, {"l": ["y"]}))) == [3] and ids(df.filter(filters.compiled(kinds, {}))) == [1, 2, 3]
    assert ids(df.filter(filters.compiled({"c": "not_terms"}, {"c": ["a"]}))) == [2, 3]
    assert ids(df.filter(filters.compiled({"v": "available"}, {"v": {"at": 2, "unknown": "INCLUDE"}}))) == [1, 2]
    for wrong in ({"d": ["a"]}, {"c": "a"}, {"b": "yes"}):
        with pytest.raises(ValueError):
            filters.compiled(kinds, wrong)


def test_pages(spark):
    df = spark.range(25)
    seen, cursor = [], None
    while True:
        found, cursor = filters.page(df, "id", 10, {"q": 1}, cursor)
        seen.append(ids(found))
        if cursor is None:
            break
    assert [len(x) for x in seen] == [10, 10, 5] and sum(seen, []) == list(range(25))
    _, cursor = filters.page(df, "id", 10, {"q": 1})
    with pytest.raises(ValueError, match="another"):
        filters.page(df, "id", 10, {"q": 2}, cursor)
    assert filters.page(df.limit(0), "id", 10, {})[1] is None


def test_bound_selects(spark):
    views = {"v": spark.range(5)}
    assert filters.named_select(spark, views, "SELECT id FROM v WHERE id > 1", 2).count() == 3
    assert filters.named_select(spark, views, "WITH w AS (SELECT id FROM v) SELECT * FROM w", 10).count() == 5
    for wrong in ("SELECT * FROM other", "DROP TABLE v", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/etc`", "SELECT * FROM v WHERE id IN (SELECT id FROM secret)"):
        with pytest.raises(Exception):
            filters.named_select(spark, views, wrong, 2).count()


def test_row_numbers(spark):
    df = spark.range(1000).select((F.col("id") * F.col("id") % 7919).alias("k"), F.when(F.col("id") % 3 > 0, "hot").alias("g"))
    df = df.dropDuplicates(["k"])
    got = sorted((r["g"] or "", r["k"], r["n"]) for r in order.row_numbers(df, "k", "n", "g", 16).collect())
    want, count = [], {}
    for g, k in sorted((r["g"] or "", r["k"]) for r in df.collect()):
        count[g] = count.get(g, 0) + 1
        want.append((g, k, count[g]))
    assert got == want
    assert order.row_numbers(df.limit(0), "k", "n").count() == 0 and order.row_numbers(df.limit(1), "k", "n").first()["n"] == 1


def test_totals_over_classes_are_refused(spark):
    with pytest.raises(ValueError):
        access.class_totals(spark.range(2), None, "id")


def test_references(spark):
    schema = "{} long, title string, year int, doi string, isbn array<string>, surnames array<string>"
    long = "Creep of carnallite under cyclic load"
    works = spark.createDataFrame([(1, long, 1990, "d1", ["i1"], ["ivanov"]), (2, long, 1990, None, ["i1", "i2"], ["petrov"]), (3, "Short", 2000, None, None, None), (4, None, None, None, None, None)], schema.format("work_id"))
    entries = spark.createDataFrame(
        [
            (10, None, None, "d1", None, None),
            (11, None, None, None, ["i1"], None),
            (12, "CREEP of carnallite, under cyclic load.", 1990, None, [], None),
            (13, "short", 2000, None, None, None),
            (14, "Creep of carnalite under cyclic load", 1991, None, None, ["ivanov", "x"]),
            (15, "", 1990, None, None, ["ivanov"]),
            (16, None, None, None, None, None),
        ],
        schema.format("entry_id"),
    )
    found = {(r["entry_id"], r["work_id"], r["method"], r["level"]) for r in bibliography.matches(entries, works).collect()}
    assert found == {(10, 1, "DOI", 3), (11, 1, "ISBN", 3), (11, 2, "ISBN", 3), (12, 1, "TITLE_YEAR", 2), (12, 2, "TITLE_YEAR", 2), (13, 3, "TITLE_YEAR", 1), (14, 1, "FUZZY", 1)}
    settled = {(r["entry_id"], r["work_id"]): r["level"] for r in bibliography.settled(bibliography.matches(entries, works)).collect()}
    assert settled == {(10, 1): 3, (11, 1): 1, (11, 2): 1, (12, 1): 1, (12, 2): 1, (13, 3): 1, (14, 1): 1}
