import random

from pyspark.sql import functions as F

from brinework.llm import components as C


def groups_of(edges):
    """Record to least record, by merging whole sets."""
    group = {}
    for a, b in edges:
        merged = group.get(a, {a}) | group.get(b, {b})
        group.update(dict.fromkeys(merged, merged))
    return {x: min(members) for x, members in group.items()}


def test_against_union_find(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(150):03}", f"n{rng.randrange(150):03}") for _ in range(110)]
    edges += [(f"z{i:03}", f"z{i + 1:03}") for i in range(60)]  # a long chain
    want = {(x, g) for x, g in groups_of((a, b) for a, b in edges if a != b).items()}
    df = spark.createDataFrame(edges, "a string, b string")
    assert {tuple(r) for r in C.consolidate(spark, [C.links_of_pairs(df, "a", "b")]).collect()} == want


def test_hot_cluster(spark):
    """A cluster of a third of all rows stays as many edges as members."""
    members = spark.range(6000).selectExpr("if(id < 2000, 'hot', concat('c', id)) AS c", "concat('u', lpad(id, 5, '0')) AS u", "'clash' AS hi", "id AS lo")
    edges = C.links_of_clusters(members, "c", "u")
    assert edges.count() == 6000
    found = C.consolidate(spark, [edges])
    assert found.count() == 2000 and found.select("group_id").distinct().collect()[0][0] == "u00000"


def test_dirt(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", None), (None, None), ("b", "c"), ("c", "b"), ("b", "c"), ("", "x"), ("é" * 3000, "x")], "a string, b string")
    found = {tuple(r) for r in C.consolidate(spark, [C.links_of_pairs(pairs, "a", "b")]).collect()}
    assert found == {("b", "b"), ("c", "b"), ("", ""), ("x", ""), ("é" * 3000, "")}


def test_single_members(spark):
    members = spark.createDataFrame([("c", "u"), ("c", "u"), ("d", None), (None, "v")], "c string, u string")
    assert C.consolidate(spark, [C.links_of_clusters(members, "c", "u")]).count() == 0


def test_equal_hashes(spark, monkeypatch):
    """Identifiers whose hashes are equal stay apart."""
    monkeypatch.setattr(C, "_hash", lambda name: F.pmod(F.xxhash64(name), F.lit(6)).bitwiseOR(F.lit(1)))
    rng = random.Random(8)
    edges = [(f"n{rng.randrange(40):02}", f"n{rng.randrange(40):02}") for _ in range(25)]
    want = {(x, g) for x, g in groups_of((a, b) for a, b in edges if a != b).items()}
    df = spark.createDataFrame(edges, "a string, b string")
    members = spark.createDataFrame([("c", "m1"), ("c", "m2"), ("d", "m3")], "c string, u string")
    found = {tuple(r) for r in C.consolidate(spark, [C.links_of_pairs(df, "a", "b"), C.links_of_clusters(members, "c", "u")]).collect()}
    assert found == want | {("m1", "m1"), ("m2", "m1")}
