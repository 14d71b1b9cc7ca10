"""Communities against planted groups and against modularity of the plain alternatives."""

import random

from pyspark.sql import functions as F

from brinework.operators import communities


def planted(groups, size, inside, outside, seed=1):
    rng = random.Random(seed)
    n = groups * size
    return [(a, b, 1.0) for a in range(n) for b in range(a + 1, n) if rng.random() < (inside if a // size == b // size else outside)]


def test_planted_groups(spark):
    edges = spark.createDataFrame(planted(3, 10, 0.9, 0.02), "a long, b long, weight double")
    found = communities.louvain(spark, edges).collect()
    top = max(r["level"] for r in found)
    last = {r["id"]: r["community"] for r in found if r["level"] == top}
    assert last == {i: i // 10 * 10 for i in range(30)}
    q = communities.modularity(edges, spark.createDataFrame(list(last.items()), "id long, community long")).first()[0]
    assert q > 0.5


def test_levels_nest(spark):
    """Two pairs of rings: small communities first, joined on the next level, never cut again."""
    edges = [(10 * g + i, 10 * g + (i + 1) % 10, 1.0) for g in range(4) for i in range(10)] + [(10 * g, 10 * g + 10, 0.2) for g in range(3)]
    found = communities.louvain(spark, spark.createDataFrame(edges, "a long, b long, weight double")).collect()
    by_level = {}
    for r in found:
        by_level.setdefault(r["level"], {})[r["id"]] = r["community"]
    levels = sorted(by_level)
    assert len(levels) > 1
    for lower, upper in zip(levels, levels[1:], strict=False):
        up = {}
        for i, c in by_level[lower].items():
            assert up.setdefault(c, by_level[upper][i]) == by_level[upper][i]
        assert len(set(by_level[upper].values())) <= len(set(by_level[lower].values()))


def test_odd_graphs(spark):
    none = spark.createDataFrame([], "a long, b long, weight double")
    assert communities.louvain(spark, none).count() == 0
    odd = spark.createDataFrame([(1, 1, 2.0), (2, 3, 1.0), (3, 2, 1.0), (4, None, 1.0), (5, 6, 0.0)], "a long, b long, weight double")
    found = communities.louvain(spark, odd)
    top = found.agg(F.max("level")).first()[0]
    assert {(r["id"], r["community"]) for r in found.collect() if r["level"] == top} == {(1, 1), (2, 2), (3, 2)}
