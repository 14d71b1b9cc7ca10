"""Joins, skew, closure and the store on small cases."""

import pytest
from pyspark.sql import functions as F

from brinework.operators import duplicates, joins, skew, validation
from brinework.sources import digests, store
from brinework.streaming import windows


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_hot_split_join(spark):
    big = spark.range(5000).select(F.when(F.col("id") < 3000, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"), "id")
    lookup = big.groupBy("k").agg(F.min("id").alias("v"), F.count(F.lit(1)).alias("n")).filter("k <> 'k7'")
    found = skew.hot_split_join(big, lookup, "k", "v", "n", 5000)
    assert found.count() == 5000
    assert found.filter("v is null").count() == big.filter("k = 'k7'").count()
    assert found.filter("k = 'hot'").select("v").distinct().collect()[0][0] == 0


def test_interval_join(spark):
    p = spark.createDataFrame([("a", 5), ("a", 15), ("a", -3), ("b", 7), (None, 1)], "k string, at long")
    i = spark.createDataFrame([("a", 0, 10, 1), ("a", None, 6, 2), ("b", 8, None, 3), ("a", 20, 10, 4)], "k string, s long, e long, n int")
    assert sorted((r["k"], r["at"], r["n"]) for r in joins.interval_join(p, i, "k", "at", "s", "e", 4).collect()) == [("a", -3, 2), ("a", 5, 1), ("a", 5, 2)]


def test_latest_before(spark):
    left = spark.createDataFrame([("a", 1, 10), ("a", 2, 5), ("b", 3, 9)], "k string, l int, at int")
    right = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("a", 11, 3)], "k string, ts int, r int")
    assert sorted((r["l"], r["r"]) for r in joins.latest_before(left, right, "k", "at", "ts", "r").collect()) == [(1, 2), (2, 2)]


def test_closure_with_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 3), (4, 1)], "a int, b int")
    found = rows(joins.closure(spark, e, "a", "b"))
    assert (4, 3, 3) in found and (1, 3, 2) in found and all(a != b for a, b, _ in found)


def test_hamming(spark):
    codes = spark.createDataFrame([(1, 0), (2, 1), (3, 7), (4, -1)], "id int, code long")
    assert rows(joins.hamming_pairs(codes, "id", "code", 2)) == [(1, 2, 1), (2, 3, 2)]


def test_labels(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "a int, b int")
    found = dict(rows(duplicates.label_propagation(spark, pairs)))
    assert set(found.values()) == {0, 50} and found[20] == 0


def test_star_candidates_dont_multiply(spark):
    bands = spark.range(1000).select("id", F.lit(0).alias("band"), F.lit(1).alias("key"))
    assert duplicates.star_candidates(bands, "id").count() == 999


def test_report(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (2, "y"), (3, None)], "k int, v string")
    report = validation.offenders({"DUP": validation.duplicate_keys(df, "k"), "REF": validation.missing_targets(df, "v", df.filter("v = 'x'"), "v"), "OK": df.limit(0).select("k")})
    assert rows(validation.verdict(report, ["REF"]).select("check_id", "n", "examples", "status")) == [("DUP", 1, "2", "FAIL"), ("OK", 0, "", "PASS"), ("REF", 1, "y", "WARN")]


def test_digest_is_order_free(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s"))
    mark = digests.fingerprint(df)
    assert digests.fingerprint(df.orderBy(F.desc("id")).repartition(7)) == mark
    assert digests.fingerprint(df.filter("id <> 3")) != mark
    assert digests.fingerprint(df.fillna("")) != mark


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    one = s.commit("things", df, ["id"])
    assert s.commit("things", df.orderBy(F.desc("id")), ["id"], one) == one
    with pytest.raises(ValueError, match="head"):
        s.commit("things", df, ["id"], None)
    with pytest.raises(ValueError, match="repeated"):
        s.commit("things", df.union(df), ["id"], one)
    s.snapshot([one])
    two = s.commit("things", df.filter("id = 1"), ["id"], one)
    with pytest.raises(ValueError, match="check"):
        s.snapshot([two], [df])
    assert rows(s.read("things")) == [(1, "a"), (2, "b")]
    s.snapshot([two])
    wider = s.read("things", spark.createDataFrame([], "id long, v string, more double").schema)
    assert rows(wider) == [(1, "a", None)]
    with pytest.raises(ValueError, match="unknown"):
        s.read("things", spark.createDataFrame([], "id long").schema)
    three = s.commit("things", df, ["id"], two)
    assert three != one and [c["commit"] for c in s.history("things")] == [three, two, one]
    late = store.Store(spark, str(tmp_path / "store"))
    number = late._pointer("heads/things")[0]
    late._point("heads/things", number, {"commit": "theirs"})
    with pytest.raises(FileExistsError):
        late._point("heads/things", number, {"commit": "mine"})
    df.write.parquet(str(tmp_path / "store/parts/things/stray"))
    assert s.orphans() == ["parts/things/stray"]


def test_catalogue(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("Id,name,NAME\n1,a,\n2,,z\n", encoding="utf-8")
    df = store.read_catalogue(spark, str(path))
    assert df.columns == ["Id", "name", "NAME_2"] and rows(df.select("Id", "NAME_2")) == [("1", None), ("2", "z")]


def test_stream_windows(spark, tmp_path):
    events = spark.createDataFrame([(1, "u", "2024-01-01 00:10:00", 1.0), (2, "u", "2024-01-01 00:50:00", 2.0), (3, "u", "2024-01-01 05:00:00", 4.0)], "event_id int, user string, at string, value double").withColumn("ts", F.to_timestamp("at")).drop("at")
    events.write.parquet(str(tmp_path / "in"))
    stream = windows.parts_stream(spark, str(tmp_path / "in"), events.schema)
    windows.run_once(windows.windowed_counts(stream, "ts", "user", "1 hour", "10 minutes"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [(r["n"], r["total"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(2, 3.0)]
    windows.upsert_latest(spark, windows.parts_stream(spark, str(tmp_path / "in"), events.schema), str(tmp_path / "state"), str(tmp_path / "cp2"), ["user"], "ts")
    assert [r["event_id"] for r in spark.read.parquet(str(tmp_path / "state/v0")).collect()] == [3]


def test_intervals_against_brute_force(spark):
    """Short, long, empty and open intervals; one key has most rows."""
    import random

    rng = random.Random(2)
    points = [(rng.choice("aaab"), rng.randint(-50, 500), n) for n in range(150)] + [("a", None, 999)]
    spans = [(rng.choice("aaab"), *rng.choice([(x := rng.randint(-60, 500), x + rng.choice((-3, 0, 5, 40, 300))), (None, x), (x, None), (None, None)]), n) for n in range(60)]
    p, i = spark.createDataFrame(points, "k string, at long, p int"), spark.createDataFrame(spans, "k string, s long, e long, n int")
    want = sorted((q, n) for k, at, q in points for c, s, e, n in spans if k == c and at is not None and (s is None or s <= at) and (e is None or at <= e))
    assert sorted((r["p"], r["n"]) for r in joins.interval_join(p, i, "k", "at", "s", "e", 7).collect()) == want
    assert joins.interval_join(p.limit(0), i, "k", "at", "s", "e", 7).count() == joins.interval_join(p, i.limit(0), "k", "at", "s", "e", 7).count() == 0


def test_latest_before_of_a_hot_key(spark):
    """Rows of one key over all buckets, with empty buckets between, ties and rows before the first."""
    import random

    rng = random.Random(3)
    left = [(rng.choice(["a"] * 9 + ["b", "c", None]), n, rng.randint(0, 1000)) for n in range(200)]
    right = [(rng.choice("aaaaab"), rng.choice((rng.randint(100, 200), rng.randint(700, 800), 990)), n) for n in range(60)]
    want = sorted((n, max((t, r) for c, t, r in right if c == k and t <= at)[1]) for k, n, at in left if any(c == k and t <= at for c, t, _ in right))
    a, b = spark.createDataFrame(left, "k string, l int, at int"), spark.createDataFrame(right, "k string, ts int, r int")
    for buckets in (1, 4, 64):
        assert sorted((x["l"], x["r"]) for x in joins.latest_before(a, b, "k", "at", "ts", "r", buckets).collect()) == want
    assert joins.latest_before(a, b.limit(0), "k", "at", "ts", "r").count() == 0


def test_labels_of_a_hub(spark):
    pairs = spark.range(1, 4001).selectExpr("cast(0 as bigint) AS a", "id AS b")
    found = duplicates.label_propagation(spark, pairs)
    assert found.count() == 4001 and found.select("label").distinct().collect()[0][0] == 0


def test_bm25_of_odd_documents(spark):
    from brinework.operators import retrieval

    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"] * 5000), (3, []), (4, None), (5, ["c"]), (6, ["a", "b"])], "d long, t array<string>")
    queries = spark.createDataFrame([(1, ["a", "b", "b"]), (9, ["zz"]), (8, None), (7, [])], "qid long, terms array<string>")
    found = rows(retrieval.bm25(docs, "d", "t", queries, 2).select("qid", "doc", "rank"))
    assert found == [(1, 2, 2), (1, 6, 1)]
    assert retrieval.bm25(docs.limit(0), "d", "t", queries, 2).count() == retrieval.bm25(docs, "d", "t", queries.limit(0), 2).count() == 0
