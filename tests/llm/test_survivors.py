import datetime
import random

from brinework.llm import survivors as S

T = datetime.datetime(2024, 1, 1)


def test_against_sorting(spark):
    rng = random.Random(5)
    data = [(f"g{rng.randrange(8)}", f"r{i:03}", rng.random() < 0.3, rng.randrange(4), T + datetime.timedelta(days=rng.randrange(3)) if rng.random() < 0.9 else None, rng.choice([None, "x", "y"]), rng.choice([None, "z"])) for i in range(200)]
    df = spark.createDataFrame(data, "group_id string, record_id string, mark boolean, trust int, recency timestamp, f string, g string").withColumn("value", S.F.lit("clash"))
    found = {(r["group_id"], r["field_name"]): (r["record_id"], r["value"]) for r in S.survivors(df, ["f", "g"]).collect()}
    want = {}
    for group, record, mark, trust, at, f, g in sorted(data, key=lambda r: (not r[2], r[3], -(r[4] or datetime.datetime(1, 1, 2)).timestamp(), r[1])):
        for name, v in (("f", f), ("g", g)):
            if v is not None:
                want.setdefault((group, name), (record, v))
    assert found == want


def test_hot_group_is_reduced_first(spark):
    df = spark.range(20000).selectExpr("'g' AS group_id", "concat('r', lpad(id, 6, '0')) AS record_id", "id % 2 = 0 AS mark", "cast(id % 3 AS int) AS trust", "timestamp_micros(id) AS recency", "'v' AS f")
    cands = S.candidates(df, ["f"])
    assert cands.count() == 6
    assert S.survivors(df, ["f"]).collect()[0]["record_id"] == "r019998"


def test_values(spark):
    texts = ["x", " ", "", None, "н/д", "N/A", " — ", "...", "нет данных", "0", "null", "-5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(S.real_text(S.F.col("t")).alias("t")).filter("t is not null")
    assert sorted(r[0] for r in df.collect()) == ["-5", "0", "x"]
    years = spark.createDataFrame([(y,) for y in (1899, 1900, 2030, 2031, 0, None)], "y short").select(S.real_year(S.F.col("y")).alias("y")).filter("y is not null")
    assert sorted(r[0] for r in years.collect()) == ["1900", "2030"]
    nan = spark.createDataFrame([(float("nan"),), (0.5,), (None,)], "c double").select(S.real_number(S.F.col("c")).alias("c")).filter("c is not null")
    assert [r[0] for r in nan.collect()] == ["0.5"]


def test_spelling_states_and_nulls(spark, tables):
    row = {"copy_cluster": "CC-1", "source_id": "S1", "recorded_at": T, "unit_as_printed": "m"}
    d = tables(
        {"mark": "true", "trust": "0", "group_id": "'x'"},
        sources=[{"source_id": "S1", "trust_rank": 2}, {"source_id": "S2", "trust_rank": None}],
        passport_evidence=[row | {"ev_id": "E1", "copy_cluster": " cc-1 ", "source_id": "S2"}, row | {"ev_id": "E2"}, row | {"ev_id": "E2", "unit_as_printed": "old", "recorded_at": datetime.datetime(2020, 1, 1), "copy_role": "PRIMARY"}, row | {"ev_id": "E3", "copy_role": "PRIMARY", "unit_as_printed": "?"}, {"ev_id": "E4", "copy_cluster": None, "unit_as_printed": "m"}, row | {"ev_id": "E5", "source_id": None, "conditions": "c" * 10000}],
        nav_dup_members=[{"cluster_id": "D", "unit_id": "U", "cosine": float("nan"), "pub_year": 9999, "work_id": "w", "recorded_at": T}],
    )
    assert {tuple(r) for r in S.p5_found(spark, d).collect()} == {("CC-1", "unit_as_printed", "E2"), ("CC-1", "conditions", "E5"), ("D", "work_id", "U")}


def test_layers(spark):
    """A value from the third layer: two newer and better trusted rows have none."""
    t = lambda d: datetime.datetime(2024, 1, d)
    rows = [("g", "r1", True, 1, t(9), "a", None), ("g", "r2", False, 1, t(8), None, None), ("g", "r3", False, 2, t(7), None, "x"), ("g", "r4", False, 3, t(8), None, None), ("h", "r5", False, 1, None, None, "y")]
    df = spark.createDataFrame(rows, "group_id string, record_id string, mark boolean, trust int, recency timestamp, f string, k string")
    found = {(r["group_id"], r["field_name"]): (r["record_id"], r["layer"]) for r in S.layers(df, S.survivors(df, ["f", "k"])).collect()}
    assert found == {("g", "f"): ("r1", 1), ("g", "k"): ("r3", 3), ("h", "k"): ("r5", 1)}
