"""Conversion to common units and the prediction of missing ones."""

import datetime

from pyspark.sql import functions as F

from brinework.operators import units

T = datetime.datetime(2024, 1, 1)
UCS = {"parameter_code": "UCS", "kind": "stress", "si_unit": "Pa", "si_low": 5e6, "si_high": 6e7}


def evidence(i, **more):
    return {"ev_id": f"E{i}", "parameter_code": "UCS", "value_as_printed": "10", "unit_as_printed": "МПа", "si_min": 1e7, "si_max": 1e7, "source_id": "S", "recorded_at": T} | more


def cell(i, **more):
    return {"cell_id": f"C{i}", "table_id": "t", "property_key": "UCS", "text": "10", "unit": "MPa", "is_header": False, "source_id": "S", "created_at": T} | more


def test_found(spark, tables):
    d = tables(
        {"unit": "'x'", "kind": "'y'", "low": "1", "factor": "2", "q": "3"},
        passport_parameters=[UCS],
        passport_evidence=[
            evidence(1),
            evidence(2, si_min=1e6),
            evidence(3, si_min=None, si_max=None),
            evidence(4, value_as_printed="не более 10", si_min=5.0),
            evidence(5, value_as_printed=None),
            evidence(6, value_as_printed="нет данных"),
            evidence(7, unit_as_printed="-", quote="предел прочности 10 кПа"),
            evidence(8, si_min=1e6, recorded_at=datetime.datetime(2023, 1, 1)),
            evidence(8),
            evidence(9, parameter_code=None, si_min=1.0),
            evidence(10, value_as_printed="9" * 5000),
            evidence(11, value_as_printed="1e999999"),
            evidence(2, si_min=1e6),
        ],
        table_cells=[cell(1), cell(2, text="100"), cell(3, text="100", is_header=True), cell(4, text="100 кПа"), cell(5, text=None), cell(6, unit=None, header_text="UCS, Pa"), cell(7, property_key=None, text="1e9"), cell(2, text="100")],
    )
    found = {tuple(r) for r in units.p1_found(spark, d).collect()}
    assert found == {("EVIDENCE", "E2"), ("EVIDENCE", "E7"), ("CELL", "C2"), ("CELL", "C4"), ("CELL", "C6")}


def test_empty(spark, tables):
    assert units.p1_found(spark, tables()).count() == 0


def test_held_out(spark):
    """Units taken from labelled rows are predicted again, and confident predictions are right."""
    import os

    from conftest import DATA

    if not os.path.isdir(DATA / "sf0.01"):
        return
    d = str(DATA / "sf0.01")
    from pyspark.ml.feature import StringIndexer

    codes = StringIndexer(inputCol="parameter_code", outputCol="code", handleInvalid="keep").fit(units.parameters(spark, d))
    rows = units.with_features(units.readings(spark, d), codes).cache()
    hidden = F.pmod(F.xxhash64(F.lit("test"), "record_id"), F.lit(5)) == 0
    predictor = units.fit_predictor(rows.filter(~hidden), codes)
    scored = predictor.predict(rows.filter(hidden)).withColumn("right", F.col("predicted") == F.concat_ws("|", "kind", "unit"))
    sure = scored.filter(F.col("probability") >= units.CONFIDENT)
    n, share, right = scored.count(), sure.count(), sure.filter("right").count()
    rows.unpersist()
    assert share > 0.2 * n and right >= 0.9 * share
    assert scored.filter(~F.startswith("predicted", F.concat("kind", F.lit("|")))).count() == 0


def test_hidden_units_as_a_query(spark):
    """Confident predictions of hidden units are right, the others wait for review; nothing is lost."""
    from conftest import DATA

    if not (DATA / "sf0.01").is_dir():
        return
    rows = units.p1_hidden(spark, str(DATA / "sf0.01")).collect()
    total = {k: sum(r[k] for r in rows) for k in ("readings", "hidden", "converted", "review", "right")}
    assert total["converted"] + total["review"] == total["hidden"] and 0.15 * total["readings"] < total["hidden"] < 0.25 * total["readings"]
    assert total["converted"] > 0.2 * total["hidden"] and total["right"] >= 0.9 * total["converted"]


def test_missing_units_go_through_the_forest(spark, tables):
    """With too few labelled rows nothing can be predicted: a value without a unit is left for review."""
    d = tables(passport_parameters=[UCS], passport_evidence=[evidence(1), evidence(2, unit_as_printed=None, quote=None, page_id="p")])
    assert {r["record_id"]: r["basis"] for r in units.converted(spark, d).collect()} == {"E1": "PRINTED", "E2": "REVIEW"}
