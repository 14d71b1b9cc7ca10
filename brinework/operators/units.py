"""Problem 1: quantities recorded in different units.

Every printed value is read into bounds and a unit (beside the number, else in
the unit field, else in the quote or heading) and converted to the common unit
of its parameter.  Where no unit is printed anywhere, a random forest fitted on
rows with a printed unit predicts it from magnitude, parameter, source, number
format and the units of neighbouring rows; isotonic regression on rows it
hasn't seen turns its vote into a probability of being right.  Assignments
above a probability are converted, the others are left for review.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoint import Workspace
from ..functions import quantities
from ..tables import current, hash_sample, load

#: Labelled rows the forest and its calibration are fitted on, about (chosen by hash over all of them).
SAMPLE = 12_000
#: Part of the sample kept from the forest, for calibration.
HELD_OUT = 0.3
TREES, DEPTH, SEED = 20, 9, 17
#: Least calibrated probability of a predicted unit that is converted.
CONFIDENT = 0.9
#: Part of the printed units that p1_hidden hides.
HIDDEN = 0.2
#: Relative difference of a recorded bound from the printed one that is a fault.
TOLERANCE = 0.01

_PARSED = "low double, high double, offset double, factor double, unit string, decimals int, span double"


def _parse(printed: pd.Series, field: pd.Series, context: pd.Series, kind: pd.Series, quoted: bool) -> pd.DataFrame:
    rows = []
    for text, unit_text, about, of in zip(printed, field, context, kind, strict=True):
        found = quantities.read(text)
        if found is None:
            rows.append((None,) * 7)
            continue
        unit = quantities.leading_unit(found.rest, of) or quantities.unit_of(unit_text, of)
        unit = unit or (quantities.unit_in_quote(about, text, of) if quoted else quantities.trailing_unit(about, of))
        mark = max(text.find(","), text.find("."))
        decimals = 0 if mark < 0 else len(text[mark + 1 :]) - len(text[mark + 1 :].lstrip("0123456789"))
        span = found.high - found.low if found.low is not None and found.high is not None else -1.0
        rows.append((found.low, found.high, unit.offset if unit else None, unit.factor if unit else None, unit.name if unit else None, decimals, span))
    return pd.DataFrame(rows, columns=["low", "high", "offset", "factor", "unit", "decimals", "span"])


def _quoted(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for columns in batches:
        yield _parse(*columns, quoted=True)


def _headed(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for columns in batches:
        yield _parse(*columns, quoted=False)


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parameters' table: fixed, a few rows; a code listed twice counts once."""
    table = load(spark, sf_dir, "passport_parameters")
    return table.groupBy("parameter_code").agg(F.first("kind").alias("kind"), F.first("si_low").alias("si_low"), F.first("si_high").alias("si_high"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence and data cells that have a parameter and a number, with what is printed there.

    A null or unknown parameter, a null or blank value, a stand-in for a value
    and a header cell give no row.
    """
    known = F.broadcast(parameters(spark, sf_dir))
    evidence = current(spark, sf_dir, "passport_evidence", ["parameter_code", "value_as_printed", "unit_as_printed", "quote", "si_min", "si_max", "source_id", "page_id"])
    evidence = evidence.filter("value_as_printed is not null").join(known, "parameter_code").select(
        F.lit("EVIDENCE").alias("record_kind"), F.col("ev_id").alias("record_id"), "parameter_code", "kind", "si_low", "si_high", "source_id", F.col("page_id").alias("near"), "si_min", "si_max",
        F.pandas_udf(_quoted, _PARSED)("value_as_printed", "unit_as_printed", "quote", "kind").alias("q"),
    )
    cells = current(spark, sf_dir, "table_cells", ["property_key", "text", "unit", "header_text", "is_header", "source_id", "table_id"])
    cells = cells.filter("text is not null and property_key is not null and not coalesce(is_header, false)").withColumnRenamed("property_key", "parameter_code").join(known, "parameter_code").select(
        F.lit("CELL").alias("record_kind"), F.col("cell_id").alias("record_id"), "parameter_code", "kind", "si_low", "si_high", "source_id", F.col("table_id").alias("near"), F.lit(None).cast("double").alias("si_min"), F.lit(None).cast("double").alias("si_max"),
        F.pandas_udf(_headed, _PARSED)("text", "unit", "header_text", "kind").alias("q"),
    )
    return evidence.unionByName(cells).select("*", "q.*").drop("q").filter("low is not null or high is not null")


def _usual_units(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Per group its two most frequent units with their numbers of rows."""
    counts = rows.filter("unit is not null").groupBy(*by, "unit").agg(F.count(F.lit(1)).alias("n"), F.first("factor").alias("factor"))
    top = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("n", "unit", "factor")))), 1, 2)
    return counts.groupBy(*by).agg(top.alias(name))


def _neighbour(top: str) -> Column:
    """log10 of the factor of the group's usual unit, the row itself left out; -99 where there is none."""
    one, two = F.get(F.col(top), F.lit(0)), F.get(F.col(top), F.lit(1))
    own = F.col("unit").eqNullSafe(one["unit"])
    others = one["n"] - F.when(own, 1).otherwise(0)
    second = F.coalesce(two["n"], F.lit(0))
    chosen = F.when((others > 0) & (others >= second), one["factor"]).when(second > 0, two["factor"])
    return F.coalesce(F.log10(chosen), F.lit(-99.0))


FEATURES = ["code", "is_cell", "magnitude", "over_low", "under_high", "decimals", "spread", "near_unit", "source_unit", "usual_unit"]


def with_features(rows: DataFrame, codes: StringIndexerModel) -> DataFrame:
    """Adds the columns the forest looks at. Groups are pre-aggregated, so a hot source costs no more than its units."""
    # Rows without a page or table have no neighbours: spread by a number they match nothing and fill no single task.
    spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64("record_id"), F.lit(10_000)).cast("string"))
    near = _usual_units(rows.filter("near is not null"), ["near", "parameter_code"], "t_near")
    rows = rows.withColumn("near", F.coalesce("near", spread)).join(near, ["near", "parameter_code"], "left")
    rows = rows.join(_usual_units(rows, ["source_id", "parameter_code"], "t_source"), ["source_id", "parameter_code"], "left")
    # One row per parameter of the fixed table.
    rows = rows.join(F.broadcast(_usual_units(rows, ["parameter_code"], "t_usual")), "parameter_code", "left")
    size = F.abs(F.coalesce("low", "high"))
    magnitude = F.when(size > 0, F.log10(size)).otherwise(-12.0)
    rows = rows.withColumns(
        {
            "is_cell": (F.col("record_kind") == "CELL").cast("double"),
            "magnitude": magnitude,
            "over_low": magnitude - F.log10(F.greatest(F.col("si_low"), F.lit(1e-9))),
            "under_high": F.log10(F.greatest(F.col("si_high"), F.lit(1e-9))) - magnitude,
            "decimals": F.col("decimals").cast("double"),
            "spread": F.when((F.col("span") > 0) & (size > 0), F.col("span") / size).otherwise(F.when(F.col("span") < 0, -1.0).otherwise(0.0)),
            "near_unit": _neighbour("t_near"),
            "source_unit": _neighbour("t_source"),
            "usual_unit": _neighbour("t_usual"),
        }
    )
    return codes.transform(rows).drop("t_near", "t_source", "t_usual")


class UnitPredictor:
    """The fitted forest with its calibration."""

    def __init__(self, labels: list[str], forest, calibration, codes: StringIndexerModel):
        self.labels, self.forest, self.calibration, self.codes = labels, forest, calibration, codes

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows (with features) plus predicted (kind|unit), and probability of being right, calibrated.

        Only units of the row's own kind can win.
        """
        scored = self.forest.transform(VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(rows))
        names = F.array(*map(F.lit, self.labels))
        votes = F.zip_with(vector_to_array("probability"), names, lambda p, label: F.struct(p.alias("p"), label.alias("label")))
        fitting = F.filter(votes, lambda v: F.startswith(v["label"], F.concat("kind", F.lit("|"))))
        best = F.array_max(F.transform(fitting, lambda v: F.struct(v["p"].alias("p"), v["label"].alias("label"))))
        scored = scored.withColumn("best", best).drop("features", "rawPrediction", "probability", "prediction")
        scored = scored.withColumn("vote", F.coalesce("best.p", F.lit(0.0))).withColumn("predicted", F.col("best.label")).drop("best")
        return self.calibration.transform(scored).withColumnRenamed("prediction", "probability")


def fit_predictor(labelled: DataFrame, codes: StringIndexerModel, sample: int = SAMPLE) -> UnitPredictor | None:
    """Fits on about ``sample`` labelled rows; None if there are too few to learn from."""
    rows = hash_sample(labelled, ["record_kind", "record_id"], sample).withColumn("label_name", F.concat_ws("|", "kind", "unit"))
    rows = rows.select("record_kind", "record_id", "kind", "label_name", *FEATURES).repartition(4).cache()
    try:
        if rows.count() < 50:
            return None
        indexer = StringIndexer(inputCol="label_name", outputCol="label", handleInvalid="skip").fit(rows)
        indexed = indexer.transform(rows)
        held = F.pmod(F.xxhash64(F.lit(SEED), "record_id"), F.lit(1000)) < int(1000 * HELD_OUT)
        learn, check = indexed.filter(~held), indexed.filter(held)
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64, featureSubsetStrategy="0.6", minInstancesPerNode=2, featuresCol="features", labelCol="label")
        model = forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(learn))
        raw = UnitPredictor(indexer.labels, model, _Unchanged(), codes).predict(check)
        right = raw.withColumn("right", (F.col("predicted") == F.col("label_name")).cast("double"))
        calibration = IsotonicRegression(featuresCol="vote", labelCol="right", predictionCol="prediction").fit(right)
        return UnitPredictor(indexer.labels, model, calibration, codes)
    finally:
        rows.unpersist()


class _Unchanged:
    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("prediction", F.col("vote"))


def _scale_of(label: Column) -> tuple[Column, Column]:
    """Offset and factor of kind|unit, from the fixed table of units."""
    table = {f"{kind}|{name}": (offset, factor) for (kind, _), (offset, factor, name) in quantities._FOLDED.items()}
    offsets = F.create_map(*(F.lit(x) for k, (o, _) in table.items() for x in (k, float(o))))
    factors = F.create_map(*(F.lit(x) for k, (_, f) in table.items() for x in (k, float(f))))
    words = F.regexp_extract(label, r"\|([0-9.e+]+) \D", 1)
    scale = F.when(words != "", F.try_to_number(words, F.lit("9999999999")).cast("double")).otherwise(1.0)
    bare = F.regexp_replace(label, r"\|[0-9.e+]+ (?=\D)", "|")
    return F.element_at(offsets, bare), F.element_at(factors, bare) * scale


def _codes(spark: SparkSession, sf_dir: str) -> StringIndexerModel:
    return StringIndexer(inputCol="parameter_code", outputCol="code", handleInvalid="keep").fit(parameters(spark, sf_dir))


def _opinions(predictor: UnitPredictor | None, rows: DataFrame) -> DataFrame:
    if predictor is None:
        return rows.withColumn("predicted", F.lit(None).cast("string")).withColumn("probability", F.lit(0.0))
    return predictor.predict(rows)


def _in_common(scored: DataFrame) -> DataFrame:
    """Basis of each row's unit, and its bounds in the common unit; predicted units below CONFIDENT convert nothing."""
    offset, factor = _scale_of(F.col("predicted"))
    confident = F.col("unit").isNull() & (F.col("probability") >= CONFIDENT)
    scored = scored.withColumn("basis", F.when(F.col("unit").isNotNull(), "PRINTED").when(confident, "PREDICTED").otherwise("REVIEW"))
    scored = scored.withColumn("offset", F.coalesce("offset", F.when(confident, offset))).withColumn("factor", F.coalesce("factor", F.when(confident, factor)))
    return scored.withColumns({c: (F.col(b) + F.col("offset")) * F.col("factor") for c, b in (("common_low", "low"), ("common_high", "high"))})


def converted(spark: SparkSession, sf_dir: str, review_all: bool = False) -> DataFrame:
    """Every reading with its bounds in the parameter's common unit.

    basis: PRINTED, PREDICTED (no unit printed, confident) or REVIEW (no unit
    printed, not confident: bounds are null).  With ``review_all`` the forest
    also scores printed units: predicted and probability are then never null.
    Where every reading has a printed unit and no opinion is asked for, there
    is nothing to predict and nothing is fitted.
    """
    work = Workspace(spark, "units")
    rows = work.cut(readings(spark, sf_dir), "readings")
    columns = ["record_kind", "record_id", "parameter_code", "si_low", "si_high", "si_min", "si_max", "low", "high", "unit", "offset", "factor", "predicted", "probability"]
    opinionless = rows.withColumn("predicted", F.lit(None).cast("string")).withColumn("probability", F.lit(None).cast("double")).select(*columns)
    if not review_all and rows.filter("unit is null").isEmpty():
        return _in_common(opinionless)
    codes = _codes(spark, sf_dir)
    featured = work.cut(with_features(rows, codes), "features")
    predictor = fit_predictor(featured.filter("unit is not null"), codes)
    scored = _opinions(predictor, featured if review_all else featured.filter("unit is null")).select(*columns)
    if not review_all:
        scored = scored.unionByName(opinionless.filter("unit is not null"))
    return _in_common(scored)


def hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the forest does where it must: the printed units of a part of all readings, chosen by hash, are hidden from it.

    Per parameter: readings with a printed unit, those hidden, those of them
    converted by a confident prediction and sent to review, and how many of
    the converted have both bounds within TOLERANCE of the printed ones.
    """
    work = Workspace(spark, "hidden")
    rows = work.cut(readings(spark, sf_dir).filter("unit is not null"), "readings")
    hide = F.pmod(F.xxhash64(F.lit("hidden"), "record_kind", "record_id"), F.lit(1000)) < int(1000 * HIDDEN)
    masked = rows.withColumn("was_offset", F.col("offset")).withColumn("was_factor", F.col("factor"))
    masked = masked.withColumns({c: F.when(~hide, F.col(c)) for c in ("unit", "offset", "factor")})
    codes = _codes(spark, sf_dir)
    featured = work.cut(with_features(masked, codes), "features")
    told = _in_common(_opinions(fit_predictor(featured.filter("unit is not null"), codes), featured.filter("unit is null")))

    def near(bound: str) -> Column:
        was = (F.col(bound) + F.col("was_offset")) * F.col("was_factor")
        return F.col(bound).isNull() | (F.abs(F.col("common_" + bound) - was) <= TOLERANCE * F.abs(was))

    right = (F.col("basis") == "PREDICTED") & near("low") & near("high")
    found = told.groupBy("parameter_code").agg(F.count(F.lit(1)).alias("hidden"), F.count_if(F.col("basis") == "PREDICTED").alias("converted"), F.count_if(F.col("basis") == "REVIEW").alias("review"), F.count_if(right).alias("right"))
    return rows.groupBy("parameter_code").agg(F.count(F.lit(1)).alias("readings")).join(found, "parameter_code", "left").fillna(0)


def faults(rows: DataFrame) -> DataFrame:
    """record_kind, record_id: recorded bounds that differ from the printed, and cells out of range."""

    def differs(recorded: str, printed: str) -> Column:
        return F.coalesce(F.abs(F.col(recorded) - F.col(printed)) > TOLERANCE * F.abs(F.col(printed)), F.lit(False))

    def outside(bound: str) -> Column:
        slack = 1e-9 * F.greatest(F.abs("si_low"), F.abs("si_high"))
        return F.coalesce((F.col(bound) < F.col("si_low") - slack) | (F.col(bound) > F.col("si_high") + slack), F.lit(False))

    evidence = (F.col("record_kind") == "EVIDENCE") & (differs("si_min", "common_low") | differs("si_max", "common_high"))
    cells = (F.col("record_kind") == "CELL") & (outside("common_low") | outside("common_high"))
    return rows.filter(evidence | cells).select("record_kind", "record_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faults(converted(spark, sf_dir))


def p1_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readings in common units with the basis of their unit and the forest's opinion of it."""
    return converted(spark, sf_dir, review_all=True).select("record_kind", "record_id", "parameter_code", "basis", "unit", "predicted", F.round("probability", 6).alias("probability"), "common_low", "common_high")


def p1_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per parameter, what becomes of readings whose printed unit is hidden: converted, right, left for review."""
    return hidden(spark, sf_dir)


QUERIES = {"p1_found": p1_found, "p1_units": p1_units, "p1_hidden": p1_hidden}
ORACLES: dict[str, str] = {}
