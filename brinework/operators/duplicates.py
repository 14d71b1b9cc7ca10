"""Duplicate rules over text units: sketches, verification, groups and their kinds (D-family)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoint import Workspace
from .skew import hot_split_join

PERMUTATIONS, ROWS_PER_BAND = 96, 3
#: Most units of a bucket, or of a block of one, that a cell compares.
CELL = 1024


def _signatures(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    random = np.random.default_rng(7)
    seeds = random.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64)
    mult = np.uint64(0xBF58476D1CE4E5B9)
    for shingles in batches:
        out = []
        for s in shingles:
            keys = np.asarray(s, dtype=np.int64).view(np.uint64)
            mixed = (keys[None, :] ^ seeds[:, None]) * mult
            mixed ^= mixed >> np.uint64(31)
            out.append((mixed * mult).min(axis=1).view(np.int64))
        yield pd.Series(out)


def minhash_bands(units: DataFrame, unit: str, shingles: str) -> DataFrame:
    """unit, band, key: MinHash signatures cut into bands (D-02, D-03)."""
    signed = units.filter(F.size(shingles) > 0).select(unit, F.pandas_udf(_signatures, "array<long>")(F.col(shingles)).alias("sig"))
    bands = F.transform(F.sequence(F.lit(0), F.lit(PERMUTATIONS // ROWS_PER_BAND - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(F.slice("sig", b * ROWS_PER_BAND + 1, ROWS_PER_BAND)).alias("key")))
    return signed.select(unit, F.inline(bands))


def star_candidates(bands: DataFrame, unit: str) -> DataFrame:
    """a < b: every unit of a bucket with the bucket's least unit. A bucket of n gives n - 1 rows, however large."""
    least = bands.groupBy("band", "key").agg(F.min(unit).alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return bands.join(least, ["band", "key"]).filter(F.col(unit) > F.col("a")).select("a", F.col(unit).alias("b")).distinct()


def bucket_candidates(bands: DataFrame, sizes: DataFrame, unit: str, threshold: float) -> DataFrame:
    """a < b: all units of a bucket with each other, unless their set sizes (unit, n) rule the Jaccard threshold out.

    A bucket above CELL units is cut into cells of block against block, so no
    task meets a whole hot bucket.
    """
    several = bands.groupBy("band", "key").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("blocks"), F.count(F.lit(1)).alias("units")).filter("units > 1").drop("units")
    placed = bands.join(sizes, unit).join(several, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64(unit), "blocks").cast("int"))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(unit, "n", "band", "key", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    a = cells.select("band", "key", "low", "high", F.col(unit).alias("a"), F.col("n").alias("na"), F.col("block").alias("block_a"))
    b = cells.select("band", "key", "low", "high", F.col(unit).alias("b"), F.col("n").alias("nb"), F.col("block").alias("block_b"))
    met = a.join(b, ["band", "key", "low", "high"]).filter("a < b and (low = high or block_a <> block_b)")
    return met.filter(F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9).select("a", "b").distinct()


def equal_sets(spark: SparkSession, units: DataFrame, unit: str, shingles: str) -> tuple[DataFrame, DataFrame]:
    """Every distinct set under its least unit (unit, shingles), and (unit, first) of the units whose set several have."""
    work = Workspace(spark, "sets")
    keyed = units.select(unit, F.array_sort(shingles).alias(shingles))
    keyed = work.cut(keyed.withColumn("k", F.struct(F.xxhash64(shingles), F.xxhash64(F.lit(7), shingles))), "keyed")
    firsts = work.cut(keyed.groupBy("k").agg(F.min(F.struct(unit, shingles)).alias("r"), F.count(F.lit(1)).alias("n")).select("k", "r.*", "n"), "firsts")
    several = firsts.filter("n > 1").select("k", F.col(unit).alias("first"), "n")
    return firsts.select(unit, shingles), hot_split_join(keyed.select(unit, "k"), several, "k", "first", "n", keyed.count()).filter("first is not null").select(unit, "first")


def verified(pairs: DataFrame, units: DataFrame, unit: str, shingles: str) -> DataFrame:
    """a, b, shared, containment, jaccard of candidate pairs (D-05, D-06), counted exactly."""
    j = pairs.join(units.select(F.col(unit).alias("a"), F.col(shingles).alias("x")), "a").join(units.select(F.col(unit).alias("b"), F.col(shingles).alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return j.select("a", "b", shared.cast("long").alias("shared"), (shared / F.least(F.size("x"), F.size("y"))).alias("containment"), (shared / (F.size("x") + F.size("y") - shared)).alias("jaccard"))


def label_propagation(spark: SparkSession, pairs: DataFrame, max_rounds: int = 50) -> DataFrame:
    """id, label: each record's least reachable record (D-07).

    Every round takes the least label of the neighbours and then the label of
    that label (pointer jumping), until nothing changes.
    """
    work = Workspace(spark, "labels")
    both = work.cut(pairs.select(F.col("a").alias("id"), F.col("b").alias("near")).unionAll(pairs.select(F.col("b").alias("id"), F.col("a").alias("near"))).distinct(), "edges")
    labels = work.cut(both.groupBy("id").agg(F.least(F.min("near"), F.col("id")).alias("label"), F.count(F.lit(1)).alias("degree")), "labels0")
    total = both.count()
    for k in range(1, max_rounds + 1):
        # A hub is the neighbour of very many: its rows are spread.
        of = labels.select(F.col("id").alias("near"), F.col("label").alias("other"), "degree")
        near = hot_split_join(both, of, "near", "other", "degree", total).groupBy("id").agg(F.min("other").alias("other"))
        lower = work.cut(labels.join(near, "id").select("id", "label", "degree", F.least("label", "other").alias("lower")), f"lower{k}")
        # So is a label that very many share already.
        shared = lower.groupBy("lower").agg(F.count(F.lit(1)).alias("weight"))
        far = shared.join(labels.select(F.col("id").alias("lower"), F.col("label").alias("far")), "lower", "left")
        jumped = hot_split_join(lower, far, "lower", "far", "weight", total).select("id", "label", "degree", F.least("lower", F.coalesce("far", "lower")).alias("now"))
        step = work.cut(jumped, f"labels{k}")
        if step.filter("now <> label").isEmpty():
            return step.select("id", "label")
        labels = step.select("id", F.col("now").alias("label"), "degree")
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
