"""Problem 7: texts of several sources mixed to target weights.

Every document gets a fixed pseudo-random number of 60 bits.  A source's share
of the mix is a threshold on it: documents below the threshold are used once
more than those above.  The threshold is found by histograms of tokens over
the number's leading 12 bits: the bucket in which the running sum passes the
budget is the only one looked into further, 12 bits at a time, until it is a
single number.  Nothing is sorted, and what is gathered per step is 4096
buckets a source.  A larger budget only raises the threshold, so mixes of
growing budgets are nested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoint import Workspace
from ..tables import load
from .tokens import DEFAULT, TOKENIZERS, token_count

BITS, STEP = 60, 12


def sized_documents(spark: SparkSession, docs: DataFrame, name: str = DEFAULT, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, source, tokens, spot (0 .. 2^60-1) of the documents that have a source and a token."""
    spot = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col("doc_id")), 64 - BITS)
    return docs.filter("source is not null").select("doc_id", "source", token_count(spark, F.col("text"), name, folder).cast("long").alias("tokens"), spot.alias("spot")).filter("tokens > 0")


def budgets(sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Per target source: its supply, the tokens it may give with repeats (cap), weight and budget.

    Weights are the target shares over the sources that have any text.  With
    ``total`` None the mix is the largest in which every weight is met; with a
    total, sources whose weight of it exceeds their cap give their cap, and the
    others fill up in proportion to their weights.  A target listed twice
    counts by its greatest share; a share that is null or not positive gives
    no budget; max_repeats below one counts as one.
    """
    wanted = targets.filter("source is not null").groupBy("source").agg(F.max(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).alias("repeats"))).alias("t")).select("source", "t.*")
    supply = sized.groupBy("source").agg(F.sum("tokens").alias("supply"), F.count(F.lit(1)).alias("n_docs"))
    rows = wanted.join(supply, "source", "left").fillna(0, ["supply", "n_docs"])
    # One row a target: windows without a partition are over that configuration table only.
    whole = Window.partitionBy(F.lit(0))
    usable = (F.col("supply") > 0) & (F.col("share") > 0)
    rows = rows.withColumn("weight", F.coalesce(F.try_divide(F.when(usable, F.col("share")), F.sum(F.when(usable, F.col("share"))).over(whole)), F.lit(0.0)))
    rows = rows.withColumn("cap", F.col("supply") * F.col("repeats"))
    level = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight"))
    rows = rows.withColumn("level", level)
    if total is None:
        rows = rows.withColumn("water", F.min("level").over(whole))
    else:
        # sum(min(cap, weight * water)) = total: sources in order of level are full one after the other.
        before = whole.orderBy(F.col("level").asc_nulls_last(), "source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        full, rest = F.sum(F.when(F.col("weight") > 0, F.col("cap")).otherwise(0)).over(before), 1 - F.sum("weight").over(before)
        at = F.coalesce(full - F.when(F.col("weight") > 0, F.col("cap")).otherwise(0), F.lit(0))
        open_ = F.round(rest + F.col("weight"), 12)
        water = F.try_divide(F.lit(float(total)) - at, open_)
        first = F.min(F.when((F.col("weight") > 0) & (water <= F.col("level")), F.struct("level", "source", water.alias("water")))).over(whole)
        rows = rows.withColumn("water", first["water"])
        rows = rows.withColumn("water", F.coalesce("water", F.max("level").over(whole)))
    budget = F.least(F.col("cap").cast("double"), F.col("weight") * F.col("water"))
    return rows.withColumn("budget", F.coalesce(F.round(budget).cast("long"), F.lit(0))).drop("level", "water")


def thresholds(work: Workspace, sized: DataFrame, budget: DataFrame) -> DataFrame:
    """source, rounds (uses of every document), below (documents with spot < below are used once more)."""
    open_ = budget.filter("budget > 0").select("source", F.expr("budget div supply").alias("rounds"), F.expr("budget % supply").alias("left"), F.lit(0).cast("long").alias("prefix"))
    open_ = work.cut(open_, "open0")
    for k in range(BITS // STEP):
        shift = BITS - STEP * (k + 1)
        inside = sized.join(F.broadcast(open_.filter("left > 0").select("source", "prefix")), "source").filter(F.shiftrightunsigned("spot", shift + STEP) == F.col("prefix"))
        buckets = inside.groupBy("source", F.shiftrightunsigned("spot", shift).alias("bucket")).agg(F.sum("tokens").alias("tokens"))
        upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket"))
        passed = buckets.select("source", "bucket", "tokens", upto.alias("upto")).join(F.broadcast(open_.select("source", "left")), "source").filter("upto >= left")
        boundary = passed.groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("left") - F.col("upto") + F.col("tokens")).alias("rest"), "tokens"), "bucket").alias("b"))
        last = shift == 0
        # The last bucket is one number: it is taken if that comes nearer to the budget.
        prefix = F.when(F.col("b.rest") * 2 >= F.col("b.tokens"), F.col("b.bucket") + 1).otherwise(F.col("b.bucket")) if last else F.col("b.bucket")
        left = F.lit(0).cast("long") if last else F.col("b.rest")
        deeper = open_.filter("left > 0").join(F.broadcast(boundary), "source").select("source", "rounds", left.alias("left"), prefix.alias("prefix"))
        done = open_.filter("left <= 0").select("source", "rounds", "left", F.lit(0).cast("long").alias("prefix"))
        open_ = work.cut(deeper.unionByName(done), f"open{k + 1}")
    return open_.select("source", "rounds", F.col("prefix").alias("below"))


def mix(spark: SparkSession, docs: DataFrame, targets: DataFrame, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(uses, report).

    uses: doc_id, source, tokens, copies (1 or more) of every document in the
    mix.  report: per target source its supply, budget, tokens really used and
    the share of the mix it really reaches; a source without text reaches 0.
    Documents without source or without a token, and sources without a target,
    are not used.  Empty tables give an empty mix.
    """
    work = Workspace(spark, "mix")
    sized = work.cut(sized_documents(spark, docs), "sized")
    plan = work.cut(budgets(sized, targets, total), "budgets")
    at = thresholds(work, sized, plan)
    copies = (F.col("rounds") + (F.col("spot") < F.col("below")).cast("long")).cast("int")
    uses = sized.join(F.broadcast(at), "source").withColumn("copies", copies).filter("copies > 0").select("doc_id", "source", "tokens", "copies")
    used = uses.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"), F.max("copies").alias("most_copies"))
    report = plan.join(used, "source", "left").fillna(0, ["used", "most_copies"])
    actual = F.try_divide(F.col("used"), F.sum("used").over(Window.partitionBy(F.lit(0))))
    report = report.select("source", F.col("share").alias("target_share"), "repeats", "n_docs", "supply", "budget", "used", "most_copies", F.coalesce(actual, F.lit(0.0)).alias("actual_share"))
    return uses, report


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest mix that meets every target share."""
    return mix(spark, load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))[1]


def _full(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A mix as large as the texts of the target sources: small ones end at their cap, the others fill up."""
    docs, targets = load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets")
    total = sized_documents(spark, docs, DEFAULT).join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").agg(F.sum("tokens")).first()[0]
    return mix(spark, docs, targets, int(total or 0))


def p7_mix_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a mix as large as the texts of the target sources."""
    return _full(spark, sf_dir)[0]


def p7_shares_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _full(spark, sf_dir)[1]


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of both mixes, per source: whether no text is used too often, and whether the tokens used miss the budget by one text at most."""
    out = None
    longest = sized_documents(spark, load(spark, sf_dir, "documents"), DEFAULT).groupBy("source").agg(F.max("tokens").alias("longest"))
    for name, (uses, report) in (("largest", mix(spark, load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))), ("full", _full(spark, sf_dir))):
        most = uses.groupBy("source").agg(F.max("copies").alias("copies"))
        rows = report.join(most, "source", "left").join(longest, "source", "left").select(F.lit(name).alias("mix"), "source", (F.coalesce("copies", F.lit(0)) <= F.col("repeats")).alias("within_cap"), F.abs(F.col("used") - F.col("budget")).alias("missed"), F.coalesce("longest", F.lit(0)).alias("longest"))
        rows = rows.withColumn("within_one_text", (F.col("missed") <= F.col("longest")))
        out = rows if out is None else out.unionByName(rows)
    return out
