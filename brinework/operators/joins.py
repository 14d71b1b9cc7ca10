"""Joins that Spark has no operator for, as compositions of equi-joins."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoint import Workspace

#: Most keys of equal boxes that one row holds, on average.
MEMBERS = 1000


def interval_join(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points inside closed intervals of the same key; null bounds are open (J-04, J-05).

    Bins make it an equi-join.  An interval is binned at the level whose bins
    (``width`` times a power of two) are at least as long as itself, so it
    meets two bins at most, however long it is; a point has one bin for each
    level that occurs, of which there can't be more than 64.  Open sides are
    closed at the least or greatest point, so they spread over bins as well
    and no key's rows have to meet in one task.
    """
    edge = points.agg(F.min(at).alias("__least"), F.max(at).alias("__most"))
    closed = intervals.crossJoin(F.broadcast(edge)).withColumns({"__s": F.coalesce(start, "__least"), "__e": F.coalesce(end, "__most")}).filter("__s <= __e").drop("__least", "__most")
    size = F.greatest((F.col("__e") - F.col("__s")).cast("double") / width, F.lit(1.0))
    leveled = closed.withColumn("__level", F.ceil(F.log2(size)).cast("int"))
    wide = F.lit(float(width)) * F.pow(F.lit(2.0), F.col("__level"))
    binned = leveled.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("__s") / wide), F.floor(F.col("__e") / wide)))).drop("__s", "__e")
    levels = leveled.select("__level").distinct()
    tagged = points.filter(F.col(at).isNotNull()).crossJoin(F.broadcast(levels)).withColumn("__bin", F.floor(F.col(at) / wide))
    met = tagged.join(binned, [key, "__level", "__bin"])
    inside = F.coalesce(F.col(start) <= F.col(at), F.lit(True)) & F.coalesce(F.col(at) <= F.col(end), F.lit(True))
    return met.filter(inside).drop("__level", "__bin")


def array_overlap_join(left: DataFrame, right: DataFrame, left_id: str, left_array: str, right_id: str, right_array: str) -> DataFrame:
    """(left_id, right_id) whose arrays share an element (J-08): an equi-join of the elements."""
    a = left.select(left_id, F.explode(F.array_distinct(left_array)).alias("__e"))
    b = right.select(right_id, F.explode(F.array_distinct(right_array)).alias("__e"))
    return a.join(b, "__e").select(left_id, right_id).distinct()


def _number(df: DataFrame, column: str) -> Column:
    """A time or number as a double, for bucketing only."""
    kind = df.schema[column].dataType.typeName()
    if kind.startswith("timestamp") or kind == "date":
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    return F.col(column).cast("double")


def latest_before(left: DataFrame, right: DataFrame, key: str, at: str, stamp: str, tie: str, buckets: int = 64) -> DataFrame:
    """As-of join (J-19): per left row the right row of its key with the greatest stamp <= at.

    Both sides are stacked and cut into buckets of time; a window reads each
    (key, bucket) in order, so a key that has a large part of all rows is read
    by as many tasks as it has buckets.  What a bucket inherits is the last
    right row of the buckets before it: one row per (key, bucket).  No pair of
    a key is formed but the one wanted.  ``tie`` tells right rows of one stamp
    apart: the greatest wins.  Null keys and times match nothing.
    """
    kept = [c for c in right.columns if c != key]
    lefts = left.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    rights = right.filter(F.col(key).isNotNull() & F.col(stamp).isNotNull())
    lefts = lefts.select(key, F.col(at).alias("__t"), _number(left, at).alias("__n"), F.lit(1).alias("__side"), F.struct(*(c for c in left.columns if c != key)).alias("__l"))
    rights = rights.select(key, F.col(stamp).alias("__t"), _number(right, stamp).alias("__n"), F.lit(0).alias("__side"), F.struct(*kept).alias("__r"), F.col(tie).alias("__tie"))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    edge = rights.agg(F.min("__n").alias("__low"), F.max("__n").alias("__high"))
    share = (F.col("__n") - F.col("__low")) / F.nullif(F.col("__high") - F.col("__low"), F.lit(0.0))
    bucket = F.least(F.greatest(F.floor(F.coalesce(share, F.lit(0.0)) * buckets), F.lit(0)), F.lit(buckets)).cast("int")
    both = both.crossJoin(F.broadcast(edge)).withColumn("__bucket", bucket).drop("__low", "__high", "__n")
    lasts = both.filter("__side = 0").groupBy(key, "__bucket").agg(F.max_by("__r", F.struct("__t", "__tie")).alias("__r"))
    # A key's buckets are few; what each hands on is known before any row is read.
    handed = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = both.select(key, "__bucket").distinct().join(lasts, [key, "__bucket"], "left").withColumn("__before", F.last("__r", ignorenulls=True).over(handed)).select(key, "__bucket", "__before")
    order = Window.partitionBy(key, "__bucket").orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("__own", F.last("__r", ignorenulls=True).over(order)).filter("__side = 1").join(every, [key, "__bucket"], "left")
    seen = seen.withColumn("__last", F.coalesce("__own", "__before")).filter("__last is not null")
    return seen.select(key, "__l.*", *(F.col("__last")[c].alias(c) for c in kept))


def closure(spark: SparkSession, edges: DataFrame, src: str, dst: str, max_steps: int | None = None) -> DataFrame:
    """Transitive closure (J-15): src, dst, steps (least); ``max_steps`` is for questions about near pairs only.

    Runs until a step finds no new pair, so cycles end by themselves.  Only
    pairs that are new go into the next step; each step is cut to the
    checkpoint folder.
    """
    work = Workspace(spark, "closure")
    base = work.cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src <> dst").distinct(), "edges")
    known = frontier = work.cut(base.withColumn("steps", F.lit(1).cast("long")), "known1")
    for step in count(2):
        if max_steps is not None and step > max_steps:
            break
        hop = frontier.select("src", F.col("dst").alias("via")).join(base.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").filter("src <> dst").distinct()
        frontier = work.cut(hop.join(known, ["src", "dst"], "left_anti").withColumn("steps", F.lit(step).cast("long")), f"new{step}")
        if frontier.isEmpty():
            break
        known = work.cut(known.unionByName(frontier), f"known{step}")
    return known


def mutual_best(scored: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """Pairs that are the best of both sides, ties kept (J-21)."""
    best_a = Window.partitionBy(a).orderBy(F.desc(score))
    best_b = Window.partitionBy(b).orderBy(F.desc(score))
    return scored.withColumn("__ra", F.rank().over(best_a)).filter("__ra = 1").drop("__ra").join(scored.withColumn("__rb", F.rank().over(best_b)).filter("__rb = 1").select(a, b), [a, b])


def _greatest_sums(asking: DataFrame, others: DataFrame, group: str, own: str, other: str, modulus: int) -> DataFrame:
    """group, own, other, score: of each remainder the other one of its group with which the sum modulo ``modulus`` is greatest.

    That is the greatest one that doesn't carry the sum over the modulus, else
    the greatest of all.  A group has at most ``modulus`` remainders.
    """
    asked = asking.select(group, own).dropna().distinct().withColumn("__at", modulus - 1 - F.col(own))
    both = asked.unionByName(others.select(group, other, F.col(other).alias("__at")).dropna().distinct(), allowMissingColumns=True)
    below = Window.partitionBy(group).orderBy("__at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    best = both.withColumn("__o", F.coalesce(F.max(other).over(below), F.max(other).over(Window.partitionBy(group)))).filter(F.col(own).isNotNull() & F.col("__o").isNotNull())
    return best.select(group, own, F.col("__o").alias(other), ((F.col(own) + F.col("__o")) % modulus).alias("__score"))


def mutual_best_sums(left: DataFrame, right: DataFrame, a: str, b: str, group: str, own: str, other: str, modulus: int, score: str) -> DataFrame:
    """Pairs of one group that are the best of both sides, ties kept (J-21), where the score is (own + other) % modulus.

    left: a, group, own; right: b, group, other; own and other are remainders.
    Given one of them, another remainder is another score, so rows of equal
    remainders tie and the best pairs are found among remainders.
    """
    of_a = Window.partitionBy(a).orderBy(F.desc("__score"))
    of_b = Window.partitionBy(b).orderBy(F.desc("__score"))
    best_a = left.join(_greatest_sums(left, right, group, own, other, modulus), [group, own]).withColumn("__r", F.rank().over(of_a)).filter("__r = 1").drop("__r")
    best_b = right.join(_greatest_sums(right, left, group, other, own, modulus), [group, other]).withColumn("__r", F.rank().over(of_b)).filter("__r = 1").drop("__r", "__score")
    return best_a.join(best_b, [group, own, other]).select(a, b, F.col("__score").alias(score))


def hamming_pairs(codes: DataFrame, key: str, code: str, limit: int) -> DataFrame:
    """Pairs a < b of 64-bit codes that differ in at most ``limit`` bits (J-18).

    By pigeonhole, of limit + 1 pieces of the code one is equal in both: an
    equi-join on the pieces finds every pair, the exact distance keeps it.
    """
    pieces = limit + 1
    cuts = [round(k * 64 / pieces) for k in range(pieces + 1)]
    piece = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(code, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1) if hi - lo < 64 else F.lit(-1)).alias("v")) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)))))
    long = codes.select(F.col(key).alias("a"), F.col(code).alias("x"), piece.alias("p"))
    other = long.select(F.col("a").alias("b"), F.col("x").alias("y"), "p")
    distance: Column = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
    return long.join(other, "p").filter("a < b").withColumn("distance", distance).filter(F.col("distance") <= limit).select("a", "b", "distance").distinct()


def fuzzy_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_text: str, right_text: str, block: str, least: float) -> DataFrame:
    """Pairs of one block whose edit-distance ratio reaches ``least`` (J-07); lengths must allow it.

    Distances are taken between distinct texts of a block; the rows that have
    them are told afterwards.
    """
    a = left.select(F.col(left_id).alias("a"), F.col(left_text).alias("x"), block)
    b = right.select(F.col(right_id).alias("b"), F.col(right_text).alias("y"), block)
    xs, ys = (side.select(block, c, F.length(c).alias(n)).dropna().distinct() for side, c, n in ((a, "x", "__m"), (b, "y", "__n")))
    longer = F.greatest("__m", "__n")
    near = F.abs(F.col("__m") - F.col("__n")) <= longer * (1 - least)
    # Beyond the distance that the ratio allows the count stops and is -1.
    distance = F.expr(f"levenshtein(x, y, cast(greatest(__m, __n) * {1 - least} + 1e-9D as int))")
    alike = xs.join(ys, block).filter(near).withColumn("__d", distance).filter("__d >= 0").withColumn("similarity", 1 - F.col("__d") / longer).filter(F.col("similarity") >= least)
    return alike.select(block, "x", "y", "similarity").join(a, [block, "x"]).join(b, [block, "y"]).select("a", "b", "similarity")


def contained_boxes(boxes: DataFrame, key: str, page: str, pieces: int = 16) -> DataFrame:
    """outer_id, inner_id of boxes of a page that contain each other (PF-13). boxes: key, page, x0, y0, x1, y1.

    Equal boxes lie in the same ones, so distinct boxes are compared, each with
    its keys, MEMBERS of them at most in a row.  The outer ones of a page are
    spread over ``pieces``, so a large page is many tasks, and the pairs are
    spelt out where the boxes met, without a shuffle.
    """
    sides = ["x0", "y0", "x1", "y1"]
    known = boxes.dropna(subset=[key, page, *sides])
    sizes = known.groupBy(page, *sides).agg(F.count(F.lit(1)).alias("__n"))
    share = F.pmod(F.xxhash64(key), F.ceil(F.col("__n") / MEMBERS))
    held = known.join(sizes, [page, *sides]).groupBy(page, *sides, share.alias("__share")).agg(F.collect_list(key).alias("__keys"))
    outer = held.select(page, *(F.col(c).alias(f"a{c}") for c in sides), F.col("__keys").alias("__outer"), F.pmod(F.xxhash64(*sides, "__share"), F.lit(pieces)).cast("int").alias("__piece"))
    inner = held.select(page, *(F.col(c).alias(f"b{c}") for c in sides), F.col("__keys").alias("__inner"), F.explode(F.array(*map(F.lit, range(pieces)))).alias("__piece"))
    within = outer.join(inner, [page, "__piece"]).filter("ax0 <= bx0 and ay0 <= by0 and ax1 >= bx1 and ay1 >= by1").select("__outer", "__inner")
    return within.select(F.explode("__outer").alias("outer_id"), "__inner").select("outer_id", F.explode("__inner").alias("inner_id")).filter("outer_id <> inner_id")
