"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of the broadcast side: keys above n / HOT_KEYS rows can be at most HOT_KEYS many.
HOT_KEYS = 1000


def hot_split_join(big: DataFrame, lookup: DataFrame, key: str, value: str, weight: str, total: int) -> DataFrame:
    """``big`` left-joined to ``lookup`` (unique ``key``) for ``value``; rows of ``big`` should differ.

    ``weight`` is a column of ``lookup``: how many rows of ``big`` have the key.
    Keys with more than ``total / HOT_KEYS`` rows can't number more than
    HOT_KEYS, so their number of pieces is broadcast; their rows are spread
    over the pieces by hash and meet a copy of the lookup row in each.  One
    scan and one shuffle of ``big``, whatever its keys.
    """
    least = max(1000, total // HOT_KEYS)
    pieces = F.greatest(F.ceil(F.col(weight) / least), F.lit(1)).cast("int")
    hot = lookup.filter(F.col(weight) > least).select(key, pieces.alias("__pieces"))
    tagged = big.join(F.broadcast(hot), key, "left").withColumn("__piece", F.pmod(F.xxhash64(*big.columns), F.coalesce("__pieces", F.lit(1)).cast("long")).cast("int")).drop("__pieces")
    spread = lookup.select(key, value, F.explode(F.sequence(F.lit(0), pieces - 1)).alias("__piece"))
    return tagged.join(spread, [key, "__piece"], "left").drop("__piece")
