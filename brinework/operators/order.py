"""Row numbers over very many rows without sorting them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def row_numbers(df: DataFrame, key: str, name: str, by: str | None = None, buckets: int = 256) -> DataFrame:
    """``df`` with the place of each row, from 1, in order of a unique numeric key, within ``by`` if given (W-04, W-06, SC-25).

    Rows are cut into buckets of the key's range; each is numbered by itself
    and begins where the rows of the buckets before it end.  Only counts per
    bucket are summed in one place.  Null keys have no number and are left out.
    """
    group = [by] if by else []
    rows = df.filter(F.col(key).isNotNull())
    edge = rows.agg(F.min(key).alias("__low"), F.max(key).alias("__high"))
    share = (F.col(key) - F.col("__low")).cast("double") / F.nullif((F.col("__high") - F.col("__low")).cast("double"), F.lit(0.0))
    placed = rows.crossJoin(F.broadcast(edge)).withColumn("__bucket", F.floor(F.coalesce(share, F.lit(0.0)) * buckets).cast("int")).drop("__low", "__high")
    counts = placed.groupBy(*group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    begun = counts.select(*(F.col(c).alias("__by") for c in group), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    same = F.col("__bucket") == F.col("__b")
    if by:
        same = same & F.col(by).eqNullSafe(F.col("__by"))
    inside = F.row_number().over(Window.partitionBy(*group, "__bucket").orderBy(key))
    return placed.withColumn("__inside", inside).join(begun, same).withColumn(name, F.col("__before") + F.col("__inside")).drop("__bucket", "__b", "__by", "__before", "__inside")
