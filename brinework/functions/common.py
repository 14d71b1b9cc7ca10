"""Small column functions that several plans share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round6(x: Column) -> Column:
    """floor(x * 1e6 + 0.5) / 1e6: the same rounding in every engine (A-22)."""
    return F.floor(x * 1e6 + 0.5) / F.lit(1e6)


def dyadic(x: Column, bits: int = 24) -> Column:
    """x on a grid of 2^-bits, as a long: sums of it don't depend on the order (A-23)."""
    return F.round(x * float(1 << bits)).cast("long")


def from_dyadic(x: Column, bits: int = 24) -> Column:
    return x / F.lit(float(1 << bits))


def text_list(a: Column) -> Column:
    """An array as one text."""
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
