"""Row and table fingerprints that don't depend on order or partitioning (A-17)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 8


def row_text(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Canonical text of a row: columns by name, null told apart from text."""
    names = sorted(columns or df.columns)
    return F.concat_ws("|", *(F.concat(F.lit(f"{c}="), F.coalesce(F.concat(F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("null"))) for c in names))


def lanes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """n, lane0 .. lane7: sums of the 32-bit parts of every row's sha-256; additive over parts of a table."""
    h = F.sha2(row_text(df, columns), 256)
    part = [F.sum(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("long")).alias(f"lane{k}") for k in range(LANES)]
    return df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n"), *part)


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> str:
    """A table's fingerprint: schema, number of rows and the sum of row hashes modulo 2^256."""
    r = lanes(df, columns).first()
    total = sum(int(r[f"lane{k}"] or 0) << (32 * (LANES - 1 - k)) for k in range(LANES)) % (1 << 256)
    names = ",".join(f"{n}:{t}" for n, t in sorted(df.dtypes) if not columns or n in columns)
    return hashlib.sha256(f"{names}|{r['n']}|{total:064x}".encode()).hexdigest()
