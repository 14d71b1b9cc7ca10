"""Typed filters, pages bound to their query, and named SELECTs over bound views (PF- and UD-families)."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("terms", "not_terms", "range", "bool", "overlaps", "available")


def compiled(schema: dict[str, str], filters: dict[str, Any]) -> Column:
    """A condition from typed filters (PF-07); ``schema`` names the kind of each filter.

    terms: one of a list; not_terms: none of it, nulls stay; range: [low, high],
    either may be None; bool; overlaps: the array has one of a list; available:
    {"at": time, "unknown": "INCLUDE" or "EXCLUDE"}.  A filter that the schema
    doesn't name, or of another shape than its kind, is an error: a misspelt
    filter must not widen a result silently.
    """
    out = F.lit(True)
    for name, value in filters.items():
        kind = schema.get(name)
        c = F.col(name)
        if kind not in KINDS:
            raise ValueError(f"unknown filter: {name}")
        if kind in ("terms", "not_terms", "overlaps") and (isinstance(value, str) or not hasattr(value, "__iter__")):
            raise ValueError(f"{name}: a list is wanted")
        if kind == "terms":
            out &= c.isin(list(value))
        elif kind == "not_terms":
            out &= c.isNull() | ~c.isin(list(value))
        elif kind == "overlaps":
            out &= F.arrays_overlap(c, F.array(*map(F.lit, value)))
        elif kind == "range":
            low, high = value
            out &= F.lit(True) if low is None else c >= F.lit(low)
            out &= F.lit(True) if high is None else c <= F.lit(high)
        elif kind == "bool":
            if not isinstance(value, bool):
                raise ValueError(f"{name}: true or false is wanted")
            out &= c == F.lit(value)
        else:
            known = c <= F.lit(value["at"])
            out &= F.coalesce(known, F.lit({"INCLUDE": True, "EXCLUDE": False}[value["unknown"]]))
    return out


def query_mark(query: dict) -> str:
    return hashlib.sha256(json.dumps(query, sort_keys=True, default=str).encode()).hexdigest()[:16]


def page(df: DataFrame, key: str, size: int, query: dict, cursor: str | None = None) -> tuple[DataFrame, str | None]:
    """One page by key and the cursor of the next (PF-16, T-03).

    The cursor carries the mark of the query it belongs to; with another query
    it is refused.  Rows are cut behind the last key, so a page costs no more
    than its size, however far it is.  The last page has no cursor.
    """
    mark = query_mark(query)
    rows = df
    if cursor is not None:
        own, _, after = cursor.partition(":")
        if own != mark:
            raise ValueError("the cursor belongs to another query")
        rows = rows.filter(F.col(key) > F.lit(json.loads(after)))
    found = rows.orderBy(key).limit(size + 1)
    keys = [r[0] for r in found.select(key).collect()]
    following = f"{mark}:{json.dumps(keys[size - 1], default=str)}" if len(keys) > size else None
    return found.orderBy(key).limit(size), following


def named_select(spark: SparkSession, views: dict[str, DataFrame], sql: str, most: int) -> DataFrame:
    """A single SELECT over bound views only (UD-04): anything else is refused; ``most`` + 1 rows tell whether there are more.

    The parsed plan says what is read: tables that aren't bound, commands,
    several statements and path reads don't pass.
    """
    if ";" in sql.rstrip().rstrip(";"):
        raise ValueError("one statement is wanted")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.rstrip().rstrip(";"))
    text = plan.toString()
    unbound = [line.split("[", 1)[1].split("]")[0].replace(", ", ".") for line in text.splitlines() if "UnresolvedRelation [" in line]
    defined = {line.split("[", 1)[1].split("]")[0] for line in text.splitlines() if "CTE [" in line}
    names = {n for d in defined for n in d.split(", ")}
    if bad := [n for n in unbound if n not in views and n not in names]:
        raise ValueError(f"not bound: {sorted(set(bad))}")
    if plan.getClass().getSimpleName() not in ("Project", "Aggregate", "Distinct", "Sort", "GlobalLimit", "Union", "UnresolvedWith", "WithCTE", "UnresolvedHaving", "Filter"):
        raise ValueError("a SELECT is wanted")
    prefix = f"bound_{query_mark({'sql': sql})}_"
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    aliases = ", ".join(f"{name} AS (SELECT * FROM {prefix}{name})" for name in views)
    body = sql.rstrip().rstrip(";")
    return spark.sql(f"WITH {aliases} SELECT * FROM ({body}) AS asked").limit(most + 1)
