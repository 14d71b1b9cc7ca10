"""Sequence rules that no built-in function expresses: alignment, ordered subsequences, greedy matching."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def longest_ordered(values: list[int]) -> list[int]:
    """W-11: places of a longest non-decreasing subsequence; of several, one that ends in the least value, then at the latest place.

    A tree of prefix maxima over the ranks of the values holds, for every
    value, the longest run ending in it or in a lesser one: n log n, whatever
    the order.
    """
    rank = {v: r for r, v in enumerate(sorted(set(values)), 1)}
    tree: list[tuple[int, int]] = [(0, -1)] * (len(rank) + 1)
    lengths, links = [], []
    for place, v in enumerate(values):
        longest, link = 0, -1
        r = rank[v]
        while r:
            if tree[r][0] > longest:
                longest, link = tree[r]
            r &= r - 1
        lengths.append(longest + 1)
        links.append(link)
        r = rank[v]
        while r < len(tree):
            if tree[r][0] <= longest:
                tree[r] = (longest + 1, place)
            r += r & -r
    if not values:
        return []
    at = min(range(len(values)), key=lambda i: (-lengths[i], values[i], -i))
    out = [at]
    while (at := links[at]) >= 0:
        out.append(at)
    return out[::-1]


def best_substring(pattern: str, text: str) -> tuple[int, int]:
    """J-23: (least edit distance of the pattern to any substring, where such a substring ends; the first one).

    Myers' bit vectors (1999): the column of differences is two integers, one
    character of the text costs a few operations on them.  A literal hit is
    settled without them.
    """
    m = len(pattern)
    if not m:
        return 0, 0
    if (hit := text.find(pattern)) >= 0:
        return 0, hit + m
    equal: dict[str, int] = {}
    for i, c in enumerate(pattern):
        equal[c] = equal.get(c, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, ends = m, 0
    for at, c in enumerate(text, 1):
        eq = equal.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if up & last:
            score += 1
        elif down & last:
            score -= 1
        # Row 0 is all zeros: a substring may begin anywhere.
        up, down = up << 1, down << 1
        eq |= minus
        plus = (down | ~(eq | up)) & full
        minus = up & eq & full
        if score < best:
            best, ends = score, at
    return best, ends


def greedy_pairs(scores: list[tuple[float, str, str]]) -> list[tuple[str, str, float]]:
    """J-22: pairs taken by score, then names, each side once."""
    left, right, out = set(), set(), []
    for score, a, b in sorted(scores, key=lambda s: (-s[0], s[1], s[2])):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            out.append((a, b, score))
    return out


def _distances(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for patterns, texts in batches:
        yield pd.DataFrame([best_substring(p or "", t or "") for p, t in zip(patterns, texts, strict=True)], columns=["distance", "ends"])


def alignment(pattern: Column, text: Column) -> Column:
    """struct(distance, ends) of a pattern's best place in a text; null counts as empty."""
    return F.pandas_udf(_distances, "distance int, ends int")(pattern, text)


def _ordered(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for lists in batches:
        yield lists.map(lambda v: 0 if v is None else len(longest_ordered([x for x in v if x is not None])))


def ordered_length(values: Column) -> Column:
    """Length of a longest non-decreasing subsequence of an array, nulls in it left out; 0 for a null array."""
    return F.pandas_udf(_ordered, "int")(values)


def _matched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for lists in batches:
        yield lists.map(lambda v: [] if v is None else [{"score": s, "a": a, "b": b} for a, b, s in greedy_pairs([(x["score"], x["a"], x["b"]) for x in v])])


def greedy_matching(candidates: Column) -> Column:
    """J-22 over an array<struct<score double, a string, b string>>: the pairs kept, the best first."""
    return F.pandas_udf(_matched, "array<struct<score:double,a:string,b:string>>")(candidates)
