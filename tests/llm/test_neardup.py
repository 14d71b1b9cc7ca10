import random
import re
import tracemalloc

import numpy as np
import pandas as pd

import pytest

from brinework.llm import neardup as N


def sets_of(texts, k, least):
    out = {}
    for i, t in texts:
        w = re.findall(r"[^\W_]+", (t or "").lower().replace("ё", "е"))
        if len(w) >= max(k, least):
            out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    return out


def brute(texts, k, threshold, least):
    s = sorted(sets_of(texts, k, least).items())
    return {(a, b) for n, (a, x) in enumerate(s) for b, y in s[n + 1 :] if len(x & y) >= threshold * len(x | y) - 1e-12}


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["ёлка", "Ель"]
    base = [[rng.choice(words) for _ in range(rng.randint(20, 90))] for _ in range(n // 4)]
    texts = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append((f"p{i:03}", " ".join(w)))
    return texts + [("a0", texts[0][1]), ("a1", texts[0][1].upper()), ("n", None), ("e", ""), ("s", "одно слово")]


@pytest.mark.parametrize(("k", "threshold", "least"), [(3, 0.4, 30), (5, 0.8, 0), (2, 0.6, 0)])
def test_against_brute_force(spark, k, threshold, least, monkeypatch):
    texts = corpus(k)
    df = spark.createDataFrame(texts, "id string, text string").selectExpr("*", "1 AS n", "'x' AS part", "0 AS shingles")
    found = N.near_duplicates(spark, df, k, threshold, least)
    want = brute(texts, k, threshold, least)
    pairs = {tuple(r) for r in N.expanded(found).collect()}
    assert pairs == want
    links = {r["id"]: r["links"] for r in N.per_text(found).collect()}
    assert links == {i: n for i in {x for p in want for x in p} if (n := sum(i in p for p in want))}


def test_hot_lists_are_cut_into_cells(spark, monkeypatch):
    """Every text has the same frequent shingles: lists longer than a cell are compared block by block."""
    monkeypatch.setattr(N, "CHUNK", 16)
    rng = random.Random(9)
    common = [f"c{i}" for i in range(60)]
    texts = [(f"p{i:03}", " ".join([*common, *(f"x{rng.randrange(10**6)}" for _ in range(rng.randint(5, 60)))])) for i in range(100)]
    df = spark.createDataFrame(texts, "id string, text string")
    found = N.near_duplicates(spark, df, 3, 0.4)
    assert {tuple(r) for r in N.expanded(found).collect()} == brute(texts, 3, 0.4, 0)


def test_copies_stay_one_class(spark):
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.range(3000).selectExpr("concat('p', lpad(id, 4, '0')) AS id", f"'{text}' AS text")
    found = N.near_duplicates(spark, df)
    assert found.pairs.count() == 0 and found.classes.count() == 1
    out = N.per_text(found)
    assert out.count() == 3000 and out.select("class_id", "links").distinct().collect()[0] == ("p0000", 2999)


def test_long_text(spark):
    long = " ".join(f"w{i}" for i in range(60000))
    df = spark.createDataFrame([("a", long), ("b", long + " end"), ("c", "x")], "id string, text string")
    assert {tuple(r) for r in N.expanded(N.near_duplicates(spark, df)).collect()} == {("a", "b")}


def group_of(n, sides, full=0.2):
    """One list with a shingle that all texts have, as a task gets it."""
    rng = np.random.default_rng(4)
    maps = np.packbits(rng.random((n, N.BITS)) < full, axis=1)
    ids = np.array([f"p{i:05}" for i in range(n)], dtype=object)
    entry = (0, ids, np.full(n, 100), maps.tobytes(), np.arange(n), np.full(n, 7), np.zeros(n, dtype=int), sides)
    return pd.DataFrame([entry], columns=["part", "ids", "n", "bitmaps", "docs", "keys", "places", "sides"])


def test_a_list_of_8192_members_in_bounded_memory():
    tracemalloc.start()
    try:
        for sides in (np.zeros(8192, dtype=int), np.arange(8192) % 2 + 1):
            tracemalloc.reset_peak()
            N._candidates(0.8)(group_of(8192, sides))
            assert tracemalloc.get_traced_memory()[1] < 400_000_000
    finally:
        tracemalloc.stop()


def test_blocks_of_pairs_are_whole():
    low, high = np.array([0, 0, 0, 3, 1]), np.array([0, 1, 2, 3, 4])
    for most in (1, 2, 3, 100):
        got = [(int(a), int(b)) for x, y in N._in_blocks(low, high, most) for a, b in zip(x, y, strict=True)]
        assert sorted(got) == [(0, 1), (0, 2), (1, 2), (1, 4), (2, 4), (3, 4)]


def test_sides_meet_only_each_other():
    n = 60
    out = N._candidates(0.1)(group_of(n, np.arange(n) % 2 + 1, 0))
    assert len(out) == 900 and all((int(a[1:]) + int(b[1:])) % 2 for a, b in zip(out["a"], out["b"], strict=True))
    assert len(N._candidates(0.1)(group_of(n, np.zeros(n, dtype=int), 0))) == n * (n - 1) // 2


def looked_at(monkeypatch, group, threshold):
    """Pairs that a group's lists look at, and those they find."""
    blocks, seen = N._in_blocks, []
    monkeypatch.setattr(N, "_in_blocks", lambda low, high: (seen.append(np.maximum(high - low, 0).sum()), blocks(low, high))[1])
    out = N._candidates(threshold)(group)
    monkeypatch.setattr(N, "_in_blocks", blocks)
    return sum(seen), out


def test_members_too_late_in_their_texts_do_not_meet(monkeypatch):
    """Of 100 shingles two texts must share 58; from place 60 on 40 are left, from place 42 on just enough."""
    for place, pairs in ((60, 0), (43, 0), (42, 780)):
        group = group_of(40, np.zeros(40, dtype=int), 0)
        group.at[0, "places"] = np.full(40, place)
        seen, out = looked_at(monkeypatch, group, 0.4)
        assert (seen, len(out)) == (pairs, pairs)


def phrases(n, words=8, of=40):
    """Sets of numbers: shingles of phrases that many texts have, and of their borders; each tenth text is a near copy of the one before."""
    rng = random.Random(n)
    sets = []
    for i in range(n):
        if i % 10 == 9:
            sets.append({x if rng.random() < 0.8 else -rng.randrange(10**12) for x in sets[-1]})
            continue
        said = [rng.randrange(of) for _ in range(words)]
        sets.append({p * 10 + j for p in said for j in range(4)} | {10**6 + (a * of + b) * 10 + j for a, b in zip(said, said[1:]) for j in range(2)} | {10**9 + i})
    return [sorted(x * 0x9E3779B97F4A7C15 % 2**63 for x in s) for s in sets]


def listed(sets, threshold, rare):
    s, n = np.concatenate([np.array(x, dtype=np.int64) for x in sets]), np.array([len(x) for x in sets])
    value, count = np.unique(s, return_counts=True)
    doc, key, place = N._marks(s, n, value[count > rare], count[count > rare], threshold)
    bits = np.zeros((len(n), N.BITS), dtype=bool)
    bits[np.repeat(np.arange(len(n)), n), s & (N.BITS - 1)] = True
    entry = (0, np.arange(len(n)), n, np.packbits(bits, axis=1).tobytes(), doc, key, place, np.zeros(len(key), dtype=int))
    return pd.DataFrame([entry], columns=["part", "ids", "n", "bitmaps", "docs", "keys", "places", "sides"])


@pytest.mark.parametrize("groups", [1, 2, 5, 16])
@pytest.mark.parametrize(("threshold", "words"), [(0.4, 8), (0.3, 2), (0.7, 5), (0.4, 60)])
def test_no_pair_is_lost_in_lists_of_two(monkeypatch, groups, threshold, words):
    monkeypatch.setattr(N, "GROUPS", groups)
    sets = phrases(300, words)
    want = {(a, b) for b, y in enumerate(map(set, sets)) for a, x in enumerate(map(set, sets[:b])) if len(x & y) >= threshold * len(x | y) - 1e-12}
    for rare in (0, 2, 10):
        out = N._candidates(threshold)(listed(sets, threshold, rare))
        assert want <= {(min(p), max(p)) for p in zip(out["a"], out["b"], strict=True)} and want


def test_texts_of_few_phrases_meet_seldom(monkeypatch):
    """Lists of all first shingles, without regard to places, would look at five times as many pairs or more."""
    n = 3000
    sets = phrases(n, 24, 120)
    value, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    sizes = np.array([len(x) for x in sets])
    doc = np.repeat(np.arange(n), sizes)
    order = np.lexsort((at, count[at], doc))
    place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    members = np.bincount(at[order][place < (sizes - N.rest_of(sizes, 0.4))[doc]])
    seen, out = looked_at(monkeypatch, listed(sets, 0.4, 20), 0.4)
    assert n // 10 * 0.9 < len(out) and seen < (members * (members - 1) // 2).sum() / 5


def test_frequent_shingles_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "RARE", 2)
    texts = corpus(11, 160)
    df = spark.createDataFrame(texts, "id string, text string")
    for most in (4096, 8):
        monkeypatch.setattr(N, "CHUNK", most)
        assert {tuple(r) for r in N.expanded(N.near_duplicates(spark, df, 3, 0.4, 30)).collect()} == brute(texts, 3, 0.4, 30)


def test_lengths_of_lists_come_from_a_sample(spark, monkeypatch):
    """A sample of the texts tells which lists are long, and the pairs stay whole."""
    monkeypatch.setattr(N, "SAMPLE", 60)
    monkeypatch.setattr(N, "CHUNK", 16)
    monkeypatch.setattr(N, "RARE", 8)
    rng = random.Random(3)
    common = [f"c{i}" for i in range(60)]
    texts = [(f"p{i:03}", " ".join([*common, *(f"x{rng.randrange(10**6)}" for _ in range(rng.randint(5, 60)))])) for i in range(120)]
    df = spark.createDataFrame(texts, "id string, text string")
    assert {tuple(r) for r in N.expanded(N.near_duplicates(spark, df, 3, 0.4)).collect()} == brute(texts, 3, 0.4, 0)
