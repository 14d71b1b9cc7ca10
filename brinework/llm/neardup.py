"""Problem 4: near-duplicate records, found by T-occurrence search.

Two texts are alike when the Jaccard similarity of their sets of word shingles
reaches a threshold.  That asks for a number T of common shingles, so a text's
partners are those that occur at least T times in the inverted lists of its
shingles.  DivideSkip merges only the short lists, of rare shingles, and looks
the candidates up in the long ones.  Here, distributed:

1. Texts of one set collapse to one representative.
2. Shingles are ordered rare first.  Frequent shingles (in more than RARE and more
   than 1 / HEAVY of the texts) are counted exactly and broadcast - there can't be
   more than HEAVY times the average set size - all others count as equally rare.
3. T - 1 lists of each text may be long; the others, its short lists, are routed
   by shingle.  The first common shingle of two texts leaves T in both, so list
   members meet only if what follows their places is enough for both sizes.
   Frequent shingles are dealt into G groups: of any G + 1 common ones two are of
   one group.  So a list is of a rare shingle, or of two frequent ones of a group,
   the later of which leaves T - G.  Texts that need few common shingles are in
   the lists of single frequent ones, long texts have more groups.
   A list longer than CHUNK, by a sample of the texts, is cut into cells of block
   against block, so that no task meets a whole hot list.
4. In a task, list members are paired, a bounded number at a time, only if
   sizes, places and a bitmap of 1024 bits still allow T common shingles - the
   bitmap bounds the overlap from above, so nothing is lost.
5. Candidates are probed in the long lists: binary search of one set in the
   other gives the exact overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoint import Workspace
from ..operators.skew import hot_split_join
from ..tables import current

#: A shingle is frequent if more than RARE texts and more than one in HEAVY have it.
HEAVY = 8000
RARE = 64
#: Groups of frequent shingles: lists are of two of one group.
GROUPS = 16
#: Texts from which the lengths of the lists are estimated.
SAMPLE = 20_000
#: Most members of a list, or of a block of one, that a cell compares.
CHUNK = 4096
#: Entries routed to one group of lists, on average.
PART = 1_000_000
BITS = 1024
#: Most pairs of list members looked at at once: what is kept of them fits a core's cache.
PAIRS = 20_000


def word_list(text: Column) -> Column:
    """Longest runs of letters and digits, in lower case, with ё as е."""
    return F.array_remove(F.split(F.replace(F.lower(text), F.lit("ё"), F.lit("е")), r"[^\p{L}\p{N}]+"), "")


def shingle_sets(texts: DataFrame, words: int, least_words: int) -> DataFrame:
    """id, shingles (sorted array of hashes) of texts with enough words. texts: id, text."""
    listed = texts.select("id", word_list(F.col("text")).alias("w")).filter(F.size("w") >= max(words, least_words))
    # Safe for shorter texts too: the optimizer may test shingles before it tests the number of words.
    at = F.sequence(F.lit(0), F.greatest(F.size("w") - words, F.lit(0)))
    return listed.select("id", F.sort_array(F.array_distinct(F.transform(at, lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(words)))))).alias("shingles"))


def least_common(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """T: common shingles that sets of sizes a and b need."""
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


def _mixed(*parts: np.ndarray) -> np.ndarray:
    """31-bit keys of rows of numbers. Where two rows have one key, their texts meet in vain, no more."""
    h = np.uint64(0x9E3779B97F4A7C15)
    for p in parts:
        h = (h ^ np.asarray(p).astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(33)).astype(np.int64)


def _marks(s: np.ndarray, n: np.ndarray, frequent: np.ndarray, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, key, place of all lists of texts that have n shingles each, of s, one text after the other.

    A list is of a rare shingle or of two frequent ones of a group.  Before the later of two as many
    common shingles may stand as there are groups, so it counts as so many places earlier.
    """
    doc = np.repeat(np.arange(len(n)), n)
    count = np.zeros(len(s), dtype=np.int64)
    if len(frequent):
        spot = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        count = np.where(frequent[spot] == s, counts[spot], 0)
    order = np.lexsort((s, count, doc))
    s, count = s[order], count[order]
    place = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)
    rest = rest_of(n, threshold)
    single = np.flatnonzero((place < (n - rest)[doc]) & ((count == 0) | (rest < GROUPS)[doc]))
    marks = [(doc[single], _mixed(s[single]), place[single])]
    # Two texts meet in the groups for the number of shingles they must share, rest + 1 to n: up to GROUPS in lists of single ones.
    groups, above, upto = GROUPS, GROUPS, GROUPS * 16
    while len(n) and above < n.max():
        here = (n > above) & (rest < upto)
        paired = np.flatnonzero(here[doc] & (place < (n - rest + groups)[doc]) & (count > 0))
        run = doc[paired] * groups + _mixed(s[paired]) % groups
        order = np.argsort(run, kind="stable")
        paired, run = paired[order], run[order]
        start = np.searchsorted(run, run)
        before = np.arange(len(run)) - start
        later = np.repeat(np.arange(len(run)), before)
        earlier = start[later] + np.arange(len(later)) - np.repeat(np.cumsum(before) - before, before)
        one, two = paired[earlier], paired[later]
        marks.append((doc[two], _mixed(s[one], s[two], groups), place[two] - groups))
        groups, above, upto = groups * 4, upto, upto * 4
    return tuple(np.concatenate(m) for m in zip(*marks, strict=True))


#: Rows of routed texts: those of one batch that go to one part, side by side.
_ROUTED = "part int, ids array<long>, n array<int>, bitmaps binary, docs array<int>, keys array<int>, places array<int>, sides array<byte>"


def _sets_of(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a batch, one text after the other, and how many each text has."""
    return np.concatenate(batch["shingles"].to_list()).astype(np.int64), batch["shingles"].map(len).to_numpy(dtype=np.int64)


def _lengths(sets: DataFrame, n_sets: int, heavy, threshold: float) -> tuple[int, np.ndarray, np.ndarray]:
    """Entries of all lists, the keys of lists of over CHUNK members, and their members; from SAMPLE of the texts, if there are more."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"key": _marks(*_sets_of(batch), *heavy.value, threshold)[1]})

    share = min(1.0, SAMPLE / max(n_sets, 1))
    seen = sets if share == 1 else sets.filter(F.pmod(F.xxhash64(F.lit("lengths"), "class_id"), F.lit(1 << 31)) < int(share * (1 << 31)))
    counts = seen.select("shingles").mapInPandas(keys, "key int").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # Less than 20 of a sample say little.
    long = F.when(F.col("n") > (CHUNK if share == 1 else max(20, CHUNK * share)), F.col("key"))
    lengths = counts.groupBy(long.alias("key")).agg(F.sum("n").alias("n")).toPandas()
    hot = lengths[lengths["key"].notna()].sort_values("key")
    return int(lengths["n"].sum() / share), hot["key"].to_numpy(dtype=np.int64), np.ceil(hot["n"].to_numpy(dtype=np.float64) / share).astype(np.int64)


def _short_lists(sets: DataFrame, heavy, hot, threshold: float, parts: int) -> DataFrame:
    """Per batch of texts and part: the texts with their sizes and bitmaps, and of each entry the text's number, the list's key, place (in rare-first order) and side."""

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot_keys, members = hot.value
        for batch in batches:
            if not len(batch):
                continue
            ids = batch["id"].to_numpy()
            s, n = _sets_of(batch)
            bits = np.zeros((len(ids), BITS), dtype=bool)
            bits[np.repeat(np.arange(len(ids)), n), s & (BITS - 1)] = True
            maps = np.packbits(bits, axis=1)
            doc, key, place = _marks(s, n, *heavy.value, threshold)
            side = np.zeros(len(key), dtype=np.int64)
            if len(hot_keys):
                spot = np.minimum(np.searchsorted(hot_keys, key), len(hot_keys) - 1)
                long = hot_keys[spot] == key
                blocks = -(-members[spot[long]] // CHUNK)
                mine = np.repeat(_mixed(ids[doc[long]]) % blocks, blocks)
                other = np.arange(len(mine)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                cells = _mixed(np.repeat(key[long], blocks), np.minimum(mine, other), np.maximum(mine, other))
                doc, place = (np.concatenate([c[~long], np.repeat(c[long], blocks)]) for c in (doc, place))
                key, side = np.concatenate([key[~long], cells]), np.concatenate([side[~long], np.where(mine == other, 0, np.where(mine < other, 1, 2))])
            part = key % parts
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            rows = []
            for at in np.split(order, cuts):
                own, number = np.unique(doc[at], return_inverse=True)
                rows.append((int(part[at[0]]), ids[own], n[own], _packed(maps[own].tobytes()), number, key[at], place[at], side[at]))
            yield pd.DataFrame(rows, columns=["part", "ids", "n", "bitmaps", "docs", "keys", "places", "sides"])

    return sets.mapInPandas(route, _ROUTED)


def _packed(maps: bytes) -> bytes:
    """Compressed, unless that makes them no smaller."""
    small = pa.compress(maps, codec="zstd", asbytes=True)
    return small if len(small) < len(maps) else maps


def _unpacked(maps: bytes, texts: int) -> bytes:
    size = int(texts) * BITS // 8
    return maps if len(maps) == size else pa.decompress(maps, decompressed_size=size, codec="zstd", asbytes=True)


def rest_of(n: np.ndarray, threshold: float) -> np.ndarray:
    """Long lists of a text of n shingles: one less than any partner shares with it."""
    return np.ceil(threshold * n - 1e-9).astype(np.int64) - 1


def _in_blocks(low: np.ndarray, high: np.ndarray, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (x, y) of every place y with the places low[y] <= x < high[y], about ``most`` at once."""
    searching = np.flatnonzero(high > low)
    counts = (high - low)[searching]
    ends = np.cumsum(counts)
    at = 0
    while at < len(searching):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        c = counts[at:to]
        y = np.repeat(searching[at:to], c)
        x = low[y] + np.arange(len(y)) - np.repeat(ends[at:to] - c - done, c)
        yield x, y
        at = to


def _apart(maps: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which the bitmaps of x and y differ: the words' counts, a byte each, are added eight at a time."""
    eight = np.bitwise_count(np.take(maps, x, axis=0) ^ np.take(maps, y, axis=0)).view(np.uint64)
    lanes = np.uint64(0x00FF00FF00FF00FF)
    pairs = (eight & lanes) + ((eight >> np.uint64(8)) & lanes)
    sums = (pairs * np.uint64(0x0001000100010001)) >> np.uint64(48)
    return sum(sums[:, i] for i in range(sums.shape[1])).astype(np.int64)


def _candidates(threshold: float):
    share = threshold / (1 + threshold)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        ids = np.concatenate(group["ids"].to_list())
        n = np.concatenate(group["n"].to_list()).astype(np.int64)
        texts = group["ids"].map(len).to_numpy()
        maps = np.frombuffer(b"".join(map(_unpacked, group["bitmaps"], texts)), dtype=np.uint64).reshape(len(ids), -1)
        entries = group["keys"].map(len).to_numpy()
        doc = np.concatenate(group["docs"].to_list()) + np.repeat(np.cumsum(texts) - texts, entries)
        key, place, side = (np.concatenate(group[c].to_list()).astype(np.int64) for c in ("keys", "places", "sides"))
        # Members of a list in order of size, then id: the later one is the text that searches.
        by_size = np.lexsort((ids, n))
        ids, n, maps = ids[by_size], n[by_size], maps[by_size]
        rank = np.empty(len(ids), dtype=np.int64)
        rank[by_size] = np.arange(len(ids))
        doc = rank[doc]
        # The largest partner that leaves enough shingles from this place on.
        most = np.floor((n[doc] - place) / share - n[doc] + 1e-6).astype(np.int64)
        order = np.lexsort((doc, side, key))
        doc, key, side, most = doc[order], key[order], side[order], most[order]
        run = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (side[1:] != side[:-1])]) - 1
        first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        # A run searches in itself; one side of a cell in the other side only.
        partner = np.arange(len(first))
        both = np.flatnonzero((key[first][1:] == key[first][:-1]) & (side[first][1:] == 2) & (side[first][:-1] == 1))
        partner[side[first] > 0] = -1
        partner[both], partner[both + 1] = both + 1, both
        # Found are texts that may have a partner of their size; any may search.
        listed = np.flatnonzero(most >= n[doc])
        beyond = len(ids) + 1
        spot = run[listed] * beyond + doc[listed]
        of = partner[run]
        # Partners of a text have threshold times its size at least: a lower bound of their rank.
        least = np.searchsorted(n, np.ceil(threshold * n - 1e-9))
        low = np.searchsorted(spot, of * beyond + least[doc])
        high = np.searchsorted(spot, of * beyond + np.minimum(doc, np.searchsorted(n, most, "right")))
        low, high = np.where(of < 0, 0, low), np.where(of < 0, 0, high)
        found = [np.zeros(0, dtype=np.int64)]
        at, reach = doc[listed], most[listed]
        needed = least_common(np.arange(2 * n[-1] + 1), 0, threshold)
        for x, y in _in_blocks(low, high):
            y = doc[y]
            keep = reach[x] >= n[y]
            x, y = at[x[keep]], y[keep]
            both_sizes = n[x] + n[y]
            keep = (both_sizes - _apart(maps, x, y)) // 2 >= needed[both_sizes]
            found.append(y[keep] * beyond + x[keep])
        pairs = np.unique(np.concatenate(found))
        return pd.DataFrame({"a": ids[pairs // beyond], "b": ids[pairs % beyond]})

    return compare


def _probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Binary probes of one set in the other."""
    for batch in batches:
        common = []
        for s, t in zip(batch["sa"], batch["sb"], strict=True):
            at = np.minimum(np.searchsorted(t, s), len(t) - 1)
            common.append(int((np.asarray(t)[at] == s).sum()))
        yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "na": batch["sa"].map(len), "nb": batch["sb"].map(len), "common": common})


class NearDuplicates:
    """Representatives' pairs and the membership of the texts they stand for."""

    def __init__(self, pairs: DataFrame, members: DataFrame, classes: DataFrame):
        #: a, b (a < b), jaccard: representatives that are alike.
        self.pairs = pairs
        #: id, class_id of every text that shares its set with others; class_id is their least id.
        self.members = members
        #: class_id, size of every set.
        self.classes = classes


def near_duplicates(spark: SparkSession, texts: DataFrame, words: int = 5, threshold: float = 0.8, least_words: int = 0) -> NearDuplicates:
    """Pairs of texts whose shingle sets have at least the given Jaccard similarity.

    texts: id (string, unique), text; other columns are ignored.  Null and
    empty texts, and those of fewer than ``words`` or ``least_words`` words,
    have no pairs.  Equal sets have similarity 1.  No partner or candidate is
    capped; the result doesn't depend on the partitioning.
    """
    work = Workspace(spark, "neardup")
    sets = shingle_sets(texts.select(F.col("id").cast("string").alias("id"), "text").filter("id is not null and text is not null"), words, least_words)
    sets = work.cut(sets.withColumn("k1", F.xxhash64("shingles")).withColumn("k2", F.xxhash64(F.lit(7), "shingles")), "sets")
    key = F.struct("k1", "k2").alias("k")
    classes = sets.groupBy("k1", "k2").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("size"))
    several = work.cut(classes.filter("size > 1").select(key, "class_id", "size"), "several")
    n_texts = sets.count()
    members = work.cut(hot_split_join(sets.select("id", key), several, "k", "class_id", "size", n_texts).filter("class_id is not null").select("id", "class_id"), "members")
    # Of the sets themselves only the copies' ids are told; Spark broadcasts them while they are few.
    reps = work.cut(sets.join(members.filter("id <> class_id").select("id"), "id", "left_anti").select(F.col("id").alias("class_id"), F.monotonically_increasing_id().alias("num"), "shingles"), "reps")

    work.drop("sets")

    n_reps = reps.count()
    counts = reps.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    frequent = counts.filter(F.col("n") > max(RARE, n_reps // HEAVY)).toPandas().sort_values("s")
    heavy = spark.sparkContext.broadcast((frequent["s"].to_numpy(dtype=np.int64), frequent["n"].to_numpy(dtype=np.int64)))
    total, hot_keys, members_of = _lengths(reps, n_reps, heavy, threshold)
    hot = spark.sparkContext.broadcast((hot_keys, members_of))

    # A text goes to most parts with its bitmap while they are few, so no more of them than the cores need.
    parts = max(2 * spark.sparkContext.defaultParallelism, total // PART)
    lists = _short_lists(reps.select(F.col("num").alias("id"), "shingles"), heavy, hot, threshold, parts)
    found = lists.groupBy("part").applyInPandas(_candidates(threshold), "a long, b long").distinct()
    names = reps.select("num", "class_id")
    told = found.join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b")
    candidates = work.cut(told.select(F.col("x").alias("a"), F.col("y").alias("b")), "candidates")
    one = reps.select(F.col("class_id").alias("a"), F.col("shingles").alias("sa"))
    two = reps.select(F.col("class_id").alias("b"), F.col("shingles").alias("sb"))
    probed = candidates.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInPandas(_probe, "a string, b string, na long, nb long, common long")
    jaccard = F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    alike = probed.filter(F.col("common") >= F.lit(threshold) * (F.col("na") + F.col("nb") - F.col("common")) - 1e-9)
    pairs = work.cut(alike.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), jaccard.alias("jaccard")), "pairs")
    sizes = reps.select("class_id").join(several.select("class_id", "size"), "class_id", "left").select("class_id", F.coalesce("size", F.lit(1)).alias("size"))
    return NearDuplicates(pairs, members, sizes)


def expanded(found: NearDuplicates) -> DataFrame:
    """a, b (a < b) over texts: pairs of representatives for all they stand for, and copies among themselves.

    As many rows as there are pairs; use ``per_text`` where classes suffice.
    """
    of = found.members.withColumnRenamed("id", "text")
    left = found.pairs.join(of.withColumnRenamed("class_id", "a"), "a", "left").select(F.coalesce("text", "a").alias("x"), "b")
    both = left.join(of.withColumnRenamed("class_id", "b"), "b", "left").select("x", F.coalesce("text", "b").alias("y"))
    copies = of.select("class_id", F.col("text").alias("x")).join(of.select("class_id", F.col("text").alias("y")), "class_id").filter("x < y").select("x", "y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionByName(copies.select(F.col("x").alias("a"), F.col("y").alias("b")))


def per_text(found: NearDuplicates) -> DataFrame:
    """id, class_id, links of every text with a partner: its class of equal sets and its number of partners."""
    ends = found.pairs.select(F.col("a").alias("class_id"), F.col("b").alias("other")).unionByName(found.pairs.select(F.col("b").alias("class_id"), F.col("a").alias("other")))
    outside = ends.join(found.classes.select(F.col("class_id").alias("other"), "size"), "other").groupBy("class_id").agg(F.sum("size").alias("outside"))
    inside = found.classes.join(outside, "class_id", "left").select("class_id", (F.coalesce("outside", F.lit(0)) + F.col("size") - 1).alias("links"), "size").filter("links > 0")
    single = inside.filter("size = 1").select(F.col("class_id").alias("id"), "class_id", "links")
    return single.unionByName(found.members.join(inside, "class_id").select("id", "class_id", "links"))


def _pages(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    pages = current(spark, sf_dir, "pages", ["normalized_text"]).select(F.col("page_id").alias("id"), F.col("normalized_text").alias("text"))
    return near_duplicates(spark, pages, words=3, threshold=0.4, least_words=60)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expanded(_pages(spark, sf_dir)).select(F.col("a").alias("page_a"), F.col("b").alias("page_b"))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_text(_pages(spark, sf_dir)).withColumnRenamed("id", "page_id")


#: The same by counting common shingles of all pairs of pages.
P4_ORACLE = r"""
WITH cur AS (SELECT page_id, normalized_text AS t FROM pages QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY created_at DESC NULLS LAST) = 1),
w AS (SELECT page_id, list_filter(regexp_split_to_array(replace(lower(t), 'ё', 'е'), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM cur WHERE t IS NOT NULL),
s AS (SELECT DISTINCT page_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 60),
n AS (SELECT page_id, count(*) AS n FROM s GROUP BY page_id),
c AS (SELECT a.page_id AS page_a, b.page_id AS page_b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.page_id < b.page_id GROUP BY ALL)
SELECT page_a, page_b FROM c JOIN n x ON x.page_id = page_a JOIN n y ON y.page_id = page_b WHERE c >= 0.4 * (x.n + y.n - c) - 1e-9
"""
