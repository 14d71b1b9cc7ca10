"""Lexical ranking, fusion of rankings and their measures (R- and T-families).

A ranking is a table (qid, doc, score) or (qid, doc, rank); ranks count from 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Queries and documents of a block.
ASKED, SEARCHED = 256, 512


def bm25(docs: DataFrame, doc: str, tokens: str, queries: DataFrame, k: int, exclude_self: bool = True, places: float | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """qid, doc, score, rank: the k best documents of each query (R-01). queries: qid, terms (array).

    A stated set of queries meets all documents block by block, as in vector
    search: the terms that a block of queries and a block of documents share
    make two small matrices, one product scores all their pairs, and k rows a
    query leave the block.  No posting list is ever formed or shuffled, so a
    common term costs a column, not a join.  Weights are whole numbers on a
    grid of 2^-24: sums are exact and ties don't depend on any order.

    Terms are 64-bit hashes; document frequencies are counted over all
    documents for the terms that queries have.  ``places``: scores are rounded
    to 1 / places before they are ranked.  Documents that share no term with a
    query aren't ranked for it; a null array has no terms.
    """
    hashed = docs.filter(F.col(tokens).isNotNull()).select(F.col(doc).alias("doc"), F.transform(tokens, lambda t: F.xxhash64(t)).alias("terms"))
    wanted = queries.filter("terms is not null").select("qid", F.explode(F.array_distinct(F.transform("terms", lambda t: F.xxhash64(t)))).alias("term"))
    size = hashed.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("terms")).alias("avgdl"))
    df = hashed.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(size))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = wanted.join(df.select("term", idf.alias("idf")), "term").groupBy("qid").agg(F.collect_list("term").alias("terms"), F.collect_list("idf").alias("idfs"))
    drag = k1 * (1 - b + b * F.size("terms") / F.col("avgdl"))
    sized = hashed.filter(F.size("terms") > 0).crossJoin(F.broadcast(size)).select("doc", "terms", drag.alias("drag"))

    def pack_queries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), ASKED):
                part = batch.iloc[at : at + ASKED]
                terms, first = np.unique(np.concatenate(part["terms"].to_list()), return_index=True)
                number = [np.searchsorted(terms, t).astype(np.int32) for t in part["terms"]]
                yield pd.DataFrame({"q_ids": [part["qid"].to_numpy(dtype=np.int64).tobytes()], "q_sizes": [np.array([len(t) for t in number]).tobytes()], "q_at": [np.concatenate(number).tobytes()], "q_terms": [terms.tobytes()], "q_idfs": [np.concatenate(part["idfs"].to_list())[first].tobytes()]})

    def pack_docs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), SEARCHED):
                part = batch.iloc[at : at + SEARCHED]
                counted = [np.unique(t, return_counts=True) for t in part["terms"]]
                yield pd.DataFrame({"d_ids": [part["doc"].to_numpy(dtype=np.int64).tobytes()], "d_sizes": [np.array([len(t) for t, _ in counted]).tobytes()], "d_terms": [np.concatenate([t for t, _ in counted]).tobytes()], "d_tf": [np.concatenate([n for _, n in counted]).astype(np.float64).tobytes()], "d_drag": [part["drag"].to_numpy(dtype=np.float64).tobytes()]})

    blocks = sized.mapInPandas(pack_docs, "d_ids binary, d_sizes binary, d_terms binary, d_tf binary, d_drag binary").crossJoin(asked.mapInPandas(pack_queries, "q_ids binary, q_sizes binary, q_at binary, q_terms binary, q_idfs binary"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ints = lambda x, of=np.int64: np.frombuffer(x, dtype=of)
        for batch in batches:
            for r in batch.itertuples(index=False):
                asked_ids, doc_ids, vocabulary = ints(r.q_ids), ints(r.d_ids), ints(r.q_terms)
                terms, tf, of_doc = ints(r.d_terms), ints(r.d_tf, np.float64), np.repeat(np.arange(len(doc_ids)), ints(r.d_sizes))
                spot = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
                known = vocabulary[spot] == terms
                if not known.any():
                    continue
                spot, tf, of_doc = spot[known], tf[known], of_doc[known]
                shared, column = np.unique(spot, return_inverse=True)
                weights = np.zeros((len(doc_ids), len(shared)))
                part = ints(r.q_idfs, np.float64)[spot] * tf * (k1 + 1) / (tf + ints(r.d_drag, np.float64)[of_doc])
                weights[of_doc, column] = np.floor(part * float(1 << 24) + 0.5)
                has = np.zeros((len(asked_ids), len(vocabulary)), dtype=bool)
                has[np.repeat(np.arange(len(asked_ids)), ints(r.q_sizes)), ints(r.q_at, np.int32)] = True
                scores = has[:, shared].astype(np.float64) @ weights.T
                none = scores == 0
                scores /= float(1 << 24)
                if places:
                    scores = np.floor(scores * places + 0.5) / places
                scores[none | (exclude_self & (asked_ids[:, None] == doc_ids[None, :]))] = -np.inf
                best = np.lexsort((np.broadcast_to(doc_ids, scores.shape), -scores), axis=1)[:, :k]
                out = pd.DataFrame({"qid": np.repeat(asked_ids, best.shape[1]), "doc": doc_ids[best].ravel(), "score": np.take_along_axis(scores, best, axis=1).ravel()})
                yield out[np.isfinite(out["score"])]

    return ranked(blocks.mapInPandas(score, "qid long, doc long, score double"), k=k)


def ranked(scores: DataFrame, score: str = "score", k: int | None = None) -> DataFrame:
    """qid, doc, score, rank: by score, then id."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(score), "doc")))
    return out.filter(F.col("rank") <= k) if k else out


def rrf(rankings: list[tuple[DataFrame, float]], k: int = 60, depth: int | None = None) -> DataFrame:
    """qid, doc, score: reciprocal rank fusion of (ranking, weight) (R-07)."""
    legs = [r.filter(F.col("rank") <= depth if depth else F.lit(True)).select("qid", "doc", (F.lit(w) / (k + F.col("rank"))).alias("s")) for r, w in rankings]
    both = legs[0]
    for leg in legs[1:]:
        both = both.unionAll(leg)
    return both.groupBy("qid", "doc").agg(F.sum("s").alias("score"))


def normalized(scores: DataFrame, how: str) -> DataFrame:
    """qid, doc, score scaled per query: minmax, zscore or rank (R-08)."""
    w = Window.partitionBy("qid")
    lo, hi, s = F.min("score").over(w), F.max("score").over(w), F.col("score")
    if how == "minmax":
        scaled = F.when(hi == lo, 1.0).otherwise((s - lo) / F.nullif(hi - lo, F.lit(0.0)))
    elif how == "zscore":
        sd = F.stddev_pop("score").over(w)
        scaled = F.when(sd == 0, 0.0).otherwise((s - F.avg("score").over(w)) / F.nullif(sd, F.lit(0.0)))
    else:
        scaled = 1 - (F.row_number().over(w.orderBy(F.desc("score"), "doc")) - 1) / F.count(F.lit(1)).over(w)
    return scores.select("qid", "doc", scaled.alias("score"))


def weighted_fusion(legs: list[tuple[DataFrame, float]], how: str) -> DataFrame:
    """qid, doc, score: weighted sum of scaled scores; an absent item has its list's least."""
    keys = None
    for leg, _ in legs:
        keys = leg.select("qid", "doc") if keys is None else keys.union(leg.select("qid", "doc"))
    out = keys.distinct()
    total = F.lit(0.0)
    for n, (leg, weight) in enumerate(legs):
        scaled = normalized(leg, how).withColumnRenamed("score", f"s{n}")
        floor = scaled.groupBy("qid").agg(F.min(f"s{n}").alias(f"f{n}"))
        out = out.join(scaled, ["qid", "doc"], "left").join(floor, "qid", "left")
        total = total + weight * F.coalesce(f"s{n}", f"f{n}", F.lit(0.0))
    return out.select("qid", "doc", total.alias("score"))


def per_source_cap(ranking: DataFrame, source: str, n: int) -> DataFrame:
    """Re-ordered so that each round takes n of a source; nothing is dropped (T-05). Unknown sources stay in round 0."""
    inside = F.row_number().over(Window.partitionBy("qid", source).orderBy("rank")) - 1
    turn = F.when(F.col(source).isNull(), 0).otherwise(F.floor(inside / n))
    return ranking.withColumn("turn", turn).withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("turn", "rank"))).drop("turn")


def head_promotion(ranking: DataFrame, flag: str, k: int) -> DataFrame:
    """Among the first k, flagged rows come first (T-06)."""
    zone = F.when((F.col("rank") <= k) & F.col(flag), 0).when(F.col("rank") <= k, 1).otherwise(2)
    return ranking.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy(zone, "rank")))


def collapse(ranking: DataFrame, group: str, inner: int) -> DataFrame:
    """Best of each group with its inner hits as text (T-07)."""
    at = ranking.withColumn("place", F.row_number().over(Window.partitionBy("qid", group).orderBy("rank")))
    kept = at.filter(F.col("place") <= inner).groupBy("qid", group).agg(F.min_by("doc", "rank").alias("doc"), F.min("rank").alias("rank"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc"))), lambda s: s["doc"].cast("string")), ",").alias("hits"))
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))


def interleaved(ranking: DataFrame, group: str) -> DataFrame:
    """Round robin over groups in order of their best (T-09)."""
    inside = ranking.withColumn("place", F.row_number().over(Window.partitionBy("qid", group).orderBy("rank"))).withColumn("best", F.min("rank").over(Window.partitionBy("qid", group)))
    return inside.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("place", "best"))).drop("place", "best")


def measures(ranking: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """qid, recall, precision, mrr, ndcg, judged at k (R-19). qrels: qid, doc, grade; relevant from grade 2.

    Queries without a relevant judgement are left out (R-20).
    """
    top = ranking.filter(F.col("rank") <= k).select("qid", "doc", "rank")
    seen = top.join(qrels, ["qid", "doc"], "left")
    gain = F.coalesce("grade", F.lit(0)) / F.log2(F.col("rank") + 1)
    relevant = F.coalesce(F.col("grade") >= 2, F.lit(False))
    got = seen.groupBy("qid").agg(F.count_if(relevant).alias("hits"), F.min(F.when(relevant, F.col("rank"))).alias("first"), F.sum(gain).alias("dcg"), F.count("grade").alias("judged"), F.count(F.lit(1)).alias("returned"))
    best = qrels.filter("grade > 0").withColumn("i", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "doc")))
    ideal = best.groupBy("qid").agg(F.sum(F.when(F.col("i") <= k, F.col("grade") / F.log2(F.col("i") + 1))).alias("idcg"), F.count_if(F.col("grade") >= 2).alias("n_rel")).filter("n_rel > 0")
    j = ideal.join(got, "qid", "left").fillna(0, ["hits", "dcg", "judged", "returned"])
    return j.select("qid", (F.col("hits") / F.col("n_rel")).alias("recall"), (F.col("hits") / k).alias("precision"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.col("dcg") / F.col("idcg")).alias("ndcg"), F.when(F.col("returned") > 0, F.col("judged") / F.nullif("returned", F.lit(0))).otherwise(1.0).alias("judged"))
