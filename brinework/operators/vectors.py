"""Exact vector search in blocks, and vector aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block of queries, and of the corpus.
QUERY_BLOCK, CORPUS_BLOCK = 512, 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _by(a: Column, value: Column, how) -> Column:
    """how(x, value) for every x of an array; the value, which may itself read the array, is computed once a row."""
    return F.zip_with(a, F.array_repeat(value, F.size(a)), how)


def unit(a: Column) -> Column:
    """L2-normalised; a null vector stays."""
    return _by(a, F.nullif(norm(a), F.lit(0.0)), lambda x, length: F.coalesce(x.cast("double") / length, F.lit(0.0)))


def quantized(a: Column, how: str) -> Column:
    """R-04: int8 (largest value at 127, scaled back) or binary (signs), then normalised."""
    if how == "binary":
        return unit(F.transform(a, lambda x: F.when(x >= 0, 1.0).otherwise(-1.0)))
    scale = F.nullif(F.array_max(F.transform(a, lambda x: F.abs(x.cast("double")))) / 127, F.lit(0.0))
    return unit(_by(a, scale, lambda x, s: F.coalesce(F.least(F.greatest(F.floor(x.cast("double") / s + 0.5), F.lit(-127)), F.lit(127)) * s, F.lit(0.0))))


def _packed(rows: DataFrame, key: str, vector: str, size: int, name: str) -> DataFrame:
    """Blocks of vectors as bytes, one row each; made where the rows lie."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), size):
                part = batch.iloc[k : k + size]
                matrix = np.array(part["v"].to_list(), dtype=np.float64)
                yield pd.DataFrame({f"{name}_ids": [part["k"].to_numpy(dtype=np.int64).tobytes()], f"{name}_matrix": [matrix.tobytes()], f"{name}_dim": [matrix.shape[1]]})

    return rows.filter(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v")).mapInPandas(pack, f"{name}_ids binary, {name}_matrix binary, {name}_dim int")


def _best(scores: np.ndarray, asked: np.ndarray, docs: np.ndarray, k: int, exclude_self: bool) -> pd.DataFrame:
    """The k best of a block of scores, rounded to 1e-6, ties by id."""
    scores = np.floor(scores * 1e6 + 0.5) / 1e6
    if exclude_self:
        scores[asked[:, None] == docs[None, :]] = -np.inf
    order = np.lexsort((np.broadcast_to(docs, scores.shape), -scores), axis=1)[:, :k]
    out = pd.DataFrame({"qid": np.repeat(asked, order.shape[1]), "doc": docs[order].ravel(), "score": np.take_along_axis(scores, order, axis=1).ravel()})
    return out[np.isfinite(out["score"])]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc"))
    return found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def search(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, exclude_self: bool = True) -> DataFrame:
    """qid, doc, score, rank: the k best by inner product, exact (R-03, J-17).

    A stated set of queries meets all rows block by block; a pair of blocks
    hands on k rows a query, so what is shuffled is queries x blocks x k.
    Scores are compared after rounding to 1e-6, ties by id.
    """
    blocks = _packed(corpus, key, vector, CORPUS_BLOCK, "c").crossJoin(_packed(queries, key, vector, QUERY_BLOCK, "q"))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                docs, asked = np.frombuffer(r.c_ids, dtype=np.int64), np.frombuffer(r.q_ids, dtype=np.int64)
                scores = np.frombuffer(r.q_matrix).reshape(len(asked), -1) @ np.frombuffer(r.c_matrix).reshape(len(docs), -1).T
                yield _best(scores, asked, docs, k, exclude_self)

    return _ranked(blocks.mapInPandas(best, "qid long, doc long, score double"), k)


def mean_vector(rows: DataFrame, group: list[str], vector: str, weight: Column | None = None) -> DataFrame:
    """Group, mean (array of sums by place on a dyadic grid, normalised): the same in any order (A-18, K-10)."""
    w = weight if weight is not None else F.lit(1.0)
    long = rows.select(*group, w.alias("w"), F.posexplode(vector).alias("pos", "x"))
    sums = long.groupBy(*group, "pos").agg(F.sum(F.round(F.col("w") * F.col("x").cast("double") * float(1 << 24)).cast("long")).alias("s"))
    whole = sums.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda p: p["s"] / float(1 << 24)).alias("mean"))
    return whole.withColumn("mean", unit(F.col("mean")))


def maxsim(query_tokens: DataFrame, doc_tokens: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """qid, doc, score, rank: the k best by the sum over query tokens of the best document token (R-06). Tokens: id, pos, vec.

    Tokens are gathered to a matrix per text; blocks of the stated queries meet
    blocks of documents and hand on k rows a query, as in ``search``.
    """
    matrix = F.transform(F.array_sort(F.collect_list(F.struct("pos", "vec"))), lambda t: t["vec"])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), QUERY_BLOCK):
                part = batch.iloc[k : k + QUERY_BLOCK]
                whole = np.concatenate([np.array(list(m), dtype=np.float64) for m in part["m"]])
                yield pd.DataFrame({"ids": [part["id"].to_numpy(dtype=np.int64).tobytes()], "sizes": [part["m"].map(len).to_numpy(dtype=np.int64).tobytes()], "matrix": [whole.tobytes()], "dim": [whole.shape[1]]})

    def packed(tokens: DataFrame, name: str) -> DataFrame:
        blocks = tokens.groupBy("id").agg(matrix.alias("m")).mapInPandas(pack, "ids binary, sizes binary, matrix binary, dim int")
        return blocks.select(*(F.col(c).alias(f"{name}_{c}") for c in blocks.columns))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                q, d = np.frombuffer(r.q_matrix).reshape(-1, r.q_dim), np.frombuffer(r.d_matrix).reshape(-1, r.d_dim)
                starts = [np.r_[0, np.cumsum(np.frombuffer(s, dtype=np.int64))[:-1]] for s in (r.q_sizes, r.d_sizes)]
                best = np.maximum.reduceat(q @ d.T, starts[1], axis=1)
                total = np.add.reduceat(best, starts[0], axis=0)
                yield _best(total, np.frombuffer(r.q_ids, dtype=np.int64), np.frombuffer(r.d_ids, dtype=np.int64), k, exclude_self)

    return _ranked(packed(doc_tokens, "d").crossJoin(packed(query_tokens, "q")).mapInPandas(score, "qid long, doc long, score double"), k)


def csls(queries: DataFrame, side_a: DataFrame, side_b: DataFrame, key: str, vector: str, k: int = 5) -> DataFrame:
    """a, b, csls: for every query (of side a) the vectors of side b with the greatest 2 * product - level(a) - level(b), ties kept (K-21).

    A level is the mean of the k best products with the whole other side.  The
    levels travel with the vectors, so a pair of blocks hands on the best of
    each query only; no table of all pairs is formed.
    """
    level = lambda found, name: found.groupBy(F.col("qid").alias(key)).agg(F.avg("score").alias(name))
    asked = queries.select(key, vector).join(level(search(queries, side_b, key, vector, k, False), "level"), key)
    other = side_b.select(key, vector).join(level(search(side_b, side_a, key, vector, k, False), "level"), key)
    leveled = lambda df: df.select(key, F.concat(F.transform(vector, lambda x: x.cast("double")), F.array("level")).alias("leveled"))
    blocks = _packed(leveled(other), key, "leveled", CORPUS_BLOCK, "c").crossJoin(_packed(leveled(asked), key, "leveled", QUERY_BLOCK, "q"))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                docs, asked_ids = np.frombuffer(r.c_ids, dtype=np.int64), np.frombuffer(r.q_ids, dtype=np.int64)
                q, c = np.frombuffer(r.q_matrix).reshape(len(asked_ids), -1), np.frombuffer(r.c_matrix).reshape(len(docs), -1)
                product = np.floor(q[:, :-1] @ c[:, :-1].T * 1e6 + 0.5) / 1e6
                score = np.floor((2 * product - q[:, -1:] - c[:, -1]) * 1e6 + 0.5) / 1e6
                i, j = np.nonzero(score == score.max(axis=1, keepdims=True))
                yield pd.DataFrame({"a": asked_ids[i], "b": docs[j], "csls": score[i, j]})

    found = blocks.mapInPandas(best, "a long, b long, csls double")
    return found.withColumn("r", F.rank().over(Window.partitionBy("a").orderBy(F.desc("csls")))).filter("r = 1").drop("r")
