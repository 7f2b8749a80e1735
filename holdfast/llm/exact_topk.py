"""Exhaustive term-at-a-time top-k search.

Vectors become sparse integer rows (dimension, weight).  Within a block the
candidates are an inverted index; each term of the query rows scatters
query weight times posting weight into dense score arrays, one per query.
Partition selection gives the block's best, a window merges the blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

Index = dict[int, tuple[np.ndarray, np.ndarray]]


def invert(dims: list, weights: list) -> Index:
    """Postings (rows, weights) of every dimension; rows ascend."""
    sizes = [len(d) for d in dims]
    if not sum(sizes):
        return {}
    row = np.repeat(np.arange(len(dims)), sizes)
    dim, weight = np.concatenate(dims), np.concatenate(weights)
    order = np.argsort(dim, kind="stable")
    dim, row, weight = dim[order], row[order], weight[order]
    cuts = np.flatnonzero(np.diff(dim)) + 1
    return {int(d[0]): (r, w) for d, r, w in
            zip(np.split(dim, cuts), np.split(row, cuts), np.split(weight, cuts))}


def scores(queries: Index, n_queries: int, index: Index, n: int) -> np.ndarray:
    """Dense scores (queries x candidates), filled one term at a time."""
    acc = np.zeros((n_queries, n), np.int64)
    for dim, (q, wq) in queries.items():
        if dim in index:
            c, wc = index[dim]
            if len(q) == n_queries and len(c) == n:
                acc += wq[:, None] * wc[None, :]       # every row has the term
            else:
                acc[np.ix_(q, c)] += wq[:, None] * wc[None, :]
    return acc


def block_search(qid: np.ndarray, qd: list, qw: list, ids: np.ndarray, index: Index, k: int,
                 at_once: int) -> list[tuple[int, int, int]]:
    """The best ``k`` (query, vector, score) of every query in one block;
    ``ids`` ascend, so the first of equal scores has the smallest id."""
    out = []
    n = len(ids)
    for lo in range(0, len(qid), at_once):
        some = slice(lo, lo + at_once)
        acc = scores(invert(qd[some], qw[some]), len(qid[some]), index, n)
        for i, own in enumerate(qid[some]):
            s = acc[i]
            take = min(n, k + 1)                       # its own row may be among them
            bar = np.partition(s, n - take)[n - take]
            above = np.flatnonzero(s > bar)
            pick = np.concatenate([above, np.flatnonzero(s == bar)[:take - len(above)]])
            rows = sorted((-int(s[j]), int(ids[j])) for j in pick if ids[j] != own)
            out += [(int(own), v, -t) for t, v in rows[:k]]
    return out


def quantized(vectors: DataFrame, scale: int, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, d, w): rows with an id and a finite vector, as sparse integer
    weights floor(scale * x).  Of rows that share an id, the one with the
    smallest vector counts."""
    x = F.col("x")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = (vectors.select(F.col(vec_id).cast("long").alias("vec_id"),
                           F.col(embedding).cast("array<double>").alias("x"))
            .filter(F.col("vec_id").isNotNull() & x.isNotNull()).filter(fine)
            .groupBy("vec_id").agg(F.min("x").alias("x")))
    terms = F.filter(F.transform(x, lambda v, i: F.struct(
        i.alias("d"), F.floor(v * scale).cast("long").alias("w"))), lambda t: t["w"] != 0)
    return rows.select("vec_id", terms.alias("t")) \
        .select("vec_id", F.col("t.d").alias("d"), F.col("t.w").alias("w"))


def search(vectors: DataFrame, k: int = 5, is_query: Column | None = None, scale: int = 256,
           query_block: int = 2048, block: int = 16384, at_once: int = 64,
           vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """For each query row the ``k`` highest integer inner products with other
    rows: query_id, rank, vec_id, score; ties go to the smaller vec_id.

    ``is_query`` is a condition on vec_id (default: divisible by 50).  Vectors
    that are null or hold a null or non-finite component, and rows without an
    id, take no part; an empty or all-zero vector scores 0.  Scores are
    64-bit integers and wrap beyond them.  Fewer candidates than ``k`` give
    fewer rows; an empty table gives none; other columns are not read.
    """
    if is_query is None:
        is_query = F.col("vec_id") % 50 == 0
    rows = materialize(quantized(vectors, scale, vec_id, embedding), "weights")
    queries = rows.filter(is_query)
    n_cb = max(1, -(-rows.count() // block))
    n_qb = max(1, -(-queries.count() // query_block))
    c = rows.select("vec_id", "d", "w", F.pmod(F.xxhash64("vec_id"), F.lit(n_cb)).alias("cb"),
                    F.explode(F.sequence(F.lit(0), F.lit(n_qb - 1))).alias("qb"))
    q = queries.select("vec_id", "d", "w",
                       F.pmod(F.xxhash64("vec_id"), F.lit(n_qb)).cast("int").alias("qb"),
                       F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_cb - 1).cast("long")))
                       .alias("cb"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("vec_id")
            index = invert(list(right["d"]), list(right["w"]))
            out = block_search(left["vec_id"].to_numpy(), list(left["d"]), list(left["w"]),
                               right["vec_id"].to_numpy(), index, k, at_once)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    near = (q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb"))
            .applyInPandas(meet, "query_id long, vec_id long, score long"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
