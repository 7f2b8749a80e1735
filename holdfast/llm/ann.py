"""Approximate nearest neighbours from randomly rotated one-bit codes.

Unit vectors are rotated to ``bits`` dimensions (random orthonormal columns
from a fixed seed) and only the signs are kept, packed eight to a byte, with
the correction scalar f = <o, o_bar> between a vector and its code.  For a
query q, <q, o_bar> / f estimates <q, o> without bias, and its error is, but
for a vanishing share, at most eps * sqrt((1 - f*f) / (f*f * (bits - 1))).
Every candidate whose upper bound reaches the k-th best exact score so far is
reranked in double precision on the original vectors.

Equal vectors are one candidate with the smallest ids it can need.  Queries
and candidates meet in blocks of bounded size, dealt by hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def rotation(dims: int, bits: int, seed: int) -> np.ndarray:
    """``bits`` x ``dims`` with orthonormal columns."""
    g = np.random.default_rng(seed).standard_normal((max(bits, dims), dims))
    q, _ = np.linalg.qr(g)
    return q


def encode(vectors: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and correction scalars of unit vectors."""
    turned = vectors @ rot.T
    code = np.packbits(turned > 0, axis=1)
    return code, np.abs(turned).sum(axis=1) / np.sqrt(rot.shape[0])


def estimate(queries: np.ndarray, code: np.ndarray, factor: np.ndarray, rot: np.ndarray,
             eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x candidates) and error bounds."""
    bits = rot.shape[0]
    signs = np.unpackbits(code, axis=1, count=bits).astype(np.float32) * 2 - 1
    est = (queries @ rot.T).astype(np.float32) @ signs.T / np.sqrt(bits)
    f = np.maximum(factor, 1e-6)
    return est / f.astype(np.float32), eps * np.sqrt((1 - np.minimum(f, 1) ** 2) / (f * f * (bits - 1)))


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows at length one, also where squares leave the range of doubles."""
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosine(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of one vector with each row, the same for equal rows."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        s = (rows * q).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((q * q).sum()))
    odd = ~np.isfinite(s)
    if odd.any():                                # squares beyond the range of doubles
        s[odd] = (unit(rows[odd]) * unit(q[None, :])).sum(axis=1)
    return s


def block_search(qid: np.ndarray, q: np.ndarray, ids: list, x: np.ndarray, k: int, bits: int,
                 eps: float, seed: int) -> list[tuple[int, int, float]]:
    """The best ``k`` (query, vector, score) of every query in one block.
    ``ids`` lists the ids of each candidate vector."""
    rot = rotation(x.shape[1], bits, seed)
    code, factor = encode(unit(x), rot)
    out = []
    for lo in range(0, len(q), 64):
        est, err = estimate(unit(q[lo:lo + 64]), code, factor, rot, eps)
        for i in range(len(est)):
            n, vec = lo + i, q[lo + i]
            take = min(len(x), 4 * k + 4)
            first = np.argpartition(-est[i], take - 1)[:take]
            exact = cosine(vec, x[first])
            # the query's own vector may be among them: one more than k
            bar = np.partition(exact, max(0, take - k - 1))[max(0, take - k - 1)] \
                if take > k else -np.inf
            pick = np.flatnonzero(est[i] + err >= bar - 1e-9)
            score = cosine(vec, x[pick])
            rows = [(-s, v) for s, c in zip(score.tolist(), pick.tolist()) for v in ids[c]
                    if v != qid[n]]
            rows.sort()
            out += [(int(qid[n]), v, -s) for s, v in rows[:k]]
    return out


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, x): rows with an id and a finite, non-zero vector.  Of rows
    that share an id, the one with the smallest vector counts."""
    x = F.col("x")
    fine = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v)
                                      & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return (vectors.select(F.col(vec_id).cast("long").alias("vec_id"),
                           F.col(embedding).cast("array<double>").alias("x"))
            .filter(F.col("vec_id").isNotNull() & x.isNotNull()).filter(fine)
            .groupBy("vec_id").agg(F.min("x").alias("x")))


def search(vectors: DataFrame, k: int = 5, is_query: Column | None = None, bits: int = 256,
           eps: float = 3.0, seed: int = 7, query_block: int = 2048, block: int = 16384,
           vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """For each query row its ``k`` nearest others by cosine: query_id, rank,
    vec_id, score; ties go to the smaller vec_id.

    ``is_query`` is a condition on vec_id (default: divisible by 50).  Vectors
    that are null, zero, empty or hold a null or non-finite component, and
    rows without an id, take no part; vectors of other lengths than a query's
    are not its candidates.  Equal vectors tie.  Fewer candidates than ``k``
    give fewer rows; an empty table gives none; other columns are not read.
    """
    if is_query is None:
        is_query = F.col("vec_id") % 50 == 0
    rows = materialize(usable(vectors, vec_id, embedding).withColumn("d", F.size("x")), "vectors")
    # equal vectors: a query needs its k smallest ids, and its own may be one
    order = Window.partitionBy("x").orderBy("vec_id")
    cands = (rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
             .groupBy("x", "d").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    cands = materialize(cands, "candidates")
    queries = rows.filter(is_query)
    n_cb = max(1, -(-cands.count() // block))
    n_qb = max(1, -(-queries.count() // query_block))
    c = cands.select(F.pmod(F.xxhash64("x"), F.lit(n_cb)).alias("cb"), "d", "ids", "x",
                     F.explode(F.sequence(F.lit(0), F.lit(n_qb - 1))).alias("qb"))
    q = queries.select("vec_id", "d", "x", F.pmod(F.xxhash64("vec_id"), F.lit(n_qb))
                       .cast("int").alias("qb"),
                       F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_cb - 1).cast("long")))
                       .alias("cb"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            out = block_search(left["vec_id"].to_numpy(), np.stack(left["x"].to_numpy()),
                               [list(v) for v in right["ids"]], np.stack(right["x"].to_numpy()),
                               k, bits, eps, seed)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"})

    near = (q.groupBy("qb", "cb", "d").cogroup(c.groupBy("qb", "cb", "d"))
            .applyInPandas(meet, "query_id long, vec_id long, score double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
