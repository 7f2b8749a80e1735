"""Hard negatives from Hilbert-ordered blocks with zone maps.

Candidates are ordered along a Hilbert curve through all dimensions and cut
into blocks, one Parquet row each, with the least and greatest weight of every
dimension (its zone map).  Interval arithmetic on a zone map bounds an anchor's
inner product with every row of the block, so a block is read only for anchors
with a window that the bounds meet.  Anchors lie in tiles along the same curve;
blocks around a tile are probed first, which raises the windows' lower ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import row_number_global
from .common import materialize

LEAST, MOST = -(1 << 63), (1 << 63) - 1
_EXACT = float(1 << 53)            # integers below are exact as doubles
ANCHOR = "tile long, anchor_id long, label long, w array<long>, " \
         "asks array<struct<ask:long,low:long,high:long>>"
_ANCHOR = pa.schema([
    ("tile", pa.int64()), ("anchor_id", pa.int64()), ("label", pa.int64()),
    ("w", pa.list_(pa.int64())),
    ("asks", pa.list_(pa.struct([("ask", pa.int64()), ("low", pa.int64()),
                                 ("high", pa.int64())])))])
BLOCK = "block long, ids array<long>, labels array<long>, width int, weights binary, " \
        "lo array<long>, hi array<long>, kinds array<long>"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of grid cells (rows x dimensions,
    ``bits`` per dimension) as big-endian bytes, by Skilling's transform."""
    x = cells.astype(np.int64).T.copy()
    for shift in range(bits - 1, 0, -1):
        q, p = 1 << shift, (1 << shift) - 1
        for i in range(len(x)):
            swap = np.where(x[i] & q, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(x[i] & q, p, swap)
            x[i] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=0)
    turn = np.zeros(x.shape[1], np.int64)
    for shift in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << shift), (1 << shift) - 1, 0)
    x ^= turn
    rows = [(x[i] >> b) & 1 for b in range(bits - 1, -1, -1) for i in range(len(x))]
    return np.packbits(np.array(rows, np.uint8), axis=0).T


def bounds(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product (anchors x blocks) that rows inside
    the zones can have; widened where doubles round."""
    plus, minus = np.maximum(anchors, 0).astype(float), np.minimum(anchors, 0).astype(float)
    lo, hi = lo.astype(float), hi.astype(float)
    low, high = plus @ lo.T + minus @ hi.T, plus @ hi.T + minus @ lo.T
    size = np.abs(anchors).astype(float) @ np.maximum(np.abs(lo), np.abs(hi)).T
    slack = np.where(size < _EXACT, 0, size * 2.0 ** -40)
    return low - slack, high + slack


def products(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """64-bit inner products; through doubles where those are exact."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(anchor).sum(dtype=float))
    if most < _EXACT:
        return (rows.astype(float) @ anchor.astype(float)).astype(np.int64)
    return rows.astype(np.int64) @ anchor.astype(np.int64)


def first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id."""
    at = np.arange(len(score))
    if len(score) > k:
        bar = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= bar)
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled with 0."""
    lists = column.combine_chunks()
    out = np.zeros((len(lists), dims), np.int64)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == out.size:
        return flat.reshape(out.shape).astype(np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes),
        np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Blocks:
    """Blocks of candidates that one task reads."""

    def __init__(self, table: pa.Table, dims: int):
        self.lo, self.hi = (matrix(table.column(c), dims) for c in ("lo", "hi"))
        parts = [np.frombuffer(b, f"<i{n}").reshape(-1, dims) for b, n in
                 zip(table.column("weights").to_pylist(), table.column("width").to_pylist())]
        self.sizes = np.array([len(p) for p in parts])
        self.rows = np.concatenate(parts)
        self.ids, self.labels = (table.column(c).combine_chunks().flatten()
                                 .to_numpy(zero_copy_only=False) for c in ("ids", "labels"))

    def search(self, anchor: np.ndarray, label: int, own: int, low: np.ndarray, high: np.ndarray,
               asks: list[dict], same: bool, k: int):
        """Per window its ``k`` best rows, from blocks that its bounds meet."""
        need = np.zeros(len(self.sizes), bool)
        for a in asks:
            need |= (high >= a["low"]) & (low <= a["high"])
        if not need.any():
            return
        at = np.flatnonzero(np.repeat(need, self.sizes))
        at = at[((self.labels[at] == label) == same) & (self.ids[at] != own)]
        score, ids = products(self.rows[at], anchor), self.ids[at]
        for a in asks:
            fit = np.flatnonzero((score >= a["low"]) & (score <= a["high"]))
            best = fit[first(score[fit], ids[fit], k)]
            yield a, ids[best], score[best]


def candidates(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, w): rows that take part, as integer weights
    floor(scale * x).  Rows that share an id are one: the results name rows by
    their ids, so that with the least label and vector counts."""
    x = F.col("x")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                           F.col("label").cast("long").alias("label"),
                           F.col("embedding").cast("array<double>").alias("x"))
            .filter("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").filter(fine)
            .groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r"))
            .select("vec_id", "r.label",
                    F.transform("r.x", lambda v: F.floor(v * scale).cast("long")).alias("w")))


def along_curve(rows: DataFrame, dims: int, bits: int) -> DataFrame:
    """``rows`` with pos, their place (from 0) along the curve.  Cells divide
    the range that the weights of each dimension have in the whole table."""
    spread = rows.select(F.posexplode("w").alias("i", "v")).groupBy("i") \
        .agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()    # a row per dimension
    lo, hi = np.zeros(dims), np.zeros(dims)
    for r in spread:
        lo[r["i"]], hi[r["i"]] = r["lo"], r["hi"]
    step = (hi - lo + 1) / (1 << bits)

    def keyed(batches):
        for b in batches:
            cells = np.floor((matrix(pa.chunked_array([b.column("w")]), dims) - lo) / step)
            keys = hilbert_keys(cells.clip(0, (1 << bits) - 1), bits)
            yield b.append_column("key", pa.array([k.tobytes() for k in keys], pa.binary()))

    keyed_rows = materialize(rows.mapInArrow(keyed, "vec_id long, label long, w array<long>, "
                                             "key binary"), "hilbert")
    return row_number_global(keyed_rows, [F.col("key"), F.col("vec_id")], "pos") \
        .select("vec_id", "label", "w", (F.col("pos") - 1).alias("pos"))


def write_blocks(rows: DataFrame, dims: int, block_rows: int) -> DataFrame:
    """The candidate table: a row per block, with its zone map."""
    def pack(table: pa.Table) -> pa.Table:
        w = matrix(table.column("w"), dims)
        lo, hi = w.min(axis=0), w.max(axis=0)
        width = next(n for n in (2, 4, 8)
                     if n == 8 or max(-int(lo.min()), int(hi.max()) + 1) <= 1 << (8 * n - 1))
        labels = table.column("label").to_numpy()
        return pa.table({
            "block": table.column("block")[:1], "ids": [table.column("vec_id").to_numpy()],
            "labels": [labels], "width": pa.array([width], pa.int32()),
            "weights": [w.astype(f"<i{width}").tobytes()], "lo": [lo], "hi": [hi],
            "kinds": [np.unique(labels)]})

    return materialize(
        rows.withColumn("block", F.expr(f"pos div {block_rows}")).groupBy("block")
        .applyInArrow(pack, BLOCK), "blocks")


def mine(anchors: DataFrame, homes: DataFrame, blocks: DataFrame, dims: int, same: bool, k: int,
         shelf: int, page: int) -> DataFrame:
    """Per window (anchor_id, ask) its ``k`` highest (score, vec_id), ranked
    from 1, among rows with the anchor's label (``same``) or another one.

    Blocks of the anchors' own tile are read first: where a window is full,
    its k-th score becomes its lower end.  Then the zone maps choose blocks.
    """
    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        out = left.to_pylist()
        if right.num_rows and out:
            near = Blocks(right, dims)
            weights = matrix(left.column("w"), dims)
            low, high = bounds(weights, near.lo, near.hi)
            for i, row in enumerate(out):
                for a, _, score in near.search(weights[i], row["label"], row["anchor_id"], low[i],
                                               high[i], row["asks"], same, k):
                    if len(score) == k:
                        a["low"] = max(a["low"], int(score[-1]))
        return pa.Table.from_pylist(out, _ANCHOR)

    raised = materialize(
        anchors.groupBy("tile").cogroup(homes.join(blocks, "block").groupBy("home"))
        .applyInArrow(probe, ANCHOR), "anchors")

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        need = np.zeros(right.num_rows, bool)
        if left.num_rows and right.num_rows:
            low, high = bounds(matrix(left.column("w"), dims),
                               *(matrix(right.column(c), dims) for c in ("lo", "hi")))
            kinds = right.column("kinds").to_pylist()
            for i, row in enumerate(left.drop_columns("w").to_pylist()):
                meets = np.zeros(len(need), bool)
                for a in row["asks"]:
                    meets |= (high[i] >= a["low"]) & (low[i] <= a["high"])
                has = [row["label"] in x if same else x != [row["label"]] for x in kinds]
                need |= meets & np.array(has)
        chosen = right.column("block").filter(pa.array(need))
        tile = left.column("tile")[0].as_py() if left.num_rows else None
        return pa.table({"tile": pa.array([tile] * len(chosen), pa.int64()), "block": chosen})

    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long")))
    last_block = blocks.agg(F.max("block")).first()[0] or 0
    last_tile = raised.agg(F.max("tile")).first()[0] or 0
    pages = raised.withColumn("page", upto(last_block // page))
    zones = blocks.select("block", "lo", "hi", "kinds", F.expr(f"block div {page}").alias("page"),
                          upto(last_tile).alias("tile"))        # every tile looks at every zone map
    chosen = materialize(
        pages.groupBy("tile", "page").cogroup(zones.groupBy("tile", "page"))
        .applyInArrow(choose, "tile long, block long"), "chosen") \
        .withColumn("shelf", F.expr(f"block div {shelf}"))

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[str, list] = {"anchor_id": [], "ask": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            here = Blocks(right, dims)
            weights = matrix(left.column("w"), dims)
            low, high = bounds(weights, here.lo, here.hi)
            for i, row in enumerate(left.drop_columns("w").to_pylist()):
                for a, ids, score in here.search(weights[i], row["label"], row["anchor_id"],
                                                 low[i], high[i], row["asks"], same, k):
                    found["anchor_id"] += [row["anchor_id"]] * len(ids)
                    found["ask"] += [a["ask"]] * len(ids)
                    found["vec_id"] += ids.tolist()
                    found["score"] += score.tolist()
        return pa.table({n: pa.array(v, pa.int64()) for n, v in found.items()})

    places = chosen.select(F.col("tile").alias("of"), F.col("shelf").alias("at")).distinct()
    readers = raised.join(places, F.col("tile") == F.col("of")) \
        .select("tile", F.col("at").alias("shelf"), "anchor_id", "label", "w", "asks")
    hits = (readers.groupBy("tile", "shelf")
            .cogroup(chosen.join(blocks, "block").groupBy("tile", "shelf"))
            .applyInArrow(read, "anchor_id long, ask long, vec_id long, score long"))
    best = Window.partitionBy("anchor_id", "ask").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column | None = None, positives: int = 5,
                   negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
                   bits: int = 4, block_rows: int = 256, tile: int = 512, shelf: int = 64,
                   page: int = 4096) -> DataFrame:
    """For each anchor and each of its positives the best rows of other labels
    that score between ``low`` and ``high`` percent of the positive.

    ``vectors`` holds vec_id, embedding and label (an integer); ``is_anchor``
    is a condition on vec_id (default: divisible by 100).  Rows without an id,
    label or vector, or with a null or non-finite component, take no part.
    A score is the integer inner product of floor(scale * x) with the
    anchor's; higher ones come first, ties by smaller vec_id.  Positives are
    the first rows of the anchor's label but itself.  A negative positive
    score leaves an empty window.  Vectors that are shorter than the longest
    one count as filled with 0.  Scores are 64-bit integers and wrap beyond.

    Returns anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score; an empty table gives none.  Other columns are not read.
    """
    if not 0 <= low <= high:
        raise ValueError("0 <= low <= high is needed")
    if is_anchor is None:
        is_anchor = F.col("vec_id") % 100 == 0
    rows = materialize(candidates(vectors, scale), "candidates")
    dims = max(1, rows.agg(F.max(F.size("w"))).first()[0] or 1)
    rows = along_curve(rows, dims, bits)
    blocks = write_blocks(rows, dims, block_rows)
    anchors = row_number_global(rows.filter(is_anchor), [F.col("pos")], "n").select(
        F.expr(f"(n - 1) div {tile}").alias("tile"), F.col("vec_id").alias("anchor_id"), "label",
        "w", F.expr(f"pos div {block_rows}").alias("block"))
    anchors = materialize(anchors, "tiles")
    homes = anchors.select(F.col("tile").alias("home"), "block").distinct()
    ask = lambda of, low, high: F.struct(                              # noqa: E731
        of.cast("long").alias("ask"), low.cast("long").alias("low"), high.cast("long").alias("high"))

    top = materialize(mine(
        anchors.select("tile", "anchor_id", "label", "w", F.array(
            ask(F.lit(0), F.lit(LEAST), F.lit(MOST))).alias("asks")),
        homes, blocks, dims, True, positives, shelf, page)
        .select("anchor_id", F.col("vec_id").alias("positive_id"),
                F.col("score").alias("positive_score")), "positives")
    p = F.col("positive_score")
    asks = top.filter(p >= 0).groupBy("anchor_id").agg(F.collect_list(
        ask(F.col("positive_id"), F.expr(f"({low} * positive_score + 99) div 100"),
            F.expr(f"{high} * positive_score div 100"))).alias("asks"))
    found = mine(anchors.join(asks, "anchor_id").select("tile", "anchor_id", "label", "w", "asks"),
                 homes, blocks, dims, False, negatives, shelf, page)
    return found.withColumnsRenamed({"ask": "positive_id", "vec_id": "negative_id",
                                     "score": "negative_score"}) \
        .join(top, ["anchor_id", "positive_id"]) \
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                "negative_score")
