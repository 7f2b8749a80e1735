"""Hard negatives against plain loops, the curve and the bounds on their own."""

import math
import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm import hard_negatives as hn
from tests.llm.helpers import clashing

SMALL = {"block_rows": 8, "tile": 3, "shelf": 2, "page": 3}
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, low=30, high=90):
    v = {}
    for i, x, y in sorted((r for r in rows if r[0] is not None and r[1] is not None
                           and r[2] is not None and all(c is not None and math.isfinite(c)
                                                        for c in r[1])),
                          key=lambda r: (r[0], r[2], r[1])):
        v.setdefault(i, (y, [math.floor(256 * float(np.float32(c))) for c in x]))
    out = []
    for a, (label, w) in v.items():
        if a % every:
            continue
        s = sorted((-sum(p * q for p, q in zip(w, u)), i, y) for i, (y, u) in v.items() if i != a)
        for p, i, _ in [t for t in s if t[2] == label][:5]:
            fit = [t for t in s if t[2] != label and low * -p <= 100 * -t[0] <= high * -p][:10]
            out += [(a, i, k, j, -p, -n) for k, (n, j, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(df, every, **how):
    return sorted(tuple(r) for r in hn.hard_negatives(
        df, F.col("vec_id") % every == 0, **(SMALL | how)).collect())


def vectors(n, dims, seed, labels=3, clusters=0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(clusters)]
    rows = []
    for i in rng.sample(range(4 * n), n):
        base = rng.choice(centres) if clusters else [0.0] * dims
        rows.append((i, [b + rng.gauss(0, 0.2) for b in base], rng.randrange(labels)))
    return rows


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 1)])
def test_curve_visits_neighbouring_cells(dims, bits):
    cells = np.array(list(product(range(1 << bits), repeat=dims)))
    keys = [k.tobytes() for k in hn.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    along = cells[sorted(range(len(keys)), key=keys.__getitem__)]
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_every_product():
    rng = np.random.default_rng(5)
    for scale in (10, 1 << 40):
        rows = rng.integers(-scale, scale, (40, 6))
        anchors = rng.integers(-scale, scale, (9, 6)) // (1 if scale == 10 else 1 << 20)
        low, high = hn.bounds(anchors, rows.min(axis=0)[None], rows.max(axis=0)[None])
        for a, lo, hi in zip(anchors, low[:, 0], high[:, 0]):
            exact = [sum(int(p) * int(q) for p, q in zip(a, r)) for r in rows]
            assert lo <= min(exact) and max(exact) <= hi


def test_products_beyond_doubles():
    rows = np.array([[1 << 40, 1], [3, -(1 << 41)]])
    a = np.array([(1 << 20) + 1, 7])
    assert hn.products(rows, a).tolist() == [sum(int(x) * int(y) for x, y in zip(r, a))
                                             for r in rows]


@pytest.mark.parametrize("clusters", [0, 6])
def test_equals_brute_force(spark, clusters):
    rows = vectors(300, 5, clusters, clusters=clusters)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = brute(rows, 9)
    assert mined(df, 9) == want and len(want) > 100


def test_ties_hot_vector_and_labels(spark):
    rows = vectors(60, 3, 3) + [(1000 + i, [0.5, 0.25, -0.5], i % 4) for i in range(120)]
    assert mined(spark.createDataFrame(rows, SCHEMA), 10) == brute(rows, 10)


def test_rows_that_take_no_part_and_repeated_ids(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.25], 1), (2, [0.5, 0.25], 2), (3, [0.5, 0.5], 1),
            (None, [1.0, 1.0], 2), (4, None, 2), (5, [1.0, None], 2), (6, [nan, 1.0], 2),
            (7, [inf, 1.0], 2), (8, [0.6, 0.3], None), (2, [0.4, 0.2], 2), (3, [0.5, 0.5], 1),
            (9, [-1.0, -1.0], 1), (10, [0.3, 0.3], 0), (20, [0.0, 0.0], 1), (30, [], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute([r if r[1] != [] else (30, [0.0, 0.0], 1) for r in rows], 10)
    assert mined(df, 10) == want and want


def test_empty_table_no_anchor_no_other_label(spark):
    assert mined(spark.createDataFrame([], SCHEMA), 10) == []
    rows = [(i, [float(i), 1.0], 1) for i in range(1, 8)]
    assert mined(spark.createDataFrame(rows, SCHEMA), 10) == []
    assert mined(spark.createDataFrame(rows, SCHEMA), 1) == []
    with pytest.raises(ValueError):
        hn.hard_negatives(spark.createDataFrame([], SCHEMA), low=50, high=40)


def test_clashing_columns(spark):
    rows = vectors(40, 4, 8)
    df = clashing(spark.createDataFrame(rows, SCHEMA)).withColumns(
        {c: F.lit(1) for c in ("w", "r", "pos", "block", "tile", "shelf", "page", "asks", "ask",
                               "anchor_id", "positive_id", "ids", "lo", "hi", "v", "i")})
    assert mined(df, 5) == brute(rows, 5)


def test_far_blocks_are_not_read(spark):
    """Clusters far apart: the zone maps leave out most of the table."""
    rows = [(i, [1.0 * (c == d) + 0.001 * (i % 7) for d in range(4)], i % 2)
            for i, c in enumerate(sorted(list(range(4)) * 64))]
    zones = [(np.floor(256 * np.array([r[1] for r in rows[lo:lo + 64]]))) for lo in
             range(0, 256, 64)]
    a = zones[0][:1].astype(np.int64)
    low, high = hn.bounds(a, np.array([z.min(axis=0) for z in zones]),
                          np.array([z.max(axis=0) for z in zones]))
    best = int((zones[0] @ a[0]).min())
    assert (high[0] >= best).tolist() == [True, False, False, False]
    assert mined(spark.createDataFrame(rows, SCHEMA), 16, block_rows=32) == brute(rows, 16)
