"""Connected components on graphs that are hard for label passing."""

import random

import pytest
from pyspark.sql import functions as F

from holdfast.llm import ngram_join
from holdfast.llm.common import connected_components
from tests.llm.helpers import documents


def brute(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for a, b in edges:
        if a != b:
            lo, hi = sorted((root(a), root(b)))
            up[hi] = lo
    return {x: root(x) for x in up}


def found(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    rows = connected_components(df).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.component for r in rows}


def shuffled(n, seed):
    ids = list(range(n))
    random.Random(seed).shuffle(ids)
    return ids


def chain(n, seed):
    ids = shuffled(n, seed)
    return list(zip(ids, ids[1:]))


def test_shuffled_chain_of_ten_thousand(spark):
    edges = chain(10_000, 1)
    assert found(spark, edges) == dict.fromkeys(range(10_000), 0)


def test_grid_and_star_of_chains(spark):
    at = shuffled(900, 2)
    grid = [(at[30 * i + j], at[30 * i + j + 1]) for i in range(30) for j in range(29)] \
        + [(at[30 * i + j], at[30 * i + j + 30]) for i in range(29) for j in range(30)]
    arms = [(1000 + a, 1000 + b) for a, b in chain(500, 3) if a % 25 and b % 25]
    hub = [(5000, 1000 + i) for i in range(0, 500, 7)]
    edges = grid + arms + hub
    assert found(spark, edges) == brute(edges)


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(120 + 80 * seed)]
    assert found(spark, edges) == brute(edges)


def test_no_edges_loops_and_repeats(spark):
    assert found(spark, []) == {}
    assert found(spark, [(3, 3), (5, 4), (4, 5), (5, 4)]) == {4: 4, 5: 4}


def test_chain_of_versions_is_one_group(spark):
    """Each document links only to the next one; the ids are shuffled."""
    n = 300
    words = [f"w{i}" for i in range(10 * n + 60)]
    ids = shuffled(n, 4)
    texts = [(ids[i], " ".join(words[4 * i:4 * i + 60])) for i in range(n)]
    out = ngram_join.components(documents(spark, texts)).select(
        F.countDistinct("component_id"), F.min("component_id"), F.count("*")).first()
    assert tuple(out) == (1, 0, n)
