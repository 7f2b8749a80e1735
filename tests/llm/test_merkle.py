"""The Merkle manifest against a tree built in plain Python."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from holdfast.llm import merkle
from tests.llm.helpers import SCHEMA, clashing, given


def h(s):
    return sha256(s.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(row, more=0):
    i, text, lang, source, n = row
    return h("".join(map(enc, (i, source, lang, None if n is None else n + more, text))))


def grow(nodes, fanout):
    """The root and, per leaf, its (before, after) siblings level by level."""
    paths, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, below = [], []
        for lo in range(0, len(nodes), fanout):
            run = nodes[lo:lo + fanout]
            up.append(h("".join(run)))
            below.append([x for u in under[lo:lo + fanout] for x in u])
            for i in range(len(run)):
                for x in under[lo + i]:
                    paths[x].append(("".join(run[:i]), "".join(run[i + 1:])))
        nodes, under = up, below
    return nodes[0], paths


def brute(rows, fanout=2):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda g: b"" if g is None else b"=" + g.encode())
    trees = {}
    for g in langs:
        members = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = (members, *grow([leaf_of(r) for r in members], fanout))
    root, tops = grow([trees[g][1] for g in langs], fanout)
    out = []
    for g, top in zip(langs, tops):
        members, subroot, paths = trees[g]
        for r, path in zip(members, paths):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf_of(r, int(bad))
            for before, after in path + top:
                node = h(before + node + after)
            out.append((r[0], leaf_of(r), subroot, root,
                        h("".join(a + b for a, b in path + top)), node, node == root))
    return sorted(out, key=repr)


def got(spark, df, **how):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return sorted((tuple(r) for r in merkle.verify(df, tampered, **how).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
        .collect()), key=repr)


def made(n, seed, langs):
    rng = random.Random(seed)
    ids = rng.sample(range(10 * n), n)
    return [(i, rng.choice([None, "", "grüße\n", "x" * 50, str(i)]), rng.choice(langs),
             rng.choice([None, "src0", "a:b"]), rng.choice([None, 0, 9, 10])) for i in ids]


@pytest.mark.parametrize("fanout,levels", [(2, 0), (2, 2), (3, 1), (5, 2), (2, 10)])
def test_equals_plain_tree(spark, fanout, levels):
    rows = made(83, fanout, ["en"] * 5 + ["de", "fr", "ä", "", None])
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(spark, df, fanout=fanout, block_levels=levels) == brute(rows, fanout)


def test_many_groups_and_every_size(spark):
    rows = [(100 * g + i, f"t{i}", f"l{g:02}", None, i) for g in range(1, 20) for i in range(g)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(spark, df, block_levels=1) == brute(rows)


def test_given_documents(spark):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"])
            for r in given("documents")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = got(spark, df, block_levels=3)
    assert out == brute(rows)
    bad = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 7 == 0}
    assert {r[0] for r in out if not r[-1]} == bad and bad


def test_ties_repeated_rows_null_keys(spark):
    rows = [(5, "a", "en", None, 1)] * 5 + [(5, "b", "en", None, 1), (None, "c", "en", None, None),
                                            (None, None, None, None, None)] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(spark, df, block_levels=1) == brute(rows)


def test_one_row_and_none(spark):
    rows = [(3, "only", "en", "s", 4)]
    one = got(spark, spark.createDataFrame(rows, SCHEMA))
    assert one == brute(rows)
    assert one[0][1] == one[0][2] == one[0][3] and one[0][4] == h("")
    assert got(spark, spark.createDataFrame([], SCHEMA)) == []


def test_a_long_text(spark):
    rows = [(1, "é" * 300_000, "en", "s", 300_000), (2, "", "en", "s", 0)]
    assert got(spark, spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_clashing_columns(spark):
    rows = made(20, 1, ["en", "de"])
    df = clashing(spark.createDataFrame(rows, SCHEMA)).withColumns(
        {c: F.lit(1) for c in ("grp", "pos", "leaf", "block", "kept", "row", "left", "right",
                               "subroot", "root", "single", "lone", "top", "tip", "checked")})
    assert got(spark, df, block_levels=1) == brute(rows)
    leaves = df.drop("leaf", "key", "grp").select(
        "*", F.col("lang").alias("grp"), F.col("doc_id").alias("key"),
        F.coalesce(F.sha2("text", 256), F.lit("")).alias("leaf"))
    out = merkle.manifest(leaves, block_levels=1)
    assert out.count() == 20 and {"pos", "block", "kept", "left", "root"} <= set(out.columns)
    assert len(out.columns) == len(set(out.columns))


def test_fanout_is_checked(spark):
    with pytest.raises(ValueError):
        merkle.manifest(spark.createDataFrame([], "grp string, key long, leaf string"), fanout=1)
