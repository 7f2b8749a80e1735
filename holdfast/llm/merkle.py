"""Merkle manifest of a dataset, built by a butterfly exchange.

Every row is a leaf.  The leaves of a group are numbered in key order and cut
into aligned blocks of ``fanout ** block_levels``; a block's tree is built in
one task.  Blocks then play the partitions of a butterfly: in round ``r`` the
blocks under ``fanout`` sibling nodes swap the roots of their subtrees, and
every block hashes the ancestor it shares with its partners itself.  After
``log(blocks)`` rounds each block knows the group's root and all siblings on
its way up, so nothing is sent down the tree.  The group roots form one more
tree, made the same way.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranking import row_number_global
from .common import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_WRITE_EVERY = 8                   # rounds between two written states


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon, value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest(values: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 of the values' fields, concatenated."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def fold(leaf: Column, left: Column, right: Column) -> Column:
    """The root to which ``leaf`` leads with the given siblings.

    ``left`` and ``right`` hold, level by level from the leaves, the
    concatenated digests of the siblings before and after the node.
    """
    return F.aggregate(F.arrays_zip(left.alias("l"), right.alias("r")), leaf,
                       lambda node, s: F.sha2(F.concat(s["l"], node, s["r"]), 256))


def siblings(left: Column, right: Column) -> Column:
    """All sibling digests of a path in one string, from the leaves up."""
    return F.concat_ws("", F.transform(F.arrays_zip(left.alias("l"), right.alias("r")),
                                       lambda s: F.concat(s["l"], s["r"])))


def climb(digests: list[str], fanout: int, levels: int
          ) -> tuple[list[list[str]], list[list[str]], int, str, str]:
    """The tree over one block's digests, ``levels`` high.

    Returns per leaf the siblings before and after it on every level, the
    level on which a single node was left, that node, and the node of the top
    level (from a single node on, each level hashes it alone).
    """
    left: list[list[str]] = [[] for _ in digests]
    right: list[list[str]] = [[] for _ in digests]
    nodes, span, single, lone = digests, 1, 0 if len(digests) == 1 else levels, digests[0]
    for level in range(levels):
        above = []
        for lo in range(0, len(nodes), fanout):
            run = nodes[lo:lo + fanout]
            above.append(sha256("".join(run).encode()).hexdigest())
            for i in range(len(run)):
                before, after = "".join(run[:i]), "".join(run[i + 1:])
                for leaf in range((lo + i) * span, min((lo + i + 1) * span, len(digests))):
                    left[leaf].append(before)
                    right[leaf].append(after)
        if len(nodes) > 1 and len(above) == 1:
            single, lone = level + 1, above[0]
        nodes, span = above, span * fanout
    return left, right, single, lone, nodes[0]


def butterfly(blocks: DataFrame, fanout: int) -> DataFrame:
    """(grp, block, blocks, digest, left, right) from block roots
    (grp, block, lone, top): digest is the group's root, left and right are
    the siblings above the block.  Every block takes part in every round and
    gets at most ``fanout - 1`` digests from others."""
    counts = blocks.groupBy("grp").agg((F.max("block") + 1).alias("blocks"))
    none = F.array().cast("array<string>")
    state = materialize(
        blocks.join(counts, "grp")
        .select("grp", "block", "blocks",
                F.when(F.col("blocks") == 1, F.col("lone")).otherwise(F.col("top"))
                .alias("digest"), none.alias("left"), none.alias("right")), "merkle-blocks")
    most = state.agg(F.max("blocks")).first()[0] or 1
    span, rounds = 1, 0
    while span < most:
        state = _swap(state, span, fanout)
        span, rounds = span * fanout, rounds + 1
        if span >= most or rounds % _WRITE_EVERY == 0:
            state = materialize(state, "merkle-round")
    return state


def _swap(state: DataFrame, span: int, fanout: int) -> DataFrame:
    """One round: nodes cover ``span`` blocks each; a block sends its node's
    digest to one partner under every sibling node, or to several under a
    sibling that covers more blocks than its own node does."""
    node, last = f"(block div {span})", f"((blocks - 1) div {span})"
    first = f"({node} - {node} % {fanout})"
    size = f"least({span}L, blocks - {node} * {span})"
    to = F.expr(f"""
        flatten(transform(sequence({first}, least({first} + {fanout - 1}, {last})), t ->
            CASE WHEN t = {node} THEN array(block)
                 WHEN t * {span} + block % {span} < least((t + 1) * {span}, blocks)
                 THEN sequence(t * {span} + block % {span},
                               least((t + 1) * {span}, blocks) - 1, {size})
                 ELSE cast(array() AS array<bigint>) END))""")
    own = F.col("to") == F.col("block")
    sent = (state.select("*", F.explode(to).alias("to"))
            .select("grp", "to", "blocks", F.expr(node).alias("node"), "digest",
                    F.when(own, F.col("left")).alias("left"),
                    F.when(own, F.col("right")).alias("right")))
    got = sent.groupBy("grp", F.col("to").alias("block")).agg(
        F.max("blocks").alias("blocks"), F.max("left").alias("left"),
        F.max("right").alias("right"),
        F.sort_array(F.collect_list(F.struct("node", "digest"))).alias("run"))
    me = F.expr(node)
    joined = lambda part: F.concat_ws("", F.transform(part, lambda n: n["digest"]))
    more = F.expr(f"{last} > 0")                 # else the group has its root already
    return got.select(
        "grp", "block", "blocks",
        F.when(more, F.sha2(joined(F.col("run")), 256)).otherwise(F.col("run")[0]["digest"])
        .alias("digest"),
        *[F.when(more, F.concat(side, F.array(joined(F.filter("run", keep))))).otherwise(F.col(side))
          .alias(side)
          for side, keep in (("left", lambda n: n["node"] < me),
                             ("right", lambda n: n["node"] > me))])


def trees(leaves: DataFrame, fanout: int, block_levels: int) -> tuple[DataFrame, DataFrame]:
    """One tree per ``grp`` over ``leaves`` (grp string, pos long from 0, leaf
    string, kept).

    Returns the leaves with block, left and right (siblings inside the block)
    and single (levels of a block that is alone), and the blocks as
    :func:`butterfly` gives them.  Both are written tables.
    """
    size = fanout ** block_levels
    rows = leaves.withColumn("block", F.expr(f"pos div {size}"))
    texts = T.ArrayType(T.StringType())
    schema = T.StructType([*rows.schema, T.StructField("left", texts),
                           T.StructField("right", texts), T.StructField("single", T.IntegerType()),
                           T.StructField("lone", T.StringType()),
                           T.StructField("top", T.StringType())])

    def build(table: pa.Table) -> pa.Table:
        table = table.take(np.argsort(table.column("pos").to_numpy(), kind="stable"))
        left, right, single, lone, top = climb(table.column("leaf").to_pylist(), fanout,
                                               block_levels)
        n, texts = len(left), pa.list_(pa.string())
        for name, values, kind in (("left", left, texts), ("right", right, texts),
                                   ("single", [single] * n, pa.int32()),
                                   ("lone", [lone] * n, pa.string()),
                                   ("top", [top] * n, pa.string())):
            table = table.append_column(name, pa.array(values, kind))
        return table

    rows = materialize(rows.groupBy("grp", "block").applyInArrow(build, schema), "merkle-leaves")
    roots = rows.filter(F.col("pos") % size == 0).select("grp", "block", "lone", "top")
    return rows.drop("lone", "top"), butterfly(roots, fanout)


def _upwards(rows: DataFrame, blocks: DataFrame, *more: str) -> DataFrame:
    """(grp, kept, left, right, tip) and the blocks' columns ``more``: whole
    paths of the leaves and the root of their tree."""
    up = blocks.select("grp", "block", "blocks", F.col("digest").alias("tip"),
                       F.col("left").alias("up_left"), F.col("right").alias("up_right"), *more)
    path = lambda side: F.concat(                                        # noqa: E731
        F.when(F.col("blocks") == 1, F.slice(side, F.lit(1), F.col("single")))
        .otherwise(F.col(side)), F.col(f"up_{side}")).alias(side)
    return rows.join(up, ["grp", "block"]).select("kept", path("left"), path("right"), "tip", *more)


def manifest(leaves: DataFrame, fanout: int = 2, block_levels: int = 10) -> DataFrame:
    """Proof of every leaf in the two-storey tree.

    ``leaves`` holds grp (any atomic type), key and leaf (lowercase hex
    digest); more columns are returned as they are, but for those named like a
    result column.  Within a group leaves ascend by key, nulls first; rows that
    share a key ascend by leaf, and equal rows are leaves of their own.  Groups
    ascend by their text's UTF-8 bytes, null first.  While several nodes
    remain, every ``fanout`` consecutive ones (the last run: what is left, even
    one) become the SHA-256 of their concatenated hex digests.

    Returns the columns of ``leaves`` with left and right (siblings before and
    after the node on every level, from the leaf to the root), subroot and
    root.  An empty table gives no rows.
    """
    if fanout < 2:
        raise ValueError("fanout must be 2 at least")
    kept = [c for c in leaves.columns if c not in ("left", "right", "subroot", "root")]
    # written with a row number: equal rows can then be dealt out, and texts are hashed once
    rows = materialize(leaves.select(
        F.coalesce(F.concat(F.lit("="), F.col("grp").cast("string")), F.lit("")).alias("grp"),
        "key", "leaf", F.struct(*kept).alias("kept"),
        F.monotonically_increasing_id().alias("row")), "merkle-input")
    rows = row_number_global(rows, [F.col("key").asc_nulls_first(), F.col("leaf"), F.col("row")],
                             "pos", by=["grp"])
    low, blocks = trees(rows.select("grp", (F.col("pos") - 1).alias("pos"), "leaf", "kept"),
                        fanout, block_levels)

    tips = blocks.filter("block = 0").select("grp", F.col("digest").alias("leaf"))
    tips = row_number_global(tips, [F.col("grp")], "pos").select(
        F.lit("").alias("grp"), (F.col("pos") - 1).alias("pos"), "leaf",
        F.struct("grp").alias("kept"))
    top = _upwards(*trees(tips, fanout, block_levels)).select(
        F.col("kept.grp").alias("grp"), F.col("left").alias("top_left"),
        F.col("right").alias("top_right"), F.col("tip").alias("root"))
    # joined to blocks, not to leaves: a group may hold most leaves, but few of the blocks
    paths = materialize(blocks.join(top, "grp").select(
        "grp", "block", "blocks", "digest", "root", F.concat("left", "top_left").alias("left"),
        F.concat("right", "top_right").alias("right")), "merkle-paths")
    return _upwards(low, paths, "root").select(
        "kept.*", "left", "right", F.col("tip").alias("subroot"), "root")


def verify(docs: DataFrame, tampered: Column, fanout: int = 2, block_levels: int = 10) -> DataFrame:
    """The manifest of ``documents`` and a check of every row's proof.

    Leaves are digests of doc_id, source, lang, n_chars and text, grouped by
    lang.  ``tampered`` tells where the row that is checked differs from the
    row in the manifest: its n_chars is one higher (null stays null).  Returns
    doc_id, leaf, subroot, root, proof_sha256 (all siblings on the way up),
    folded_root (what the checked row leads to) and verified.  Other columns
    are not read; nulls in any column have a digest of their own.
    """
    changed = F.when(F.col("n_chars") < (1 << 63) - 1, F.col("n_chars") + 1)
    values = lambda n: [n if c == "n_chars" else F.col(c) for c in FIELDS]
    leaves = docs.select(
        F.col("lang").alias("grp"), F.col("doc_id").alias("key"),
        digest(values(F.col("n_chars"))).alias("leaf"),
        F.when(F.coalesce(tampered, F.lit(False)), digest(values(changed))).alias("checked"))
    proofs = manifest(leaves, fanout, block_levels)
    return proofs.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root",
        F.sha2(siblings(F.col("left"), F.col("right")), 256).alias("proof_sha256"),
        fold(F.coalesce("checked", "leaf"), F.col("left"), F.col("right")).alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))
