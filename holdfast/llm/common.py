"""What the operators of this subpackage share: written intermediate tables,
word caches for the Python side, and exact connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from sys import getsizeof

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_WRITTEN: set[str] = set()         # folders written by materialize
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and read it back.

    A lost executor then re-reads files instead of running the job again, and
    the job's own shuffle files go as soon as it has ended.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _WRITTEN.discard(path)


def discard(*tables: DataFrame) -> None:
    """Delete written tables of which nothing lazy is left."""
    for t in tables:
        _delete(t.sparkSession, t.written_to)


def written() -> set[str]:
    """Folders of all written tables that still exist."""
    return set(_WRITTEN)


def discard_unread(paths: set[str], docs: DataFrame) -> None:
    """Delete those of the written ``paths`` from which ``docs`` does not read."""
    files = docs.inputFiles() if paths else []
    for path in list(paths):
        if not any(f"{path.split(':')[-1].lstrip('/')}/" in f for f in files):
            _delete(docs.sparkSession, path)
            paths.discard(path)


def with_ids(df: DataFrame, ids: DataFrame, key: str, max_bytes: int = 32 << 20) -> DataFrame:
    """Rows of ``df`` whose long ``key`` is among ``ids``.

    ``ids`` (a written table) is counted first: up to ``max_bytes`` of ids are
    sent to all tasks, so wide rows need no shuffle; more are joined by sort.
    """
    small = ids.count() * 16 <= max_bytes
    return df.join(F.broadcast(ids) if small else ids, key, "left_semi")


def set_apart(docs: DataFrame, *needed: str | None) -> tuple[DataFrame, Callable]:
    """``docs`` with all columns but the ``needed`` ones under generated names,
    so that none of them can clash with a name an operator uses, and a function
    that gives a result its names back.  Where a result has a column of an
    input column's name, the result's stays."""
    apart = {c: f"__kept_{i}" for i, c in enumerate(docs.columns) if c not in needed}

    def back(out: DataFrame) -> DataFrame:
        names = {v: k for k, v in apart.items()}
        own = {c for c in out.columns if c not in names}
        return out.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in out.columns
                            if names.get(c) not in own])

    return docs.withColumnsRenamed(apart), back


def values(column: pa.Array, at_once: int = 4 << 20) -> Iterator:
    """Python values of an Arrow column.  They are made for a few rows at a
    time, about ``at_once`` bytes of them, so a batch of long texts does not
    become Python strings as a whole; what Arrow has freed is given back."""
    n = len(column)
    step = max(1, n * at_once // max(1, column.nbytes))
    for lo in range(0, n, step):
        yield from column.slice(lo, step).to_pylist()
    pa.default_memory_pool().release_unused()


class WordCache(dict):
    """``cache[word]`` computes and keeps ``make(word)``.

    What is kept is bounded, in words and in bytes: beyond ``limit`` words or
    ``max_bytes`` the cache starts again.  Results never depend on what is
    cached.
    """

    def __init__(self, make, limit: int = 250_000, max_bytes: int = 64 << 20):
        super().__init__()
        self.make, self.limit, self.max_bytes, self.bytes = make, limit, max_bytes, 0

    def __missing__(self, word):
        value = self.make(word)
        self.bytes += 100 + getsizeof(word) + getsizeof(value)
        if len(self) >= self.limit or self.bytes > self.max_bytes:
            self.clear()
            self.bytes = 0
        self[word] = value
        return value


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` of the undirected ``edges``; the component is the
    smallest node in it.  Nodes without an edge are not listed.

    Alternates two steps on edges that lead from a node to a smaller one.  The
    large star replaces the smaller end of an edge by that node's smallest
    neighbour; the small star ties all smaller neighbours of a node, and
    itself, to the smallest.  Neither adds an edge or parts a component, and
    O(log(nodes) ** 2) rounds leave stars, whatever the graph (Kiveris et al.,
    "Connected components in MapReduce and beyond").  So there is no limit on
    the rounds: it ends when every component is a star.
    """
    e = materialize(edges.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y"))
                    .filter("x <> y").distinct(), "edges")
    while _not_stars(e):
        ends = e.select("x", F.col("y").alias("n")) \
            .unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("n")))
        least = ends.groupBy(F.col("x").alias("y")).agg(F.min("n").alias("m"))
        large = materialize(e.join(least, "y").select("x", F.least("y", "m").alias("y")).distinct(),
                            "edges")
        discard(e)
        down = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(down, "x").filter("y <> m") \
            .select(F.col("y").alias("x"), F.col("m").alias("y"))
        e = materialize(small.unionByName(down.select("x", F.col("m").alias("y"))).distinct(),
                        "edges")
        discard(large)
    return e.select(F.col("x").alias("node"), F.col("y").alias("component")) \
        .unionByName(e.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct())


def _not_stars(e: DataFrame) -> bool:
    """Whether a node has two smaller neighbours, or a smaller and a larger."""
    ends = e.select("x", F.lit(1).alias("down"), F.lit(0).alias("up")) \
        .unionByName(e.select(F.col("y").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return bool(ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
                .filter("down > 1 or (down = 1 and up = 1)").limit(1).count())
