"""N-gram Jaccard self-join, size-aware.

A document's set is its distinct five-word shingles (64-bit hashes).  Sets
link when 100 * |A & B| >= 75 * |A | B|.  Equal sets are one class, and the
join runs over classes:

* Small sets enumerate subsets of a fixed size.  For every size a partner can
  have, the overlap that a link needs is known; two linked small sets share a
  subset of that size, and sharing it proves the link.
* Large sets scan inverted lists.  In one global order of shingles (frequent
  ones last) a pair that needs an overlap of o shares one of the first
  n - o + 1 shingles of either, so only those are indexed, with their places.
  A pair is a candidate where both places are early enough for its own o.
  Parity bitmaps bound a candidate's overlap from above; those that may still
  link are checked on their whole sets.

The boundary between small and large is the size at which the enumeration
costs more than the lists, both taken from the histogram of sizes.

Long lists come from large groups of near copies.  Their members are first
checked against two pivots each; lists whose members are then connected are
done, and in the others only members of different components are paired.  So
no list is ever expanded into all its pairs, and no link that could join two
components is left out.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, discard, materialize, set_apart, values, with_ids

WORDS = 5
NUM, DEN = 75, 100                 # a link: DEN * overlap >= NUM * union
LONG_LIST = 32                     # lists beyond it go through pivots first
MAX_SMALL = 12                     # largest size the boundary may reach
HEAVY_HERE, HEAVY_ALL, HEAVY_MAX = 3, 16, 1 << 18

_P = 0x9E3779B97F4A7C15            # odd, so it has an inverse modulo 2**64
_LETTER = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``_P`` and of its inverse, up to ``n`` of them."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``words`` words; of the whole
    sequence, if it is shorter; none without words.

    The words, joined by single blanks, get one running polynomial hash; a
    shingle is a difference of two of its values.
    """
    if not text:
        return np.zeros(0, np.uint64)
    raw = b" ".join(text.encode("utf-8").lower().split())     # ASCII case and white space
    if not raw:
        return np.zeros(0, np.uint64)
    b = np.frombuffer(raw, np.uint8)
    up, down = _powers(len(b))
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[b] * up, dtype=np.uint64)])
    gaps = np.flatnonzero(b == 32)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.concatenate([gaps, [len(b)]])
    n = min(words, len(starts))
    s, e = starts[:len(starts) - n + 1], ends[n - 1:]
    return np.unique(_mixed((run[e] - run[s]) * down[s]))


def needed(n: int) -> int:
    """Least overlap with which a set of ``n`` can link to any set."""
    return -(-NUM * n // DEN)


def overlap(n: int, m: int) -> int:
    """Overlap that sets of ``n`` and ``m`` need to link."""
    return -(-NUM * (n + m) // (NUM + DEN))


def prefix_size(n: int) -> int:
    """Indexed shingles of a set of ``n``: enough for any partner."""
    return n - needed(n) + 1


def subset_sizes(n: int, below: int) -> set[int]:
    """Overlaps that a set of ``n`` needs with partners smaller than ``below``."""
    return {overlap(n, m) for m in range(needed(n), n * DEN // NUM + 1)
            if 0 < m < below}


def subset_cost(n: int, below: int) -> int:
    return sum(math.comb(n, c) for c in subset_sizes(n, below) if c <= n)


def boundary(sizes: dict[int, int]) -> int:
    """Sets below this size enumerate subsets.

    A set of n costs its subsets there, or here the prefix entries plus, for
    each, the entries of sets of linkable size it may meet.
    """
    best = 1
    for n in range(1, MAX_SMALL + 1):
        near = sum(sizes.get(m, 0) for m in range(needed(n), n * DEN // NUM + 1))
        lists = prefix_size(n) * (2 + math.log2(1 + near))
        if subset_cost(n, n + 1) > lists:
            break
        best = n + 1
    return best


def parity(s: np.ndarray) -> np.ndarray:
    """Bitmap of a set of n: bit i tells if an odd number of its values is i
    modulo the number of bits, a power of two of 2n or more."""
    bits = max(64, 1 << (2 * len(s)).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).view(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def may_link(n: int, x: np.ndarray, m: int, y: np.ndarray) -> bool:
    """False only if sets of ``n`` and ``m`` with those bitmaps can not link.

    Common values cancel, so bitmaps differ in at most as many places as there
    are values in just one of the sets.  The longer bitmap is folded first."""
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    spare = n + m - 2 * overlap(n, m)
    return overlap(n, m) <= min(n, m) and int(np.bitwise_count(x ^ y).sum()) <= spare


# --- passes over the texts --------------------------------------------------

def _long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64), pa.int64())


def _heavy(rows: DataFrame, text: str) -> np.ndarray:
    """Frequent shingles, for the global order only: any order gives the same
    links, this one keeps common passages out of the prefixes.  At most
    ``HEAVY_MAX`` values (2 MB), so they may be sent to all tasks."""

    def run(batches):
        seen, kept = [], 0

        def flush():
            h, n = np.unique(np.concatenate(seen), return_counts=True)
            some = n >= HEAVY_HERE
            return pa.RecordBatch.from_arrays(
                [_long(h[some]), pa.array(n[some].astype(np.int64))], ["h", "n"])

        for batch in batches:
            for t in values(batch.column(0)):
                seen.append(shingles(t))
                kept += len(seen[-1])
                if kept > 4_000_000:
                    yield flush()
                    seen, kept = [], 0
        if seen:
            yield flush()

    top = (rows.select(text).mapInArrow(run, "h long, n long").groupBy("h")
           .agg(F.sum("n").alias("n")).filter(F.col("n") >= HEAVY_ALL)
           .orderBy(F.desc("n"), "h").limit(HEAVY_MAX).collect())
    return np.sort(np.array([r["h"] for r in top], np.int64).view(np.uint64))


def _sets(rows: DataFrame, heavy: np.ndarray) -> DataFrame:
    """(id, n, sig, prefix) of (id, text) rows: size, identity and the first
    shingles in the global order; small sets whole."""
    cast = rows.sparkSession.sparkContext.broadcast(heavy)

    def run(batches):
        last = cast.value
        for batch in batches:
            n, sig, prefix = [], [], []
            for t in values(batch.column(1)):
                s = shingles(t)
                n.append(len(s))
                sig.append(xxhash.xxh3_128_digest(s.tobytes()))
                if len(last) and len(s):
                    at = np.minimum(np.searchsorted(last, s), len(last) - 1)
                    common = last[at] == s
                    s = np.concatenate([s[~common], s[common]])
                take = len(s) if len(s) <= MAX_SMALL else prefix_size(len(s))
                prefix.append(s[:take].view(np.int64).copy())     # not the whole set
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()),
                 pa.array(prefix, pa.list_(pa.int64()))], ["id", "n", "sig", "prefix"])

    return rows.mapInArrow(run, "id long, n long, sig binary, prefix array<long>")


def _of_ids(rows: DataFrame, ids: DataFrame, code) -> DataFrame:
    """(id, n, s) of the rows with those ids: the set's size and what ``code``
    makes of it, as bytes."""

    def run(batches):
        for batch in batches:
            n, coded = [], []
            for t in values(batch.column(1)):
                s = shingles(t)
                n.append(len(s))
                coded.append(code(s).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.binary())],
                ["id", "n", "s"])

    return with_ids(rows, ids, "id").select("id", "text") \
        .mapInArrow(run, "id long, n long, s binary")


def _hold(rows: DataFrame, pairs: DataFrame, name: str, code, test) -> DataFrame:
    """Those of the written ``pairs`` (a, b) for which ``test(n, s, m, t)``
    holds on what ``code`` makes of the two sets; written.  The pairs go."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    coded = materialize(_of_ids(rows, ids, code), f"{name}_sets")

    def run(batches):
        for batch in batches:
            yes = pa.array([test(n, s, m, t) for n, s, m, t in
                            zip(*(values(batch.column(i)) for i in range(2, 6)))], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(yes), batch.column(1).filter(yes)], ["a", "b"])

    side = lambda k: coded.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"),
                                  F.col("s").alias(f"s{k}"))
    out = materialize(pairs.join(side("a"), "a").join(side("b"), "b")
                      .select("a", "b", "na", "sa", "nb", "sb")
                      .mapInArrow(run, "a long, b long").distinct(), name)
    discard(pairs, ids, coded)
    return out


def _links(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the ``pairs`` (a, b) whose whole sets link, written."""

    def near(n, s, m, t):
        return may_link(n, np.frombuffer(s, np.uint8), m, np.frombuffer(t, np.uint8))

    def linked(n, s, m, t):
        both = len(np.intersect1d(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64),
                                  assume_unique=True))
        return both > 0 and DEN * both >= NUM * (n + m - both)

    close = _hold(rows, materialize(pairs, "pairs"), "close", parity, near)
    return _hold(rows, close, "links", lambda s: s, linked)


def _room(n: Column, at: Column) -> Column:
    """A common shingle at place ``at`` of a set of n is early enough for a
    partner of m, that is at <= n - overlap(n, m), if room >= NUM * m.  This
    also holds the sizes to those that can link."""
    return (NUM + DEN) * (n - at) - NUM * n


def _small_links(classes: DataFrame, below: int) -> DataFrame:
    """Links among sets smaller than ``below``: sets that share a subset of
    the size their two sizes ask for.  Sharing it is proof enough."""

    def run(batches):
        for batch in batches:
            ids, sizes, keys = [], [], []
            for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = np.sort(np.asarray(s, np.int64))
                n = len(v)
                for m in range(needed(n), n * DEN // NUM + 1):
                    c = overlap(n, m)
                    if not 0 < m < below or c > n:
                        continue
                    # both sizes are in the key: each pair of sizes has its own overlap
                    head = bytes([min(n, m), max(n, m)])
                    for part in itertools.combinations(v.tolist(), c):
                        ids.append(i)
                        sizes.append(n)
                        keys.append(head + xxhash.xxh3_128_digest(np.array(part, np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()),
                 pa.array(keys, pa.binary())], ["id", "size", "key"])

    subsets = (classes.filter((F.col("n") > 0) & (F.col("n") < below)).select("id", "prefix")
               .mapInArrow(run, "id long, size int, key binary"))
    # holders of one size link to all of the other: if both sizes are there, a
    # star to the least holder joins what these links join
    one_size = F.substring("key", 1, 1) == F.substring("key", 2, 1)
    first = (subsets.groupBy("key")
             .agg(F.min("id").alias("b"), F.max("id").alias("last"), F.min("size").alias("lo"),
                  F.max("size").alias("hi"))
             .filter((F.col("b") != F.col("last")) & ((F.col("lo") != F.col("hi")) | one_size))
             .select("key", "b"))
    return subsets.join(first, "key").filter("id <> b") \
        .select(F.col("id").alias("a"), "b").distinct()


# --- the join ---------------------------------------------------------------

def _components(rows: DataFrame, classes: DataFrame, below: int) -> DataFrame:
    """(node, component) of the classes that link to another one.  The written
    ``classes`` go as soon as nothing reads them."""
    entries = (classes.filter(F.col("n") >= needed(below))
               .select("id", "n", F.posexplode("prefix").alias("at", "h")))
    lists = Window.partitionBy("h")
    entries = materialize(
        entries.withColumn("size", F.count(F.lit(1)).over(lists)).filter("size > 1")
        .withColumn("p1", F.when(F.col("size") > LONG_LIST, F.min("id").over(lists)))
        .withColumn("p2", F.when(F.col("size") > LONG_LIST,
                                 F.min(F.struct(F.xxhash64("id"), "id")).over(lists)["id"])),
        "entries")
    # long lists: every member against two pivots
    stars = entries.filter("p1 is not null") \
        .select("id", "n", F.explode(F.array("p1", "p2")).alias("b")).filter("id <> b") \
        .select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b")).distinct()
    starred = _links(rows, stars)
    edges = materialize(_small_links(classes, below).unionByName(starred), "edges")
    discard(starred, classes)
    near = connected_components(edges)

    tagged = entries.select("h", "id", "n", _room(F.col("n"), F.col("at")).alias("room")).join(
        near.select(F.col("node").alias("id"), "component"), "id", "left") \
        .withColumn("component", F.coalesce("component", "id"))
    several = tagged.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")) \
        .filter("lo <> hi").select("h")
    tagged = materialize(tagged.join(several, "h", "left_semi"), "open_lists")
    discard(entries)
    # components that meet in a list, if any of their members can link there
    groups = tagged.groupBy("h", "component").agg(F.max("room").alias("room"), F.min("n").alias("n"))
    of = lambda df, k, *more: df.select(
        "h", F.col("component").alias(f"c{k}"), F.col("n").alias(f"n{k}"),
        F.col("room").alias(f"room{k}"), *more)
    fit = lambda a, b: (F.col(f"room{a}") >= NUM * F.col(f"n{b}"))
    meets = of(groups, "p").join(of(groups, "q"), "h") \
        .filter((F.col("cp") < F.col("cq")) & fit("p", "q") & fit("q", "p"))
    half = meets.select("h", F.col("cp").alias("ca"), F.col("cq").alias("cb"), "nq", "roomq") \
        .join(of(tagged, "a", F.col("id").alias("a")), ["h", "ca"]) \
        .filter(fit("a", "q") & fit("q", "a"))
    pairs = half.join(of(tagged, "b", F.col("id").alias("b")), ["h", "cb"]) \
        .filter(fit("a", "b") & fit("b", "a")).select("a", "b").distinct()
    found = _links(rows, pairs)
    discard(tagged)
    out = connected_components(edges.unionByName(found))
    discard(edges, found)
    return out


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row doc_id, n_shingles and component_id, the smallest doc_id that
    can be reached by links (its own without any).

    Null, empty and word-less texts have an empty set and link with nothing.
    Rows that share an id are one document with several texts; rows without an
    id link with nothing and have a null component_id.  Equal sets link
    whatever the texts' case and white space.  An empty table gives no row;
    other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    sets = materialize(_sets(rows, _heavy(rows, "text")), "sets")
    linkable = sets.filter("n > 0 and id is not null")
    # equal sets are one class, named by its smallest id; its rows agree in n
    # and prefix, so any of them will do
    classes = materialize(linkable.groupBy("sig").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
        .drop("sig"), "classes")
    # from here on the prefixes are only needed once per class
    wide, sets = sets, materialize(sets.drop("prefix"), "sizes")
    discard(wide)
    linkable = sets.filter("n > 0 and id is not null")
    named = linkable.groupBy("sig").agg(F.min("id").alias("rep"))
    sizes = {r["n"]: r["count"] for r in
             classes.filter(F.col("n") <= 2 * MAX_SMALL).groupBy("n").count().collect()}
    comps = _components(rows, classes, boundary(sizes))
    # an id may stand in several classes (repeated ids): join them through it
    member = linkable.join(named, "sig").select("id", F.col("rep").alias("node")) \
        .join(comps, "node", "left") \
        .select("id", F.coalesce("component", "node").alias("component")).distinct()
    twice = member.groupBy("id").agg(F.min("component").alias("b"), F.max("component").alias("a"),
                                     F.count(F.lit(1)).alias("k"))
    own = twice.select("id", F.col("b").alias("component"))
    tied = twice.filter("k > 1")
    if tied.limit(1).count():
        more = member.join(tied.select("id", "b"), "id").filter("component <> b") \
            .select(F.col("component").alias("a"), "b").distinct()
        again = connected_components(more)
        own = own.join(again.select(F.col("node").alias("component"),
                                    F.col("component").alias("up")), "component", "left") \
            .select("id", F.coalesce("up", "component").alias("component"))
    return sets.select("id", "n").join(own, "id", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"))


def one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the near copies: of every component the document with
    the smallest id stays.  Repeated rows of one document stay together;
    documents without words and rows without an id all stay."""
    docs, back = set_apart(docs, doc_id, text)
    comps = components(docs, doc_id, text).filter("doc_id <> component_id") \
        .select(F.col("doc_id").alias("__gone")).distinct()
    return back(docs.join(comps, F.col(doc_id) == F.col("__gone"), "left_anti"))
