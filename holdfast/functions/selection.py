"""Exact order statistics without sorting the rows.

NTILE, quantile bins, medians and "first n by key" need only the rows at a few
ranks.  Those are found by counting: splitters from a small random sample cut
an interval of values, one aggregation counts the rows between and on the
splitters, and only the bins that hold an asked rank stay open.  A splitter is
a bin of its own, so a hot value is settled by its count; within one value the
same is done on the unique key.  Open bins shrink some hundredfold a round;
one of ``AT_ONCE`` rows or fewer is aggregated by value and read off.

What reaches the driver is bounded by the number of asked ranks and
splitters.  Rows are then classed by comparing them with the boundary rows:
no row is shuffled, written or joined for that.

The functions run small jobs when they are called.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AT_ONCE = 100_000          # rows of a bin that are aggregated by value as they are
SAMPLE, SPLITTERS = 4_000, 255
_EXACT_AS_DOUBLE = {"tinyint", "smallint", "int", "float", "double"}


class Found(NamedTuple):
    """The value at a rank, rows before its first one, rows that have it."""

    value: Any
    before: int
    n: int


class _Open(NamedTuple):
    by: int
    lo: Any                # least and greatest value of the interval
    hi: Any
    before: int            # rows before it
    n: int
    ranks: tuple[int, ...]


def _place(opened: Sequence[_Open]) -> Column:
    """Number of the interval that a (by, v) row lies in."""
    at = F.lit(None).cast("int")
    for i, o in enumerate(opened):
        at = F.when((F.col("by") == o.by) & (F.col("v") >= o.lo) & (F.col("v") <= o.hi),
                    F.lit(i)).otherwise(at)
    return at


def _bin(cuts: Column, size: Column) -> Column:
    """2 x (cuts below v), one more if v is a cut; ``cuts`` ascend."""
    steps = F.lit([1 << b for b in range(SPLITTERS.bit_length(), -1, -1)])
    v = F.col("v")
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= size) & (F.get(cuts, at + step - 1) < v), at + step).otherwise(at))
    return 2 * below + F.coalesce((F.get(cuts, below) == v).cast("int"), F.lit(0))


def select(rows: DataFrame, asks: dict[int, Callable[[int], Sequence[int]]],
           at_once: int | None = None) -> dict[int, tuple[int, dict[int, Found]]]:
    """Exact values at ranks (from 1) per ``by`` of ``rows`` (by int, v).

    ``asks`` gives the wanted ranks from the number of rows.  NULL values come
    first.  Returns per by the number of rows and what was found; a by without
    rows is missing.
    """
    at_once = AT_ONCE if at_once is None else at_once
    kind = rows.schema["v"].dataType.simpleString()
    out: dict[int, tuple[int, dict[int, Found]]] = {}
    opened: list[_Open] = []
    for r in rows.groupBy("by").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("k"),
                                    F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
        if r["by"] not in asks:
            continue
        found: dict[int, Found] = {}
        out[r["by"]] = (r["n"], found)
        nulls = r["n"] - r["k"]
        ranks = sorted(set(asks[r["by"]](r["n"])))
        found.update({x: Found(None, 0, nulls) for x in ranks if x <= nulls})
        o = _Open(r["by"], r["lo"], r["hi"], nulls, r["k"], tuple(x for x in ranks if x > nulls))
        _settle(o, found, opened)

    while opened:
        small = [o for o in opened if o.n <= at_once]
        large = [o for o in opened if o.n > at_once]
        opened = []
        if small:
            ranks = F.lit([[x - o.before for x in o.ranks] for o in small])
            cum = F.sum("n").over(Window.partitionBy("i").orderBy("v"))
            got = (rows.select(_place(small).alias("i"), "v").filter("i IS NOT NULL")
                   .groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("cum", cum)
                   .filter(F.exists(F.get(ranks, "i"), lambda x: (x > F.col("cum") - F.col("n"))
                                    & (x <= F.col("cum")))))
            for r in got.collect():
                o, last = small[r["i"]], r["cum"]
                for x in o.ranks:
                    if last - r["n"] < x - o.before <= last:
                        out[o.by][1][x] = Found(r["v"], o.before + last - r["n"], r["n"])
        if large:
            opened += _cut(rows, large, kind, out)
    return out


def _settle(o: _Open, found: dict[int, Found], opened: list[_Open]) -> None:
    """A one-valued interval answers its ranks, another one stays open."""
    if not o.ranks:
        return
    if o.lo == o.hi:
        found.update({x: Found(o.lo, o.before, o.n) for x in o.ranks})
    else:
        opened.append(o)


def _bins(rows: DataFrame, large: Sequence, kind: str, counts: Sequence[Column]) -> list:
    """The intervals cut at splitters: rows i, b, least and greatest value and
    ``counts``, in order."""
    within = rows.withColumn("i", _place(large)).filter("i IS NOT NULL")
    share = F.get(F.lit([SAMPLE / o.n for o in large]), "i")
    cuts: list[set] = [{o.lo} for o in large]          # at least one, so each round gains
    seen: list[list] = [[] for _ in large]
    for r in within.filter(F.rand() < share).collect():    # about SAMPLE per interval
        seen[r["i"]].append(r["v"])
    for i, some in enumerate(seen):
        some.sort()
        step = len(some) / SPLITTERS
        cuts[i] |= {some[int(j * step)] for j in range(SPLITTERS)} if some else set()
    lists = [sorted(c)[:SPLITTERS + 1] for c in cuts]
    bounds = F.get(F.lit(lists).cast(f"array<array<{kind}>>"), "i")
    size = F.get(F.lit([len(c) for c in lists]), "i")
    bins = within.groupBy("i", _bin(bounds, size).alias("b")).agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), *counts)
    return sorted(bins.collect(), key=lambda r: (r["i"], r["b"]))


def _cut(rows: DataFrame, large: list[_Open], kind: str, out: dict) -> list[_Open]:
    """The parts of the intervals in which asked ranks lie."""
    opened: list[_Open] = []
    before = [o.before for o in large]
    for r in _bins(rows, large, kind, [F.count(F.lit(1)).alias("n")]):
        o, start = large[r["i"]], before[r["i"]]
        before[r["i"]] += r["n"]
        ranks = tuple(x for x in o.ranks if start < x <= start + r["n"])
        _settle(_Open(o.by, r["lo"], r["hi"], start, r["n"], ranks), out[o.by][1], opened)
    return opened


class Ranked(NamedTuple):
    """Classes of the rows in ``value`` order (ties by key): ``of(rank, n)``
    must not fall as the rank rises."""

    value: str
    out: str
    of: Callable[[int, int], int]
    descending: bool = False


def ntile(buckets: int) -> Callable[[int, int], int]:
    """SQL NTILE as a class of the rank."""
    def of(rank: int, n: int) -> int:
        q, more = divmod(n, buckets)
        if rank <= more * (q + 1):
            return (rank - 1) // (q + 1) + 1
        return more + (rank - 1 - more * (q + 1)) // q + 1
    return of


def _last_ranks(of: Callable[[int, int], int], n: int) -> list[int]:
    """Last rank of every class but the greatest."""
    out, lo = [], 1
    while lo <= n:
        c, hi = of(lo, n), n
        while lo < hi:                     # greatest rank of class c
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if of(mid, n) == c else (lo, mid - 1)
        if lo < n:
            out.append(lo)
        lo += 1
    return out


def with_classes(df: DataFrame, specs: Sequence[Ranked], key: str,
                 at_once: int | None = None) -> DataFrame:
    """``df`` with an integer column per spec; ``key`` is unique and breaks
    ties, NULL values come first (last where ``descending``).  Numeric values
    where ``descending``."""
    v = lambda s: -F.col(s.value) if s.descending else F.col(s.value)     # noqa: E731
    parts = [df.select(v(s).alias("v")) for s in specs]
    alike = all(p.schema["v"].dataType.simpleString() in _EXACT_AS_DOUBLE for p in parts)
    groups = [list(range(len(specs)))] if alike else [[i] for i in range(len(specs))]
    found: dict[int, tuple[int, dict[int, Found]]] = {}
    rank = lambda s: lambda n: _last_ranks(s.of, n)                       # noqa: E731
    for group in groups:
        each = [F.struct(F.lit(i).alias("by"), (v(specs[i]).cast("double") if alike else
                                                v(specs[i])).alias("v")) for i in group]
        found |= select(df.select(F.inline(F.array(*each))),
                        {i: rank(specs[i]) for i in group}, at_once)

    # the boundary row's key among the rows that share its value
    wanted = [(i, x, f) for i, (_, got) in sorted(found.items()) for x, f in sorted(got.items())]
    held = [F.struct(F.lit(t).alias("by"), F.col(key).alias("v"),
                     v(specs[i]).eqNullSafe(F.lit(f.value)).alias("mine"))
            for t, (i, x, f) in enumerate(wanted)]
    keys = select(df.select(F.inline(F.array(*held))).filter("mine").select("by", "v"),
                  {t: (lambda n, r=x - f.before: [r]) for t, (i, x, f) in enumerate(wanted)},
                  at_once) if wanted else {}

    columns = {}
    for i, s in enumerate(specs):
        n = found[i][0] if i in found else 0
        c = F.lit(s.of(1, n) if n else None).cast("int")
        for t, (j, x, f) in enumerate(wanted):
            if j == i:
                (k,) = keys[t][1].values()
                same = v(s).eqNullSafe(F.lit(f.value)) & (F.col(key) > F.lit(k.value))
                after = v(s).isNotNull() if f.value is None else \
                    F.coalesce(v(s) > F.lit(f.value), F.lit(False))
                c = F.when(same | after, F.lit(s.of(x + 1, n))).otherwise(c)
        columns[s.out] = c
    return df.withColumns(columns)


def quantiles(df: DataFrame, shares: dict[str, Sequence[float]],
              at_once: int | None = None) -> dict[str, list[float | None]]:
    """Exact quantiles of numeric columns, linear between neighbours; NULLs do
    not count, a column without values has None."""
    names = list(shares)
    each = [F.struct(F.lit(i).alias("by"), F.col(c).cast("double").alias("v"))
            for i, c in enumerate(names)]
    rows = df.select(F.inline(F.array(*each))).filter("v IS NOT NULL")

    def ranks(ps):
        return lambda n: [r for p in ps for r in (int((n - 1) * p) + 1,
                                                  min(int((n - 1) * p) + 2, n))]

    got = select(rows, {i: ranks(shares[c]) for i, c in enumerate(names)}, at_once)
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(names):
        n, found = got.get(i, (0, {}))
        out[c] = []
        for p in shares[c]:
            if not n:
                out[c].append(None)
                continue
            at = (n - 1) * p
            lo = int(at)
            a, b = found[lo + 1].value, found[min(lo + 2, n)].value
            out[c].append(a if a == b or at == lo else (lo + 1 - at) * a + (at - lo) * b)
    return out


class _Shared(NamedTuple):
    by: int
    lo: Any                # least and greatest value of the interval
    hi: Any
    n: int                 # rows of all parts
    before: tuple[int, ...]              # per set: rows before the interval
    ranks: tuple[tuple[int, ...], ...]   # per set


def _asked(ranks: Column, last: Column, n: Column) -> Column:
    """Whether one of ``ranks`` is among the ``n`` that end with ``last``."""
    return F.exists(ranks, lambda x: (x > last - n) & (x <= last))


def quantiles_left_out(df: DataFrame, shares: dict[str, float], part: str, parts: int,
                       at_once: int | None = None) -> list[dict[str, float | None]]:
    """:func:`quantiles` of all rows, and of the rows outside of each part.

    ``part`` numbers the parts from 0 and is never NULL.  All sets are counted
    in the same passes: a row is placed once and counted for every set it is
    in, and the sets share the open intervals, since their quantiles lie close
    together.
    """
    at_once = AT_ONCE if at_once is None else at_once
    names, sets = list(shares), range(parts + 1)
    each = [F.struct(F.lit(i).alias("by"), F.col(c).cast("double").alias("v"))
            for i, c in enumerate(names)]
    rows = df.select(F.col(part).alias("part"), F.inline(F.array(*each))).filter("v IS NOT NULL")
    counts = [F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("n0"),
              *[F.count_if(F.col("part") != k).alias(f"n{k + 1}") for k in range(parts)]]
    sizes: dict[tuple[int, int], int] = {}
    found: dict[tuple[int, int, int], Any] = {}
    opened: list[_Shared] = []

    def settle(o: _Shared) -> None:
        if o.lo == o.hi:
            found.update({(o.by, s, x): o.lo for s in sets for x in o.ranks[s]})
        elif any(o.ranks):
            opened.append(o)

    for r in rows.groupBy("by").agg(F.min("v").alias("lo"), F.max("v").alias("hi"),
                                    *counts).collect():
        ranks = []
        for s in sets:
            n = sizes[r["by"], s] = r[f"n{s}"]
            at = int((n - 1) * shares[names[r["by"]]])
            ranks.append(tuple(sorted({at + 1, min(at + 2, n)})) if n else ())
        settle(_Shared(r["by"], r["lo"], r["hi"], r["n"], (0,) * len(sets), tuple(ranks)))

    while opened:
        small = [o for o in opened if o.n <= at_once]
        large = [o for o in opened if o.n > at_once]
        opened = []
        if small:
            w = Window.partitionBy("i").orderBy("v")
            asked = F.lit(False)
            for s in sets:
                wanted = F.lit([[x - o.before[s] for x in o.ranks[s]] for o in small]) \
                    .cast("array<array<long>>")
                asked |= _asked(F.get(wanted, "i"), F.col(f"c{s}"), F.col(f"n{s}"))
            got = (rows.select("part", _place(small).alias("i"), "v").filter("i IS NOT NULL")
                   .groupBy("i", "v").agg(*counts)
                   .select("*", *[F.sum(f"n{s}").over(w).alias(f"c{s}") for s in sets])
                   .filter(asked))
            for r in got.collect():
                o = small[r["i"]]
                found.update({(o.by, s, x): r["v"] for s in sets for x in o.ranks[s]
                              if r[f"c{s}"] - r[f"n{s}"] < x - o.before[s] <= r[f"c{s}"]})
        if large:
            bins = _bins(rows, large, "double", counts)
            before = [list(o.before) for o in large]
            for r in bins:
                o, start = large[r["i"]], tuple(before[r["i"]])
                for s in sets:
                    before[r["i"]][s] += r[f"n{s}"]
                settle(_Shared(o.by, r["lo"], r["hi"], r["n"], start, tuple(
                    tuple(x for x in o.ranks[s] if start[s] < x <= start[s] + r[f"n{s}"])
                    for s in sets)))

    out: list[dict[str, float | None]] = []
    for s in sets:
        out.append({})
        for i, c in enumerate(names):
            n = sizes.get((i, s), 0)
            if not n:
                out[s][c] = None
                continue
            at = (n - 1) * shares[c]
            lo = int(at)
            a, b = found[i, s, lo + 1], found[i, s, min(lo + 2, n)]
            out[s][c] = a if a == b or at == lo else (lo + 1 - at) * a + (at - lo) * b
    return out


def _class_bounds(df: DataFrame, label: str, order: str, key: str,
                  ranks: Callable[[int], Sequence[int]], at_once: int | None
                  ) -> dict[int, list[tuple[int, Any, Any]]]:
    """Per label (rank, order value, key) at the wanted ranks of its rows."""
    labels = sorted(r[0] for r in df.select(label).distinct().limit(1001).collect()
                    if r[0] is not None)
    if len(labels) > 1000:
        raise ValueError(f"{label} has more than 1,000 values")
    got = select(df.select(F.col(label).cast("int").alias("by"), F.col(order).alias("v")),
                 {y: ranks for y in labels}, at_once)
    wanted = [(y, x, f) for y, (_, found) in sorted(got.items()) for x, f in sorted(found.items())]
    held = [F.struct(F.lit(t).alias("by"), F.col(key).alias("v"),
                     ((F.col(label) == y) & F.col(order).eqNullSafe(F.lit(f.value))).alias("mine"))
            for t, (y, x, f) in enumerate(wanted)]
    keys = select(df.select(F.inline(F.array(*held))).filter("mine").select("by", "v"),
                  {t: (lambda n, r=x - f.before: [r]) for t, (y, x, f) in enumerate(wanted)},
                  at_once) if wanted else {}
    out: dict[int, list[tuple[int, Any, Any]]] = {y: [] for y in labels}
    for t, (y, x, f) in enumerate(wanted):
        (k,) = keys[t][1].values()
        out[y].append((x, f.value, k.value))
    return out


def _upto(order: str, key: str, value: Any, k: Any) -> Column:
    return (F.col(order) < F.lit(value)) | ((F.col(order) == F.lit(value))
                                            & (F.col(key) <= F.lit(k)))


def first_of_class(df: DataFrame, label: str, order: str, key: str,
                   of: Callable[[int], int], at_once: int | None = None) -> Column:
    """Whether a row is among the first ``of(rows of its label)`` of its label
    in ``order`` (never NULL), ties by the unique ``key``; ``label`` is a small
    integer."""
    ranks = lambda n: [x for x in (min(of(n), n),) if x > 0]              # noqa: E731
    c = F.lit(False)
    for y, bounds in _class_bounds(df, label, order, key, ranks, at_once).items():
        for _, value, k in bounds:
            c = F.when(F.col(label) == y, _upto(order, key, value, k)).otherwise(c)
    return c


def tile_of_class(df: DataFrame, label: str, order: str, key: str, buckets: int,
                  at_once: int | None = None) -> Column:
    """NTILE(``buckets``), from 0, of a row among those of its label in
    ``order`` (never NULL), ties by the unique ``key``."""
    ranks = lambda n: _last_ranks(ntile(buckets), n)                      # noqa: E731
    c = F.lit(0)
    for y, bounds in _class_bounds(df, label, order, key, ranks, at_once).items():
        t = F.lit(0)
        for _, value, k in bounds:
            t = t + (~_upto(order, key, value, k)).cast("int")
        c = F.when(F.col(label) == y, t).otherwise(c)
    return c
