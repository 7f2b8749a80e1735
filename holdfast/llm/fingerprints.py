"""Document fingerprints as invertible Bloom lookup sketches of paragraphs.

A text is cut into paragraphs; each adds its digest to one cell in every
sub-table of a small sketch.  The sketches of two versions are subtracted cell
by cell: what they share cancels, and peeling cells that hold a single element
recovers the paragraphs in which they differ.  Where peeling stalls, both
sketches are made again four times as large.
"""

from __future__ import annotations

from base64 import b64encode
from collections.abc import Iterable, Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

TABLES = 3                         # cells per element
WIDTH = 4                          # cells per sub-table of a fingerprint
LONGEST = 256                      # code points of a paragraph
_GROW = 4                          # a retried sketch is larger by this factor
_CELLS = 1 << 19                   # cells that are peeled at once, one pair at least
_SLICE_TEXTS, _SLICE_CHARS = 512, 4 << 20
_DIGESTS = T.ArrayType(T.LongType())
_CELL = np.dtype([("count", "<i4"), ("turn", "<u4"), ("digest", "<u8"), ("check", "<u4")])


def paragraphs(text: str) -> list[str]:
    """Lines, cut where a blank follows a full stop, exclamation or question
    mark, and every ``LONGEST`` code points where a sentence is longer; blanks
    around them and empty ones do not count."""
    out = []
    for part in text.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n"):
        part = part.strip()
        if len(part) <= LONGEST:
            if part:
                out.append(part)
        else:
            out += [part[i:i + LONGEST] for i in range(0, len(part), LONGEST)]
    return out


class Elements(NamedTuple):
    """Paragraphs of several texts: digest and its how manyeth occurrence."""

    of: np.ndarray                 # number of the text
    digest: np.ndarray
    turn: np.ndarray

    def some(self, texts: np.ndarray, n: int) -> Elements:
        """Those of ``texts`` (of ``n``), numbered anew in their order."""
        new = np.full(n, -1)
        new[texts] = np.arange(len(texts))
        keep = new[self.of] >= 0
        return Elements(new[self.of[keep]], self.digest[keep], self.turn[keep])


def elements(texts: list[str]) -> Elements:
    digests = [[xxh3_64_intdigest(p) for p in paragraphs(t)] for t in texts]
    of = np.repeat(np.arange(len(texts)), [len(d) for d in digests])
    digest = np.fromiter((x for d in digests for x in d), np.uint64, len(of))
    order = np.lexsort((digest, of))
    of, digest = of[order], digest[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (digest[1:] != digest[:-1])
    at = np.arange(len(of))
    return Elements(of, digest, (at - at[new][np.cumsum(new) - 1]).astype(np.uint32))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash(digest: np.ndarray, turn: np.ndarray) -> np.ndarray:
    return _mix(digest + (turn.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _check(h: np.ndarray) -> np.ndarray:
    return (_mix(h) >> np.uint64(32)).astype(np.uint32)


def _slot(h: np.ndarray, table: int, width: int) -> np.ndarray:
    return (_mix(h + np.uint64(table + 1)) & np.uint64(width - 1)).astype(np.int64)


class Sketches:
    """Sketches of ``n`` texts, or differences of two each; ``width`` is a
    power of two.  Fields are sums, modulo the size of their type."""

    def __init__(self, n: int, width: int):
        self.n, self.width = n, width
        cells = n * TABLES * width
        self.count, self.turn = np.zeros(cells, np.int32), np.zeros(cells, np.uint32)
        self.digest, self.check = np.zeros(cells, np.uint64), np.zeros(cells, np.uint32)

    def add(self, e: Elements, sign: np.ndarray) -> np.ndarray:
        """Add elements (sign 1) or take them off (-1); the cells touched."""
        h, at = _hash(e.digest, e.turn), []
        fields = [(self.count, sign.astype(np.int32)),
                  (self.turn, e.turn * sign.astype(np.uint32)),
                  (self.digest, e.digest * sign.astype(np.uint64)),
                  (self.check, _check(h) * sign.astype(np.uint32))]
        for table in range(TABLES):
            at.append((e.of * TABLES + table) * self.width + _slot(h, table, self.width))
            for field, value in fields:
                np.add.at(field, at[-1], value)
        return np.concatenate(at)

    def minus(self, mine: np.ndarray, other: Sketches, theirs: np.ndarray) -> Sketches:
        """Differences of the sketches ``mine`` and the other's ``theirs``."""
        out = Sketches(len(mine), self.width)
        for name in _CELL.names:
            a, b = (getattr(s, name).reshape(s.n, -1)[rows].ravel()
                    for s, rows in ((self, mine), (other, theirs)))
            setattr(out, name, a - b)
        return out

    def peel(self) -> tuple[np.ndarray, Elements, np.ndarray]:
        """Take off single elements until none is left: which sketches came
        out empty, and the elements with their signs."""
        found, signs, left = [], [], len(self.count)
        near = np.arange(len(self.count))
        while len(near) and left > 0:
            near = near[np.abs(self.count[near]) == 1]
            sign = self.count[near]
            turn = self.turn[near] * sign.astype(np.uint32)
            digest = self.digest[near] * sign.astype(np.uint64)
            h = _hash(digest, turn)
            single = _check(h) == self.check[near] * sign.astype(np.uint32)
            near, sign, turn, digest = near[single], sign[single], turn[single], digest[single]
            of = near // (TABLES * self.width)
            order = np.lexsort((turn, digest, of))
            e, sign = Elements(of[order], digest[order], turn[order]), sign[order]
            new = np.ones(len(order), bool)                # one may be single in several cells
            new[1:] = np.any([x[1:] != x[:-1] for x in e], axis=0)
            e, sign = Elements(*(x[new] for x in e)), sign[new]
            found.append(e)
            signs.append(sign)
            left -= len(sign)
            near = np.unique(self.add(e, -sign))
        rest = np.any([getattr(self, name).reshape(self.n, -1).any(axis=1)
                       for name in _CELL.names], axis=0)
        return ~rest, Elements(*(np.concatenate(x) for x in zip(*found))) if found else \
            elements([]), np.concatenate(signs) if signs else np.zeros(0, np.int32)

    def encoded(self) -> list[str]:
        """Base64 of every sketch's cells."""
        out = np.zeros((self.n, TABLES * self.width), _CELL)
        for name in _CELL.names:
            out[name] = getattr(self, name).reshape(self.n, -1)
        return [b64encode(row.tobytes()).decode() for row in out]


def sketches(e: Elements, n: int, width: int = WIDTH) -> Sketches:
    out = Sketches(n, width)
    out.add(e, np.ones(len(e.of), np.int64))
    return out


def differences(a: Elements, sa: Sketches, mine: np.ndarray, b: Elements, sb: Sketches,
                theirs: np.ndarray) -> tuple[Elements, np.ndarray]:
    """Elements of only one text of each pair (mine[i] of a, theirs[i] of b)
    and their signs: 1 where they are a's.  First from the given sketches,
    then, for pairs that do not peel, from larger and larger ones."""
    found, signs = [], []
    todo, width = np.arange(len(mine)), sa.width
    while len(todo):
        stalled = []
        step = max(1, _CELLS // (TABLES * width))
        for lo in range(0, len(todo), step):
            some = todo[lo:lo + step]
            if width == sa.width:
                diff = sa.minus(mine[some], sb, theirs[some])
            else:
                # a text may be in several pairs of a slice; each side's are sketched once
                own, at_own = np.unique(mine[some], return_inverse=True)
                far, at_far = np.unique(theirs[some], return_inverse=True)
                diff = sketches(a.some(own, sa.n), len(own), width).minus(
                    at_own, sketches(b.some(far, sb.n), len(far), width), at_far)
            done, e, sign = diff.peel()
            keep = done[e.of]
            found.append(Elements(some[e.of[keep]], e.digest[keep], e.turn[keep]))
            signs.append(sign[keep])
            stalled.append(some[~done])
        todo, width = np.concatenate(stalled), width * _GROW
    if not found:
        return elements([]), np.zeros(0, np.int32)
    return Elements(*(np.concatenate(x) for x in zip(*found))), np.concatenate(signs)


def likeness(a: Elements, sa: Sketches, mine: np.ndarray, b: Elements, sb: Sketches,
             theirs: np.ndarray) -> np.ndarray:
    """Shared paragraphs over all (Jaccard, with repetitions) of every pair;
    1 where neither text has any."""
    e, _ = differences(a, sa, mine, b, sb, theirs)
    apart = np.bincount(e.of, minlength=len(mine))
    both = np.bincount(a.of, minlength=sa.n)[mine] + np.bincount(b.of, minlength=sb.n)[theirs]
    return np.where(both > 0, (both - apart) / np.maximum(both + apart, 1), 1.0)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the next text."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()),
                    ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
                    ("near_next", pa.float64())])


def _slices(rows: Iterable[tuple[int | None, str, bool, int]]
            ) -> Iterator[tuple[list[int | None], list[str]]]:
    """Runs of neighbours from (id, text, copy, part) in order: the ids and
    their texts, with one text more, which follows the last."""
    ids: list[int | None] = []
    texts: list[str] = []
    chars, before, over = 0, None, False
    for i, text, copy, part in rows:
        if part != before:
            assert not ids or over, "a part ends with a copy of the next row"
            ids, texts, chars, before, over = [], [], 0, part, False
        if over:
            continue                                       # more copies of the same id
        texts.append(text)
        chars += len(text)
        over = copy
        if copy or len(ids) >= _SLICE_TEXTS or chars > _SLICE_CHARS:
            if len(texts) > 1:
                yield ids, texts
            ids, texts, chars = [], [text], len(text)
        if not copy:
            ids.append(i)


def _report(ids: list[int | None], texts: list[str]) -> pa.RecordBatch:
    n = len(ids)
    changed = [edited(t, u) for t, u in zip(texts, texts[1:])]
    own, new = elements(texts), elements(changed)
    s_own, s_new = sketches(own, n + 1), sketches(new, n)
    at = np.arange(n)
    return pa.record_batch([
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()),
        pa.array([sha256(t.encode()).hexdigest() for t in changed]),
        pa.array(s_own.encoded()[:n]), pa.array(s_new.encoded()),
        pa.array(likeness(own, s_own, at, new, s_new, at)),
        pa.array(likeness(own, s_own, at, own, s_own, at + 1))], schema=RESULT)


def neighbours(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(id, text, copy, part), sorted in each partition so that every row is
    followed by the next one in id order.

    Ids are cut into parts at approximate quantiles; a part's first row goes to
    the part before as well, as a copy that ends it, and the first of all to
    the last part.  Only the parts' bounds, as many as there are parts, pass
    the driver; texts are shuffled once.
    """
    spark = docs.sparkSession
    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"),
                       F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce("id", F.lit(-(1 << 63)))             # null first
    shares = [i / parts for i in range(1, parts)] or [0.5]
    cuts = sorted(set(rows.agg(F.percentile_approx(key, shares, max(10_000, 20 * parts)))
                      .first()[0] or []))
    steps = [1 << b for b in range(len(cuts).bit_length() - 1, -1, -1)] if cuts else []
    part = F.lit(0)
    if cuts:                                               # binary search
        bound = F.lit(cuts)
        part = F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(
            at + step <= len(cuts), F.when(F.get(bound, at + step - 1) <= key, at + step)
            .otherwise(at)).otherwise(at))
    rows = rows.select("id", "text", key.alias("key"), part.alias("part"))
    first = {r["part"]: r["key"] for r in rows.groupBy("part").agg(F.min("key").alias("key"))
             .collect()}                                   # a row per part
    if not first:
        return rows.select("id", "text", F.lit(False).alias("copy"), "part")
    order = sorted(first)
    starts, to = [0] * (order[-1] + 1), [0] * (order[-1] + 1)
    for p, before in zip(order, [order[-1], *order]):
        starts[p], to[p] = first[p], before
    place = lambda part, copy: F.struct(part.alias("part"), F.lit(copy).alias("copy"))
    here = place(F.col("part"), False)
    there = place(F.get(F.lit(to), "part"), True)
    places = F.when(F.col("key") == F.get(F.lit(starts), "part"), F.array(here, there)) \
        .otherwise(F.array(here))
    return (rows.select("id", "text", "key", F.explode(places).alias("at"))
            .select("id", "text", "key", "at.part", "at.copy").repartition("part")
            .sortWithinPartitions("part", "copy", "key", "text")
            .select("id", "text", "copy", "part"))


def report(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every document and of its edited version, and how like
    they are.

    The edited version ends, instead of in the text's last quarter, in the
    beginning of the next document by doc_id (after the last comes the first;
    a single document follows itself).  A null text counts as empty.  A null
    doc_id comes first; rows that share a doc_id follow each other by text.

    Returns doc_id, n_chars (code points), edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next (likeness of the fingerprint
    to those of the edited text and of the next document, 0 to 1).  Texts
    without a paragraph are alike.  Order of paragraphs and blanks around them
    do not count.  An empty table gives no rows; other columns are not read.
    """
    def task(batches):
        rows = ((i.as_py(), t.as_py(), c.as_py(), p.as_py())
                for b in batches for i, t, c, p in zip(*b.columns))
        for ids, texts in _slices(rows):
            yield _report(ids, texts)

    return neighbours(docs, parts).mapInArrow(
        task, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double")


def changes(versions: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """``versions`` with the digests of paragraphs that only one of two text
    columns has: removed and added (arrays of 64-bit integers, one entry per
    occurrence, ascending), and likeness.  Null texts count as empty; columns
    of these names are replaced."""
    kept = [c for c in versions.columns if c not in ("removed", "added", "likeness")]
    schema = versions.select(*kept).schema.add("removed", _DIGESTS) \
        .add("added", _DIGESTS).add("likeness", "double")

    def task(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                some = b.slice(lo, 64)
                e = [elements([t or "" for t in some.column(c).to_pylist()])
                     for c in ("__before", "__after")]
                n, at = some.num_rows, np.arange(some.num_rows)
                s = [sketches(x, n) for x in e]
                diff, sign = differences(e[0], s[0], at, e[1], s[1], at)
                out = some.drop_columns(["__before", "__after"])
                for name, side in (("removed", 1), ("added", -1)):
                    lists = [np.sort(diff.digest[(diff.of == i) & (sign == side)].view(np.int64))
                             for i in range(n)]
                    out = out.append_column(name, pa.array(lists, pa.list_(pa.int64())))
                yield out.append_column("likeness", pa.array(
                    likeness(e[0], s[0], at, e[1], s[1], at)))

    return versions.select(*kept, F.col(before).alias("__before"), F.col(after).alias("__after")) \
        .mapInArrow(task, schema)
