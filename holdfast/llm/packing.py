"""Hierarchical multi-length packing.

A document becomes its token ids and one end id.  Whole windows are cut from
its front; what remains is routed to the smallest context-size tier that
holds it.  Remainders of one length are interchangeable, so the packing plan
is made on the histogram of lengths (``window`` rows at most, whatever the
corpus): tiers from long to short pack their own remainders best fit first,
gaps of the longer windows are filled from the shorter tiers, and the windows
of short tiers that are neither full nor a power of two are merged.  The plan
is a list of intervals "remainders of length L with ranks a..a+m go to
sequences s..s+m at offset o", which a join on the length applies to all rows.

Sequences are numbered by falling cost, and a boustrophedon deal over them
gives every step group about the same attention cost.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordCache, materialize, values

END_ID = 0
_SPACE_BEFORE_WHITE = re.compile(r" \s")
_CUT = re.compile(r"(?= \S)")
_LONG = 2_000          # characters; longer chunks go to the library with a heap


def _byte_letters() -> dict[str, int]:
    """Letter that stands for each byte in a byte-level vocabulary: printable
    Latin-1 stands for itself, the other bytes follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Ids of a byte-level BPE file of the ``tokenizers`` library.

    Text is cut before every space that a non-space follows: no pre-token
    spans such a place, so the pieces can be encoded and cached one by one.
    New pieces go through the ranks read from the same file, very long ones
    through the library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in t): i
                 for t, i in spec["model"]["vocab"].items() if t not in special}
        if sorted(ranks.values()) != list(range(len(ranks))):
            raise ValueError(f"{path}: ids are not merge ranks")
        self._fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks,
                                       special_tokens={})
        self._path, self._library = path, None
        self._first = WordCache(self._encode, 20_000, 8 << 20)
        self._next = WordCache(lambda w: self._encode(" " + w), max_bytes=32 << 20)

    def _exact(self, piece: str) -> list[int]:
        """Ids by the library itself, which is loaded when first needed."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
            self._library.encode_special_tokens = True
        return self._library.encode(piece, add_special_tokens=False).ids

    def _encode(self, piece: str) -> bytes:
        if len(piece) > _LONG:
            ids = self._exact(piece)
        else:
            ids = self._fast.encode_ordinary(piece)
        return np.asarray(ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of ``text``."""
        if _SPACE_BEFORE_WHITE.search(text):
            head, *rest = _CUT.split(text)
            rest = [w[1:] for w in rest]
        else:
            head, *rest = text.split(" ")
        return self._first[head] + b"".join(map(self._next.__getitem__, rest))


_ENCODERS: dict[str, ByteBpe] = {}


def encoder(path: str) -> ByteBpe:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteBpe(path)
    return _ENCODERS[path]


# --- the plan, on the histogram of lengths ---------------------------------

class _Group:
    """``n`` windows of the same content; part = (length, first rank, offset)."""

    def __init__(self, n: int, used: int, parts: list[tuple[int, int, int]]):
        self.n, self.used, self.parts = n, used, parts

    def take(self, n: int) -> _Group:
        """Split off the first ``n`` windows."""
        first = _Group(n, self.used, self.parts)
        self.n -= n
        self.parts = [(k, a + n, o) for k, a, o in self.parts]
        return first


def _power_of_two(n: int) -> bool:
    return n & (n - 1) == 0


def _best_fit(open_: dict[int, list[_Group]], size: int, capacity: int) -> _Group | None:
    """Take the group with the least sufficient gap out of ``open_``."""
    for free in range(size, capacity + 1):
        if open_.get(free):
            return open_[free].pop()
    return None


def plan(histogram: dict[int, int], tiers: Sequence[int]) -> list[_Group]:
    """Groups of equal windows for ``histogram`` (length -> number of
    remainders).  Every remainder is placed exactly once; no window exceeds
    the largest tier."""
    tiers = sorted(tiers, reverse=True)
    window = tiers[0]
    left = {k: n for k, n in histogram.items() if k > 0 and n > 0}
    rank = dict.fromkeys(left, 0)
    done: list[_Group] = []
    loose: list[_Group] = []

    def place(size: int, open_: dict[int, list[_Group]], capacity: int, new: bool) -> None:
        while left.get(size):
            g = _best_fit(open_, size, capacity)
            if g is None:
                if not new:
                    return
                g = _Group(left[size], 0, [])
            m = min(g.n, left[size])
            if m < g.n:
                head = g.take(m)
                open_.setdefault(capacity - g.used, []).append(g)
                g = head
            g.parts = [*g.parts, (size, rank[size], g.used)]
            g.used += size
            rank[size] += m
            left[size] -= m
            open_.setdefault(capacity - g.used, []).append(g)

    for i, capacity in enumerate(tiers):
        below = tiers[i + 1] if i + 1 < len(tiers) else 0
        open_: dict[int, list[_Group]] = {}
        for size in range(capacity, below, -1):
            place(size, open_, capacity, new=True)
        for size in range(below, 0, -1):
            place(size, open_, capacity, new=False)
        for g in (g for gs in open_.values() for g in gs):
            (done if g.used == window or _power_of_two(g.used) else loose).append(g)

    # windows that would need padding: best fit into each other
    open_ = {}
    for g in sorted(loose, key=lambda g: -g.used):
        while g.n:
            host = _best_fit(open_, g.used, window)
            if host is None:
                open_.setdefault(window - g.used, []).append(g)
                break
            m = min(host.n, g.n)
            if m < host.n:
                head = host.take(m)
                open_.setdefault(window - host.used, []).append(host)
                host = head
            guest = g.take(m)
            host = _Group(m, host.used + guest.used, host.parts + [
                (k, a, o + host.used) for k, a, o in guest.parts])
            open_.setdefault(window - host.used, []).append(host)
    return done + [g for gs in open_.values() for g in gs if g.n]


def _cost(g: _Group) -> int:
    return sum(k * k for k, _, _ in g.parts)


# --- the operator -----------------------------------------------------------

def tokenized(docs: DataFrame, path: str, window: int, doc_id: str, text: str) -> DataFrame:
    """One row per document: token count, checksum of every piece, and its
    place among the pieces of its partition (written, so places stay)."""

    def run(batches):
        encode = encoder(path)
        pid, windows = TaskContext.get().partitionId(), 0
        ranks = np.zeros(window, np.int64)
        step = 4 * window
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            cols: dict[str, list] = {k: [] for k in ("n", "windows", "rem", "rank", "crc")}
            for t in values(batch.column(1)):
                ids = encode(t or "") + end
                n = len(ids) // 4
                rem = n % window
                cols["n"].append(n)
                cols["windows"].append(windows)
                cols["rem"].append(rem)
                cols["rank"].append(int(ranks[rem]))
                cols["crc"].append([zlib.crc32(ids[i:i + step]) for i in range(0, len(ids), step)])
                windows += n // window
                ranks[rem] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols["n"], pa.int64()),
                 pa.array([pid] * batch.num_rows, pa.int32()),
                 pa.array(cols["windows"], pa.int64()), pa.array(cols["rem"], pa.int32()),
                 pa.array(cols["rank"], pa.int64()),
                 pa.array(cols["crc"], pa.list_(pa.int64()))],
                ["doc_id", "doc_tokens", "pid", "windows", "rem", "rank", "crcs"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")) \
        .mapInArrow(run, "doc_id long, doc_tokens long, pid int, windows long, rem int, "
                         "rank long, crcs array<long>")


def pack(docs: DataFrame, path: str, window: int = 1024,
         tiers: Sequence[int] = (1024, 512, 256, 128), step_size: int = 8,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents, each with its sequence and its place in it.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    tier (context size the piece was routed to), step_group.  A null or empty
    text is a document of the end id alone.  Repeated rows and null ids are
    packed like any other row; an empty table gives no row; other columns are
    not read.  A very long text becomes many whole windows and one remainder.
    """
    spark = docs.sparkSession
    rows = materialize(tokenized(docs, path, window, doc_id, text), "tokenized")
    # at most `window` lengths, so this table is bounded whatever the corpus
    totals = rows.groupBy("rem").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.expr(f"(doc_tokens - rem) div {window}")).alias("windows")).collect()
    whole = sum(r["windows"] for r in totals)
    groups = sorted(plan({r["rem"]: r["n"] for r in totals}, tiers), key=lambda g: -_cost(g))
    intervals, at = [], whole
    for g in groups:
        intervals += [(k, a, a + g.n, at, o) for k, a, o in g.parts]
        at += g.n
    steps = max(1, -(-at // step_size))
    # bounded by the number of lengths, not by the rows: see plan()
    places = F.broadcast(spark.createDataFrame(
        intervals, "p_rem int, p_from long, p_to long, p_seq long, p_offset int"))

    per = rows.groupBy("pid", "rem").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.expr(f"(doc_tokens - rem) div {window}")).alias("w"))
    before = Window.partitionBy("rem").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    ranks = per.select("pid", "rem", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("r0"))
    # one row per input partition
    parts = per.groupBy("pid").agg(F.sum("w").alias("w")).select(
        "pid", F.coalesce(F.sum("w").over(
            Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("w0"))

    placed = (rows.join(ranks, ["pid", "rem"]).join(parts, "pid")
              .withColumn("r", F.col("rank") + F.col("r0"))
              .join(places, (F.col("rem") == F.col("p_rem")) & (F.col("r") >= F.col("p_from"))
                    & (F.col("r") < F.col("p_to")), "left"))
    pieces = placed.select("*", F.posexplode("crcs").alias("i", "ids_crc32"))
    full = F.col("i") < F.expr(f"(doc_tokens - rem) div {window}")
    tier = F.lit(window)
    for size in sorted(tiers, reverse=True):
        tier = F.when(F.col("length") <= size, size).otherwise(tier)
    seq = F.when(full, F.col("w0") + F.col("windows") + F.col("i")) \
        .otherwise(F.col("p_seq") + F.col("r") - F.col("p_from"))
    turn, pos = F.expr(f"sequence_id div {steps}"), F.col("sequence_id") % steps
    return (pieces.select(
        "doc_id", (F.col("i") * window).cast("long").alias("start"),
        F.when(full, window).otherwise(F.col("rem")).cast("long").alias("length"),
        "ids_crc32", "doc_tokens", seq.cast("long").alias("sequence_id"),
        F.when(full, 0).otherwise(F.col("p_offset")).cast("long").alias("offset"))
        .withColumn("tier", tier.cast("int"))
        .withColumn("step_group", F.when(turn % 2 == 0, pos).otherwise(steps - 1 - pos)))


def sequences(docs: DataFrame, pieces: DataFrame, path: str, window: int = 1024,
              pad_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (padded to ``window``
    unless their number is a power of two) and the piece lengths for the
    attention mask.  Expects unique, non-null document ids."""

    def cut(batches):
        encode = encoder(path)
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            d = batch.to_pydict()
            out = [np.frombuffer((encode(t or "") + end)[4 * s:4 * (s + n)], "<u4").astype(np.int32)
                   for t, s, n in zip(d["text"], d["start"], d["length"])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("sequence_id"), batch.column("offset"),
                 pa.array(out, pa.list_(pa.int32()))], ["sequence_id", "offset", "ids"])

    joined = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")) \
        .join(pieces.select("doc_id", "start", "length", "sequence_id", "offset"), "doc_id") \
        .select("text", "start", "length", "sequence_id", "offset")
    cuts = joined.mapInArrow(cut, "sequence_id long, offset long, ids array<int>")
    return (cuts.groupBy("sequence_id")
            .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
            .select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"),
                    F.transform("p.ids", F.size).alias("lengths"))
            .withColumn("ids", F.when(
                F.expr("size(ids) & (size(ids) - 1)") == 0, F.col("ids")).otherwise(
                F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(window) - F.size("ids"))))))
