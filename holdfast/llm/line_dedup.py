"""Line dedup by winnowing over line hashes.

A window is a least run of non-blank lines with ``min_words`` words, taken
forwards or backwards from any line.  Its fingerprint is the line with the smallest hash, so any two equal runs of that
many words select the same line in both places: equal runs cannot be missed.
Fingerprints are joined by hash; only those found in several places are
extended, by the windows around them, to the runs they belong to.  A window
whose text occurs earlier (by document id, then line) is deleted; overlapping
windows add up to the whole repeated run, and the first occurrence stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, set_apart, values

_LAST = (1 << 63) - 1


def line_windows(text: str, min_words: int):
    """Windows of ``text`` by fingerprint: (hash, line, [(content, from, to)]).

    Lines are compared without white space at their ends; blank ones do not
    count, and go with the line before them.  A window is listed with the line of its smallest hash, the last
    one of equals.
    """
    at, hashes, words, lines = [], [], [], []
    every = text.split("\n")
    for i, line in enumerate(every):
        line = line.strip()
        if line:
            raw = line.encode("utf-8")
            at.append(i)
            words.append(len(raw.split()))
            hashes.append(xxhash.xxh3_64_intdigest(raw))
            lines.append(raw)
    total = np.concatenate([[0], np.cumsum(words)])
    if not lines or total[-1] < min_words:
        return
    n = len(lines)
    ends = np.searchsorted(total, total[:-1] + min_words).tolist()      # lines i..ends[i]-1
    starts = (np.searchsorted(total, total[1:] - min_words, "right") - 1).tolist()
    spans = {(i, j) for i, j in enumerate(ends) if j <= n}
    spans |= {(i, j + 1) for j, i in enumerate(starts) if i >= 0}
    at.append(len(every))
    best: dict[int, list] = {}
    for i, j in sorted(spans):
        k = i if j - i == 1 else min(range(j - 1, i - 1, -1), key=hashes.__getitem__)
        content = xxhash.xxh3_128_digest(b"\n".join(lines[i:j]))
        best.setdefault(k, []).append((content, at[i], at[j] - 1))
    for k, windows in best.items():
        yield hashes[k], at[k], windows


def fingerprints(docs: DataFrame, min_words: int) -> DataFrame:
    """Fingerprints of (doc, key, text) rows with the windows they stand for."""

    def run(batches):
        kind = pa.list_(pa.struct([("c", pa.binary()), ("s", pa.int32()), ("e", pa.int32())]))
        for batch in batches:
            ids, keys, hashes, windows = [], [], [], []
            for d, key, t in zip(*map(values, batch.columns)):
                if not t:
                    continue
                for h, _, ws in line_windows(t, min_words):
                    ids.append(d)
                    keys.append(key)
                    hashes.append(h - (1 << 63))
                    windows.append([{"c": c, "s": s, "e": e} for c, s, e in ws])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()),
                 pa.array(hashes, pa.int64()), pa.array(windows, kind)],
                ["doc", "key", "h", "windows"])

    return docs.mapInArrow(
        run, "doc long, key long, h long, windows array<struct<c:binary,s:int,e:int>>")


def repeated_runs(docs: DataFrame, min_words: int, doc_id: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """``(__doc, __key, __runs)``: line ranges to delete from each document
    that repeats an earlier run; ``__key`` is the hash of its text."""
    # null ids come after all others
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("doc"),
                       F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    prints = materialize(fingerprints(rows, min_words), "fingerprints")
    shared = prints.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    windows = materialize(prints.join(shared, "h", "left_semi")
                          .select("doc", "key", F.explode("windows").alias("w"))
                          .select("doc", "key", "w.*"), "shared_windows")
    place = F.struct("doc", "key", "s")
    first = (windows.groupBy("c").agg(F.min(place).alias("first"), F.max(place).alias("last"))
             .filter("first <> last").select("c", "first"))
    later = windows.join(first, "c").filter(place != F.col("first"))
    return later.groupBy(F.col("doc").alias("__doc"), F.col("key").alias("__key")).agg(
        F.collect_set(F.struct("s", "e")).alias("__runs"))


def dedup_lines(docs: DataFrame, min_words: int = 50, doc_id: str = "doc_id",
                text: str = "text", length: str | None = "n_chars",
                drop_emptied: bool = True, counts: bool = False) -> DataFrame:
    """``docs`` without line runs of ``min_words`` words or more that occur
    earlier, in another document or in the same one.

    The earliest occurrence (smallest document id, then line) stays.  A
    document that loses its last non-blank line goes with ``drop_emptied``;
    null, empty and short texts stay as they are.  Rows that share an id and a
    text count as one document and are treated alike; null ids come last.  An
    empty table gives no row; other columns are kept.  ``counts`` adds n_lines,
    n_removed, and keeps the emptied documents.
    """
    docs, back = set_apart(docs, doc_id, text, length)
    runs = repeated_runs(docs, min_words, doc_id, text)
    keyed = docs.withColumns({"__doc": F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)),
                              "__key": F.xxhash64(text)})
    joined = keyed.join(runs, ["__doc", "__key"], "left")
    lines = F.split(F.col(text), "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.exists(
        "__runs", lambda r: (r["s"] <= i) & (i <= r["e"])))
    hit = F.col("__runs").isNotNull()
    out = joined.withColumn("__text", F.when(hit, F.array_join(kept, "\n")).otherwise(F.col(text)))
    if counts:
        n = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines))
        return back(out.select(
            *[F.col(f"`{c}`") for c in docs.columns if c != text],
            F.col("__text").alias(text), n.cast("long").alias("n_lines"),
            F.when(hit, n - F.size(kept)).otherwise(0).cast("long").alias("n_removed")))
    if drop_emptied:
        out = out.filter(~hit | F.col("__text").rlike(r"\S"))
    new = {text: F.col("__text")}
    if length and length in docs.columns:
        new[length] = F.when(hit, F.char_length("__text")).otherwise(F.col(length)) \
            .cast(docs.schema[length].dataType)
    return back(out.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns]))
