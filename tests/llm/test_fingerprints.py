"""Fingerprints against counted paragraphs and plain neighbours."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from holdfast.llm import fingerprints as fp
from tests.llm.helpers import SCHEMA, clashing, documents, given


def jaccard(a, b):
    a, b = Counter(fp.paragraphs(a)), Counter(fp.paragraphs(b))
    every = (a | b).total()
    return (a & b).total() / every if every else 1.0


def brute(rows):
    """(doc_id, n_chars, edited_sha256, near_edited, near_next) by loops."""
    rows = sorted(((i, t or "") for i, t in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 4
        e = t[:len(t) - k] + u[:k]
        out.append((i, len(t), sha256(e.encode()).hexdigest(), jaccard(t, e), jaccard(t, u)))
    return sorted(out, key=repr)


def got(df, parts=None):
    return sorted((tuple(r) for r in fp.report(df, parts).select(
        "doc_id", "n_chars", "edited_sha256", "near_edited", "near_next").collect()), key=repr)


def sentences(rng, n, kinds):
    return " ".join(f"Word{rng.randrange(kinds)} und ä{rng.choice('.!?')}" for _ in range(n))


def test_peeling_gives_the_difference_at_every_size():
    rng = random.Random(2)
    for n in (0, 1, 3, 10, 100, 2000):
        a = [sentences(rng, n, 50 + n) for _ in range(5)]
        b = [t[:len(t) // 2] + sentences(rng, n // 3, 9) for t in a]
        ea, eb = fp.elements(a), fp.elements(b)
        at = np.arange(5)
        diff, sign = fp.differences(ea, fp.sketches(ea, 5), at, eb, fp.sketches(eb, 5), at)
        for i in range(5):
            ca, cb = (Counter(xxh3_64_intdigest(p) for p in fp.paragraphs(x[i])) for x in (a, b))
            here = diff.of == i
            assert Counter(diff.digest[here & (sign == 1)].tolist()) == ca - cb
            assert Counter(diff.digest[here & (sign == -1)].tolist()) == cb - ca


def test_small_sketch_stalls_and_is_retried():
    rng = random.Random(7)
    a, b = fp.elements([sentences(rng, 300, 10 ** 6)]), fp.elements([sentences(rng, 300, 10 ** 6)])
    sa, sb = fp.sketches(a, 1), fp.sketches(b, 1)
    at = np.arange(1)
    assert not sa.minus(at, sb, at).peel()[0].any()
    assert len(fp.differences(a, sa, at, b, sb, at)[1]) == 600


def test_equal_texts_equal_fingerprints_others_not(spark):
    df = documents(spark, ["One. Two. Three.", "x", "One. Two. Three.", "One. Two.", None, ""])
    rows = {r.doc_id: r for r in fp.report(df).collect()}
    prints = [rows[i].fingerprint for i in range(6)]
    assert prints[0] == prints[2] and prints[4] == prints[5]
    assert len(set(prints)) == 4
    again = fp.report(df.select("doc_id", "text").repartition(3), parts=7).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, rows.values()), key=repr)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_equals_plain_neighbours(spark, parts):
    rng = random.Random(parts)
    rows = [(i, rng.choice([None, "", "a", sentences(rng, rng.randrange(30), 20)]))
            for i in rng.sample(range(-50, 500), 120)]
    assert got(documents(spark, rows).repartition(5), parts) == brute(rows)


def test_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in given("documents")]
    assert got(documents(spark, rows)) == brute(rows)


def test_ties_nulls_and_repeated_rows(spark):
    rows = [(5, "b. c"), (5, "a. bb"), (5, "a. bb"), (None, "n. x y z"), (None, None), (7, "last one"),
            (-(1 << 63), "least"), ((1 << 63) - 1, "most of all")]
    rows = [(i, t) for i, t in rows if i != -(1 << 63)]
    for parts in (1, 4):
        assert got(documents(spark, rows), parts) == brute(rows)


def test_one_document_and_none(spark):
    assert got(documents(spark, [(3, "abcdefgh")])) == brute([(3, "abcdefgh")])
    assert got(documents(spark, [])) == []


def test_very_long_text(spark):
    rng = random.Random(1)
    rows = [(0, sentences(rng, 30_000, 10 ** 6)), (1, "x" * 300_000), (2, "short. text"), (3, "")]
    assert got(documents(spark, rows)) == brute(rows)


def test_slices_are_cut_by_length(monkeypatch):
    monkeypatch.setattr(fp, "_SLICE_CHARS", 10)
    rows = [(i, "abc" * (i % 5), False, 0) for i in range(20)] + [(0, "first", True, 0),
                                                                (0, "more", True, 0)]
    out = list(fp._slices(rows))
    assert [i for ids, _ in out for i in ids] == list(range(20)) and len(out) > 3
    pairs = [p for _, texts in out for p in zip(texts, texts[1:])]
    plain = [t for _, t, _, _ in rows[:21]]
    assert pairs == list(zip(plain, plain[1:]))


def test_changes_between_versions(spark):
    rows = [("A. B. C. B", "A. B. D"), (None, "x"), ("same", "same"), (None, None)]
    df = clashing(spark.createDataFrame(rows, "before string, after string"))
    out = fp.changes(df.withColumn("likeness", F.lit("old")))
    assert len(out.columns) == len(set(out.columns)) and "key" in out.columns
    digest = lambda p: np.uint64(xxh3_64_intdigest(p)).view(np.int64).item()
    for r in out.collect():
        a, b = (Counter(fp.paragraphs(t or "")) for t in (r.before, r.after))
        assert r.removed == sorted(map(digest, (a - b).elements()))
        assert r.added == sorted(map(digest, (b - a).elements()))
        assert r.likeness == jaccard(r.before or "", r.after or "")


def test_clashing_columns(spark):
    rows = [(i, f"text {i}. of {i % 3}.") for i in range(20)]
    df = clashing(documents(spark, rows)).withColumns(
        {c: F.lit(7) for c in ("part", "copy", "at", "fingerprint", "near_next", "edited")})
    assert got(df) == brute(rows)
    assert fp.report(spark.createDataFrame([], SCHEMA)).count() == 0
