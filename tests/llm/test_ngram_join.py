import itertools
import random

import numpy as np
import pytest

from holdfast.llm import ngram_join

from .helpers import clashing, documents, texts_given


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = [(d, shingle_set(t)) for d, t in docs]
    up = {d: d for d, _ in docs if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    live = [(d, s) for d, s in sets if d is not None and s]
    where = {}
    for i, (_, s) in enumerate(live):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, j in {p for v in where.values() for p in itertools.combinations(sorted(set(v)), 2)}:
        (a, s), (b, t) = live[i], live[j]
        both = len(s & t)
        if 100 * both >= 75 * len(s | t):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return sorted((repr(d), len(s), repr(root(d) if d is not None else None)) for d, s in sets)


def check(spark, docs):
    rows = ngram_join.components(clashing(documents(spark, docs))).collect()
    got = sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in rows)
    assert got == brute(docs)


def changed(rnd, words, n):
    out = list(words)
    for _ in range(n):
        out[rnd.randrange(len(out))] = f"new{rnd.random()}"
    return out


def test_hashes_are_sets_of_runs():
    rnd = random.Random(1)
    for _ in range(200):
        words = [rnd.choice(["a", "B", "c", "é", "dd"]) for _ in range(rnd.randint(0, 30))]
        text = "".join(w + rnd.choice([" ", "\n", "\t  ", "\x0b"]) for w in words)
        got = ngram_join.shingles(text)
        assert len(got) == len(shingle_set(text))
        assert np.array_equal(got, ngram_join.shingles(" ".join(words).lower()))
    assert len({int(ngram_join.shingles(t)[0]) for t in ("a", "b", "a b", "b a", "a b c", "ab")}) == 6


def test_given_documents(spark):
    check(spark, texts_given() + [(9000, None), (9001, ""), (9002, "  \n")])


def test_small_sets(spark):
    """Sets on both sides of the boundary, with every overlap."""
    rnd = random.Random(6)
    docs = []
    for i in range(260):
        n = rnd.randint(1, 18)
        start = rnd.randint(0, 4)
        docs.append((i, " ".join(f"w{k}" for k in range(start, start + n))))
    check(spark, docs)


def test_near_copies_chains_and_thresholds(spark):
    rnd = random.Random(7)
    docs = []
    for g in range(12):
        words = [f"g{g}x{rnd.randrange(10 ** 6)}" for _ in range(rnd.randint(20, 120))]
        for _ in range(rnd.randint(2, 9)):
            docs.append((rnd.randrange(10 ** 6), " ".join(changed(rnd, words, rnd.randint(0, 4)))))
            words = changed(rnd, words, rnd.randint(0, 2))
    check(spark, docs)


def test_large_groups_and_common_passages(spark, monkeypatch):
    """Groups far beyond the length from which lists go through pivots."""
    monkeypatch.setattr(ngram_join, "LONG_LIST", 8)
    rnd = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, " ".join(changed(rnd, base, rnd.randint(0, 9)))) for i in range(1, 160)]
    docs += [(1000 + i, passage + " " + " ".join(f"u{i}x{k}" for k in range(rnd.randint(2, 90))))
             for i in range(120)]
    docs += [(3000 + i, "the same words in all of these documents here") for i in range(100)]
    check(spark, docs)


def test_repeated_and_null_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    check(spark, [(5, a), (7, a), (7, b), (9, b), (5, a), (None, a), (None, None), (11, "z")])


def test_very_long_text_and_empty_table(spark):
    long = " ".join(f"v{i}" for i in range(60_000))
    check(spark, [(1, long), (2, long + " more"), (3, long[:len(long) // 2])])
    assert ngram_join.components(documents(spark, [])).collect() == []


def test_prefixes_meet():
    """Linked sets share a shingle among the first n - o + 1 of both."""
    rnd = random.Random(10)
    for _ in range(3000):
        n = rnd.randint(1, 90)
        s = set(rnd.sample(range(1000), n))
        t = set(rnd.sample(sorted(s), rnd.randint(max(1, 3 * n // 4), n))) | set(
            rnd.sample(range(1000, 2000), rnd.randint(0, n // 4)))
        if 100 * len(s & t) >= 75 * len(s | t):
            o = ngram_join.overlap(len(s), len(t))
            assert o <= len(s & t)
            first = [set(sorted(x)[:len(x) - o + 1]) for x in (s, t)]
            assert first[0] & first[1]
            assert all(len(x) - o + 1 <= ngram_join.prefix_size(len(x)) for x in (s, t))


def test_one_per_group(spark):
    a = " ".join(f"a{i}" for i in range(30))
    df = clashing(documents(spark, [(5, a), (3, a), (None, a), (4, None), (6, "z"), (6, "z")]))
    out = ngram_join.one_per_group(df)
    assert out.columns == df.columns
    assert sorted(repr(r["doc_id"]) for r in out.collect()) == ["3", "4", "6", "6", "None"]


def test_bitmaps_only_drop_pairs_that_can_not_link():
    rnd = np.random.default_rng(3)
    dropped = 0
    for _ in range(3000):
        n, m = int(rnd.integers(1, 300)), int(rnd.integers(1, 300))
        both = int(rnd.integers(0, min(n, m) + 1)) if rnd.random() < 0.5 else min(n, m) * 9 // 10
        v = rnd.integers(0, 1 << 63, n + m - both, dtype=np.uint64)
        s, t = np.unique(v[:n]), np.unique(v[n - both:])
        common = len(np.intersect1d(s, t))
        links = 100 * common >= 75 * (len(s) + len(t) - common) and common > 0
        may = ngram_join.may_link(len(s), ngram_join.parity(s), len(t), ngram_join.parity(t))
        assert may or not links
        dropped += not may
    assert dropped > 1000
