import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from holdfast.llm import lm_scoring

from .helpers import clashing, documents, texts_given


def tokens(text):
    return [w for w in (text or "").encode().lower().split()] + [b"</s>"]


def held(d):
    return zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2


class Brute:
    """The same model by its definition, over the whole corpus at once."""

    def __init__(self, docs):
        train = [tokens(t) for d, t in docs if not held(d)]
        self.c = Counter(w for t in train for w in t)
        self.n, self.v = sum(self.c.values()), len(self.c)
        n1, n2 = (sum(v == k for v in self.c.values()) for k in (1, 2))
        self.d = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5
        self.grams = Counter()
        for t in train:
            for k in (1, 2, 3):
                for i in range(len(t) - k + 1):
                    self.grams[tuple(t[i:i + k])] += 1

    def p(self, w, h):
        if not h:
            if not self.n:
                return 1.0
            return (self.c[w] - self.d if self.c[w] else self.d * self.v) / self.n
        after = {g[-1]: k for g, k in self.grams.items() if g[:-1] == h}
        if not after:
            return self.p(w, h[1:])
        total = self.grams[h]
        left = 1 - (sum(after.values()) - 0.75 * len(after)) / total
        seen = (after[w] - 0.75) / total if w in after else 0.0
        return seen + left * self.p(w, h[1:])

    def score(self, text):
        t = tokens(text)
        return sum(math.log10(self.p(w, tuple(t[max(0, i - 2):i]))) for i, w in enumerate(t))

    def base(self, text):
        return sum(math.log10((self.c[w] + 1) / (self.n + self.v + 1)) for w in tokens(text))


def made(n=40):
    rnd = random.Random(8)
    words = "the of and A to in it is was that".split() + [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rnd.choice(words[:rnd.choice([4, 10, 70])]) for _ in range(rnd.randint(0, 40))))
            for i in range(n)]
    return docs + [(100, None), (101, ""), (102, "Café CAFÉ unseen\x0bword\xa0x"), (None, "the of"),
                   (3, docs[3][1]), (3, docs[3][1])]


@pytest.mark.parametrize("block", [4096, 7])
def test_equals_the_definition(spark, block, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_DOCS", block)
    docs = made()
    brute = Brute(docs)
    rows = lm_scoring.score(clashing(documents(spark, docs))).collect()
    assert len(rows) == len(docs)
    want = sorted((repr(d), held(d), len(tokens(t)), sum(brute.c[w] > 0 for w in tokens(t)), brute.n,
                   round(brute.base(t), 8), round(brute.score(t), 8)) for d, t in docs)
    assert sorted((repr(r[0]), *r[1:5], round(r[5], 8), round(r[6], 8)) for r in rows) == want


def test_probabilities_add_up():
    docs = made()
    brute = Brute(docs)
    number = {w: i for i, w in enumerate(brute.c)}
    counts = np.array([*brute.c.values(), 0])
    grams = {tuple(number[w] for w in g): k for g, k in brute.grams.items()}
    follow = {}
    for g in grams:
        if len(g) > 1:
            follow[g[:-1]] = follow.get(g[:-1], 0) + 1
    model = lm_scoring.Automaton(lm_scoring.unigrams(counts, brute.n, brute.v, brute.d), grams, follow)
    assert len(model.fail) > 20
    for s in range(len(model.fail)):
        assert sum(10 ** model.score(s, t)[0] for t in range(len(counts))) == pytest.approx(1)


def test_better_than_the_base_on_held_out_documents(spark):
    rows = lm_scoring.score(documents(spark, texts_given())).collect()
    out = [r for r in rows if r["held_out"]]
    assert out and sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    brute = Brute(texts_given())
    for r, (d, t) in zip(sorted(rows, key=lambda r: r["doc_id"])[:25], texts_given(25)):
        assert r["base_score"] == pytest.approx(brute.base(t))


def test_edges(spark):
    assert lm_scoring.score(documents(spark, [])).collect() == []
    one = next(d for d in range(100) if held(d))
    r = lm_scoring.score(documents(spark, [(one, "all held out")])).head()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (4, 0, 0, 0, 0)
    long = "the of and " * 40_000
    r = lm_scoring.score(documents(spark, [(0, long), (1, "the of")])).filter("doc_id = 0").head()
    assert r["n_tokens"] == 120_001 and math.isfinite(r["score"])


@pytest.mark.parametrize("block", [4096, 7])
def test_rare_words_have_ngrams_too(spark, block, monkeypatch):
    """No word is too rare; about 1,500 words, most of them under one token in
    1,000."""
    monkeypatch.setattr(lm_scoring, "BLOCK_DOCS", block)
    rnd = random.Random(9)
    docs = made() + [(200 + i, " ".join(f"r{rnd.randrange(150)} s{rnd.randrange(1500)}" for _ in range(30)))
                     for i in range(40)]
    docs += [(300, "left of centre"), (301, "centre of left")]
    brute = Brute(docs)
    rows = lm_scoring.score(documents(spark, docs)).collect()
    assert sorted((repr(r["doc_id"]), round(r["score"], 8)) for r in rows) == sorted(
        (repr(d), round(brute.score(t), 8)) for d, t in docs)


def exchanged(docs, block, slices, brute):
    """What the jobs do, block by block and slice by slice, without Spark."""
    def by(column, tables):
        t = pa.concat_tables(tables)
        return [t.filter(pc.equal(t.column(column), k)) for k in pc.unique(t.column(column)).to_pylist()]

    coded = []
    for b in range(0, len(docs), block):
        vocab, part = {}, docs[b:b + block]
        texts = [np.array([vocab.setdefault(w, len(vocab)) for w in lm_scoring.words_of(t)])
                 for _, t in part]
        found = [(d or 0, d is None, held(d), len(t)) for (d, _), t in zip(part, texts)]
        coded.append(lm_scoring._block(b, slices, vocab, found, texts))
    kind = pa.concat_tables(coded)
    own, words = (kind.filter(pc.equal(kind.column("kind"), k)) for k in (lm_scoring.DOCS, lm_scoring.WORDS))
    told = [lm_scoring.slice_words(t, slices).select(words.column_names) for t in by("slice", [words])]
    whole = by("block", [own, *told])
    sent = [lm_scoring.block_grams(t, slices) for t in whole]
    counts = [lm_scoring.slice_grams(t) for t in by("slice", sent)]
    out = pa.concat_tables([lm_scoring.block_scores(t, slices, brute.n, brute.v, brute.d)
                            for t in by("block", [*whole, *counts])])
    return out, sent


def test_frequent_histories_are_dealt_over_slices(monkeypatch):
    docs = made() + [(500 + i, "the of " * 30 + f"the x{i} of y{i}") for i in range(30)]
    brute = Brute(docs)
    out, one = exchanged(docs, 9, 8, brute)
    monkeypatch.setattr(lm_scoring, "SLICE_TOKENS", 20)
    more, several = exchanged(docs, 9, 8, brute)
    want = sorted((repr(d), round(brute.score(t), 8)) for d, t in docs)
    for t in (out, more):
        assert sorted((repr(r["doc_id"]), round(r["score"], 8)) for r in t.to_pylist()) == want

    def asked(tables):
        return sum(len(lm_scoring._unpack_grams(d)[0]) for t in tables for d in t.column("more").to_pylist())
    assert asked(several) > asked(one)


@pytest.mark.parametrize("lane", [1, 2, 3, 50])
def test_lanes_change_nothing(lane, monkeypatch):
    docs = made()
    brute = Brute(docs)
    monkeypatch.setattr(lm_scoring, "LANE", lane)
    out, _ = exchanged(docs, 16, 4, brute)
    for r, (d, t) in zip(out.to_pylist(), docs):
        assert r["doc_id"] == d and r["score"] == pytest.approx(brute.score(t))


@pytest.mark.parametrize("values", [[], [0], [-2**63, 2**63 - 1, 0], [5, 5, 5], [-1, 254], [-1, 255, 70000]])
def test_packed_columns_come_back(values):
    x = np.array(values, np.int64)
    for c in lm_scoring._unpack(lm_scoring._pack(x, x[::-1])):
        assert sorted(c.tolist()) == sorted(values)
