import random

import pytest

from holdfast.llm import line_dedup

from .helpers import clashing, documents, texts_given


def brute(docs, min_words):
    """Every run of min_words words or more that occurs earlier goes."""
    split = {d: (t or "").split("\n") for d, t in docs}
    first, gone = {}, {d: set() for d, _ in docs}
    for d in sorted(split):
        live = [(i, s.strip()) for i, s in enumerate(split[d]) if s.strip()]
        to = [i for i, _ in live[1:]] + [len(split[d])]
        for a in range(len(live)):
            n = 0
            for b in range(a, len(live)):
                n += len(live[b][1].encode().split())
                if n >= min_words:
                    key = tuple(s for _, s in live[a:b + 1])
                    if first.setdefault(key, (d, a)) != (d, a):
                        gone[d] |= set(range(live[a][0], to[b]))
    return {d: "\n".join(s for i, s in enumerate(split[d]) if i not in gone[d]) for d in split}


def lines(rnd, n, words=12):
    return [" ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(
        rnd.randint(1, words))) for _ in range(n)]


@pytest.fixture(scope="module")
def made():
    rnd = random.Random(2)
    shared = [lines(rnd, rnd.randint(3, 12)) for _ in range(8)]
    docs = []
    for i in range(60):
        parts = lines(rnd, 6)
        for _ in range(rnd.randint(0, 3)):
            at, block = rnd.randint(0, len(parts)), rnd.choice(shared)
            cut = rnd.randint(0, 2)
            parts[at:at] = block[cut:]
            if rnd.random() < 0.3:
                parts.insert(rnd.randint(0, len(parts)), "  ")
        docs.append((i * 3, "\n".join(parts)))
    docs += [(500, docs[3][1]), (501, docs[3][1].replace("\n", "  \n"))]
    return docs


@pytest.mark.parametrize("min_words", [5, 20, 50])
def test_equals_brute_force(spark, made, min_words):
    out = line_dedup.dedup_lines(clashing(documents(spark, made)), min_words, counts=True)
    got = {r["doc_id"]: r for r in out.collect()}
    want = brute(made, min_words)
    for d, t in made:
        assert got[d]["text"] == want[d]
        assert got[d]["n_lines"] - got[d]["n_removed"] == len(want[d].split("\n")) or not want[d]


def test_given_documents(spark):
    docs = texts_given()
    got = {r["doc_id"]: r["text"] for r in
           line_dedup.dedup_lines(documents(spark, docs), 50, counts=True).collect()}
    assert got == brute(docs, 50)


def test_window_minima_meet():
    """Two texts that share a run select a common line of it."""
    rnd = random.Random(4)
    for _ in range(50):
        run = lines(rnd, 8)
        words = sum(len(s.split()) for s in run)
        prints = [{h for h, _, _ in line_dedup.line_windows("\n".join(
            lines(rnd, 5) + run + lines(rnd, 5)), words)} for _ in range(2)]
        assert prints[0] & prints[1]


def test_long_line_and_repeats_within_a_document(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = [(2, f"a\n{long}\nb"), (1, f"x\n{long}\ny\n{long}"), (3, long), (4, "short"), (5, "short")]
    kept = {r["doc_id"]: r for r in line_dedup.dedup_lines(documents(spark, docs)).collect()}
    assert {d: r["text"] for d, r in kept.items()} == {
        1: f"x\n{long}\ny", 2: "a\nb", 4: "short", 5: "short"}
    assert kept[2]["n_chars"] == 3


def test_nulls_repeated_rows_and_empty_table(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = [(1, long), (1, long), (2, None), (3, ""), (None, long), (None, None)]
    df = documents(spark, docs)
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == [
        (0, ""), (1, long), (1, long), (2, ""), (3, "")]
    assert line_dedup.dedup_lines(documents(spark, [])).collect() == []


def test_very_long_text(spark):
    rnd = random.Random(9)
    body = lines(rnd, 20_000)
    docs = [(1, "\n".join(body)), (2, "\n".join(body[5000:15_000]) + "\nown end")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents(spark, docs)).collect()}
    assert got == {1: docs[0][1], 2: "own end"}
