import hashlib
import random

import pytest
import public_tokenizers
import sentencepiece

from holdfast.llm import piece_bpe

from .helpers import clashing, documents, texts_given

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def encoder():
    return piece_bpe.encoder(PATH)


def test_random_texts_equal_the_library(library, encoder):
    rnd = random.Random(3)
    for alphabet in (" ▁  aabcdethin.,\n", "etaoinshrdlu ", "é😀ß漢\x00\t a<s>", "the ing er "):
        for _ in range(800):
            t = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
            joined, ids = encoder(t)
            assert ids == library.encode(t), t
            assert joined == ",".join(map(str, ids))


def test_runs_of_marks_and_long_words(library, encoder):
    for t in [" " * n for n in range(45)] + ["a" + " " * n + "b" for n in range(45)] + [
            "the" * 4000, "<s></s><unk><0x41>", "x" * 9000]:
        assert encoder(t)[1] == library.encode(t)


def test_backtracking_steps_back(encoder):
    """Longest matches alone are not the encoding of every word."""
    differ = 0
    for p in sorted(encoder.reachable, key=len)[-3000:]:
        word, out, at = p.strip(piece_bpe.MARK) * 2, [], 0
        while at < len(word):
            n = next(n for n in range(min(16, len(word) - at), 0, -1)
                     if n == 1 or word[at:at + n] in encoder.reachable)
            out.append(word[at:at + n])
            at += n
        assert encoder.pieces(word) == encoder.merge(word)
        differ += out != encoder.merge(word)
    assert differ > 50


def test_compatible_is_what_merging_gives(encoder):
    rnd = random.Random(6)
    pieces = sorted(encoder.reachable)
    marks = [p for p in pieces if not p.strip(piece_bpe.MARK)]
    for _ in range(30_000):
        a, b = rnd.choice(pieces), rnd.choice(pieces)
        if rnd.random() < 0.1:
            a, b = rnd.choice(marks), rnd.choice(marks)
        assert encoder.compatible(a, b) == (encoder.merge(a + b) == [a, b]), (a, b)


def test_documents(spark, library):
    docs = texts_given() + [(9001, None), (9002, ""), (9003, " \n "), (9004, "wort " * 20_000),
                            (9004, "wort " * 20_000), (None, "no id")]
    rows = piece_bpe.encode(clashing(documents(spark, docs)), PATH, with_ids=True).collect()
    assert len(rows) == len(docs)
    by_text = {}
    for (d, t) in docs:
        ids = library.encode(t or "")
        by_text.setdefault(d, []).append((
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(library.decode(ids).encode() if ids else b"").hexdigest(), ids))
    for r in rows:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["ids"]) in by_text[r["doc_id"]]
        assert library.decode(r["ids"]) == r["decoded"] if r["ids"] else r["decoded"] == ""
    assert piece_bpe.encode(documents(spark, []), PATH).collect() == []


def test_a_word_before_a_full_stop_is_encoded_once(library, monkeypatch):
    fresh, walked = piece_bpe.PieceBpe(PATH), []
    walk = fresh.pieces
    monkeypatch.setattr(fresh, "pieces", lambda t: walked.append(t) or walk(t))
    text = "x wortig wortig. wortig, a wortig."
    assert fresh(text)[1] == library.encode(text)
    assert [t for t in walked if "wortig" in t] == ["\u2581wortig"]
