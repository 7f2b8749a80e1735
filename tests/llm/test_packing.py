import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from holdfast.llm import packing

from .helpers import clashing, documents, texts_given

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def expected_ids(library, text):
    return np.asarray([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


@pytest.mark.parametrize("text", [
    "", " ", "  ", "a  b", " \n a\t\tb  \n", "it's  we'll 'S", "x" * 3000, " " * 2500,
    "<|endoftext|> ü ß 漢字 😀 　\x85\x1c end ", "12 345,678 -- ???"])
def test_ids_equal_the_library(library, text):
    assert np.frombuffer(packing.ByteBpe(PATH)(text), "<u4").tolist() == \
        library.encode(text, add_special_tokens=False).ids


def check(rows, docs, library, window=1024):
    want = [expected_ids(library, t) for _, t in docs]
    assert sorted((r["doc_id"], r["start"]) for r in rows if r["doc_id"] is not None) == sorted(
        (d, s) for (d, _), ids in zip(docs, want) if d is not None
        for s in range(0, len(ids), window))
    by_id = {d: ids for (d, _), ids in zip(docs, want)}
    for r in rows:
        ids = by_id[r["doc_id"]]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes())
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / sum(map(len, want)), sequences


def test_every_id_once_and_little_padding(spark, library):
    docs = texts_given() + [(10_000, None), (10_001, ""), (10_002, "word " * 5000)]
    rows = packing.pack(clashing(documents(spark, docs)), PATH).collect()
    padding, sequences = check(rows, docs, library)
    assert padding < 0.02
    assert sorted(sequences) == list(range(len(sequences)))
    load = Counter()
    for r in rows:
        load[r["step_group"]] += r["length"] ** 2
    full = sorted(load.values())
    assert full[-1] <= 1.5 * np.mean(full)


def test_repeated_rows_null_ids_and_empty_table(spark, library):
    docs = [(1, "the same"), (1, "the same"), (None, "no id"), (2, None)]
    rows = packing.pack(documents(spark, docs), PATH).collect()
    assert len(rows) == 4
    assert sorted((r["doc_id"] is None, r["doc_tokens"]) for r in rows) == [
        (False, 1), (False, 3), (False, 3), (True, 3)]
    assert packing.pack(documents(spark, []), PATH).collect() == []


def test_sequences_hold_the_ids(spark, library):
    docs = texts_given(30)
    df = documents(spark, docs)
    pieces = packing.pack(df, PATH).cache()
    want = {d: expected_ids(library, t) for d, t in docs}
    got = {r["sequence_id"]: r for r in packing.sequences(df, pieces, PATH).collect()}
    for p in pieces.collect():
        ids = got[p["sequence_id"]]["ids"][p["offset"]:p["offset"] + p["length"]]
        assert ids == want[p["doc_id"]][p["start"]:p["start"] + p["length"]].tolist()
    assert all(len(r["ids"]) == 1024 or len(r["ids"]) & (len(r["ids"]) - 1) == 0
               for r in got.values())


@pytest.mark.parametrize("sizes", [{1023: 3}, {1: 5000}, {600: 10, 300: 10, 100: 21, 512: 3},
                                   {k: k % 7 for k in range(1, 1024)}, {}])
def test_plan_places_every_remainder_once(sizes):
    seen = Counter()
    for g in packing.plan(sizes, (1024, 512, 256, 128)):
        at = 0
        for size, rank, offset in g.parts:
            assert offset == at
            at += size
            for r in range(rank, rank + g.n):
                seen[size, r] += 1
        assert at == g.used <= 1024
    assert seen == {(k, r): 1 for k, n in sizes.items() for r in range(n)}
