import random

import pytest

import corpus_pipeline

from .helpers import SCHEMA, given


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """The given documents with planted cases."""
    rnd = random.Random(1)
    docs = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in given("documents")]
    clean = next(r for r in docs if r[2] == "en" and 1500 < len(r[1]) < 4000)
    words = clean[1].split(" ")
    near = list(words)
    near[3] = "otherword"
    passage = " ".join(f"passage{i}" for i in range(55))
    text = lambda: " ".join(rnd.sample(words, 60))
    planted = {90_000: clean[1], 90_001: " ".join(near).replace("\n", " "),
               90_002: f"{text()}\n{passage}\n{text()}", 90_003: f"{text()}\n{passage}\n{text()}",
               90_004: "token = 0123456789abcdef0123456789abcdef " + text(), 90_005: "#### 1234 ++++",
               90_006: None, 90_007: ""}
    rows = docs + [(i, t, "en", "src0", len(t or "")) for i, t in planted.items()]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        out.write.parquet(f"{sf_dir}/{name}.parquet")
        docs = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    start, language, lines, near, secrets = kept
    assert not set(language) & {90_005, 90_006, 90_007}
    assert len(set(start) - set(language)) <= 3 + 0.01 * len(start)
    assert "passage0 " in lines[90_002] and "passage" not in lines[90_003]
    assert 90_000 not in lines                      # every line occurs earlier
    assert 90_001 not in near                       # a near copy on one line
    assert "[REDACTED]" in secrets[90_004] and "0123456789abcdef" not in secrets[90_004]
    assert set(secrets) == set(near)
    untouched = [i for i in near if near[i] == start[i]]
    assert len(untouched) > 0.5 * len(start)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in pieces} == set(secrets)


def test_run_equals_the_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{sf_dir}/again-{name}")
        docs = spark.read.parquet(f"{sf_dir}/again-{name}")
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got = corpus_pipeline.run(spark, sf_dir).select(*key)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.select(*key).collect()))


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
