"""Corpus pipeline over ``documents``: language ID, line dedup, n-gram Jaccard
join, secret scans, packing.

Each stage takes what its predecessor kept.  All but the last return the
columns of ``documents``; every result is written as Parquet and read again as
the next one's docs.  So a stage begins with deleting what earlier ones wrote
on the way; what its docs read is kept.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from holdfast.llm import credentials, language_id, line_dedup, ngram_join, packing
from holdfast.llm.common import discard, discard_unread, materialize, read, written

_LEFT: set[str] = set()         # tables that stages wrote on the way


def _stage(function):
    """A stage that first deletes what earlier stages left behind."""
    @wraps(function)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard_unread(_LEFT, docs)
        before = written()
        out = function(spark, docs, sf_dir)
        _LEFT.update(written() - before)
        return out
    return stage


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; others go."""
    return language_id.identify_documents(docs).filter("lang_kept").select(*docs.columns)


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without line runs of 50 words or more that occur earlier."""
    return line_dedup.dedup_lines(docs)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies."""
    return ngram_join.one_per_group(docs)


@_stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every found secret replaced by a marker."""
    return credentials.redact(docs)


@_stage
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed training sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language), ("line_dedup", lines), ("ngram_join", near_copies),
          ("secret_scan", secrets), ("packing", sequences)]

#: No SQL expresses language models, winnowing, or tokenizers; the tests hold
#: the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` on."""
    out = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        new = materialize(stage(spark, out, sf_dir), f"stage-{name}")
        if i:
            discard(out)
        out = new
    return out
