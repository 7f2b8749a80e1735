"""Small tables for the tests of the operators."""

import glob

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"

INTERNAL = (
    "id", "n", "h", "key", "doc", "rank", "score", "component", "start", "offset", "x", "d",
    "__row", "__weak", "__base", "__spans", "__added", "__doc", "__key", "__runs", "__text",
    "__gone", "__ll", "__letters", "__map", "__declared", "__suffix", "__host", "__domain",
    "__score", "__best", "__at", "__post", "p_host", "p_domain", "l_declared", "l_suffix",
    "bucket", "i", "l", "node", "other", "a", "b", "s", "e", "w", "kind", "block", "part")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, start=0, schema=SCHEMA):
    """Documents from texts or (id, text) pairs."""
    rows = [t if isinstance(t, tuple) else (start + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(
        [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], schema)


def given(table):
    return pq.read_table(glob.glob(f"{SF}/{table}.parquet")).to_pylist()


def texts_given(n=None):
    return [(r["doc_id"], r["text"]) for r in given("documents")[:n]]


def clashing(df):
    """``df`` with more columns, named like those that operators use."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(7) for c in INTERNAL if c not in df.columns})
