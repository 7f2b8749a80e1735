"""Columns named like those that operators use inside come out unchanged."""

import pytest
from pyspark.sql import functions as F

from holdfast.llm import credentials, language_id, line_dedup, ngram_join

from .helpers import INTERNAL, SF, clashing, documents

LINE = " ".join(f"word{i}" for i in range(60))


@pytest.mark.parametrize("operator", ["identify", "redact", "dedup_lines", "one_per_group"])
def test_kept_columns(spark, operator):
    texts = [LINE, LINE + "\nthe end of it", "password: hunter2secret", None, "", "x"]
    df = clashing(documents(spark, texts)).withColumn("lang_id", F.lit("old"))
    if operator == "identify":
        model = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet").limit(100))
        out = language_id.identify_documents(df, model)
        assert out.select("lang_id").distinct().filter("lang_id = 'old'").count() == 0
    else:
        out = {"redact": credentials.redact, "dedup_lines": line_dedup.dedup_lines,
               "one_per_group": ngram_join.one_per_group}[operator](df)
        assert out.columns == df.columns
    assert len(out.columns) == len(set(out.columns)) and set(df.columns) <= set(out.columns)
    rows = out.collect()
    assert len(rows) >= 4 and all(r[c] == 7 for r in rows for c in INTERNAL)
    assert all(not r["text"] or "hunter2secret" not in r["text"] for r in rows) \
        == (operator == "redact")
