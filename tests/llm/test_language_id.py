import pytest
from pyspark.sql import functions as F

from holdfast.llm import language_id

from .helpers import SF, clashing, documents, given


@pytest.fixture(scope="module")
def model(spark):
    return language_id.fit(spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 3 <> 0"))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 3 = 0")
    rows = language_id.identify(docs.drop("n_chars"), model).collect()
    right = sum(r["lang_text"] == r["lang"] for r in rows)
    assert right >= 0.97 * len(rows)
    assert sum(r["lang_kept"] for r in rows) >= 0.99 * len(rows)


def test_rejects_what_has_no_language(spark, model):
    texts = [None, "", " \n ", "12345 +++ ### 99", "The and of that the with in ere then."]
    out = language_id.identify(clashing(documents(spark, texts)), model, declared=F.col("lang"),
                               host=F.col("source")).orderBy("doc_id").collect()
    assert [r["lang_kept"] for r in out] == [False] * 4 + [True]
    assert [r["lang_id"] for r in out] == [None] * 4 + ["en"]
    assert [r["text"] for r in out] == texts


def test_evidence_is_fused_by_bayes(spark, model):
    """A short ambiguous text follows declaration and host; a long one its own words."""
    docs = [r for r in given("documents")]
    rows = [(r["doc_id"], r["text"], r["lang"], f"host-{r['lang']}", 0) for r in docs]
    rows += [(10_000, "on", "fr", "host-fr", 0), (10_001, "on", "en", "host-en", 0),
             (10_002, next(r["text"] for r in docs if r["lang"] == "de" and len(r["text"]) > 800),
              "fr", "host-fr", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r for r in language_id.identify_documents(df, model)
           .filter("doc_id >= 10000").collect()}
    assert [out[10_000 + i]["lang_id"] for i in range(3)] == ["fr", "en", "de"]


def test_host_prior_is_smoothed_towards_the_domain(spark, model):
    """The same text is less surely English on a new host of a French domain."""
    fr = [r["text"] for r in given("documents") if r["lang"] == "fr"][:15]
    en = [r["text"] for r in given("documents") if r["lang"] == "en"][:60]
    rows = [(i, t, f"h{i}.a.fr", "a.fr") for i, t in enumerate(fr)]
    rows += [(100 + i, t, f"h{i}.b.com", "b.com") for i, t in enumerate(en)]
    rows += [(1000, "on", "new.a.fr", "a.fr"), (1001, "on", "new.b.com", "b.com")]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, domain string")
    out = {r["doc_id"]: r for r in language_id.identify(
        df, model, host=F.col("host"), domain=F.col("domain")).collect()}
    assert out[1001]["lang_id"] == "en"
    assert out[1000]["lang_id"] == "fr" or \
        out[1000]["lang_posterior"] < out[1001]["lang_posterior"]


def test_pages(spark, model):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    odd = spark.createDataFrame([(9000, None, None), (9001, "no address", ""), (None, "", "<html>")],
                                "page_id long, url string, html string")
    rows = language_id.identify_pages(pages.unionByName(odd), model).collect()
    assert len(rows) == pages.count() + 3
    declared = {r["page_id"]: r["l"] for r in pages.select(
        "page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("l")).collect()}
    agree = [r["lang_id"] == declared[r["page_id"]] for r in rows
             if declared.get(r["page_id"]) in model.languages]
    assert sum(agree) >= 0.8 * len(agree)
    assert not any(r["lang_kept"] for r in rows if r["page_id"] in (9000, 9001, None))


def test_empty_table_repeated_rows_null_columns(spark, model):
    empty = documents(spark, [])
    assert language_id.identify_documents(empty).collect() == []
    df = spark.createDataFrame([(None, "the and of there", None, None, None)] * 2,
                               empty.schema)
    rows = language_id.identify_documents(df, model).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0]["lang_id"] == "en"
    assert language_id.identify_documents(df).filter("lang_kept").count() == 0   # nothing labelled


def test_very_long_text(spark, model):
    t = next(r["text"] for r in given("documents") if r["lang"] == "es")
    r = language_id.identify(documents(spark, [t * 400]), model).head()
    assert r["lang_id"] == "es" and r["lang_posterior"] == 1.0


def test_every_label_has_a_class(spark):
    """70 languages with words of their own, the rarest last; spellings of one label are one class."""
    name = [chr(97 + i // 10) + chr(107 + i % 10) for i in range(70)]
    rows = [(i * 10 + j, f"{n}{n[::-1]}q {n}zz{n} " * 20, [n, f"{n}-XX", f" {n.upper()}_yy "][j % 3])
            for i, n in enumerate(name) for j in range(9 if i < 64 else 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string") \
        .withColumn("source", F.lit("src0"))
    out = language_id.identify_documents(df).collect()
    assert len(out) == len(rows)
    assert all(r["lang_kept"] and r["lang_id"] == name[r["doc_id"] // 10] for r in out)


def test_what_the_model_does_not_have_is_kept(spark, model):
    rows = [(0, "qq zz xx", "fil"), (1, "123", "fil"), (2, "", "fil")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string") \
        .withColumn("source", F.lit(None).cast("string"))
    out = language_id.identify(df, model, declared=F.col("lang"), min_posterior=2.0) \
        .orderBy("doc_id").collect()
    assert [(r["lang_kept"], r["lang_id"]) for r in out] == [(True, None), (False, None), (False, None)]
