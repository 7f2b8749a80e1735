"""Language identification by Bayesian evidence fusion.

Text likelihoods come from character n-grams (naive Bayes, fitted on a bounded
sample of labelled rows).  They are fused with what the markup declares, with
the address suffix, and with a prior of the host.  How far declaration, suffix
and host can be trusted is learned from all rows by grouped aggregation of the
text decisions; the host prior is smoothed towards its domain, and the domain
towards the whole collection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, set_apart, values

BUCKETS = 1 << 14
_MIX = np.uint64(0x9E3779B97F4A7C15)


_BLANKS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def letters(text: str | None) -> bytes:
    """Lower-cased words of letters, between single blanks."""
    if not text:
        return b""
    words = text.lower().encode("utf-8").translate(_BLANKS).split()
    return b" " + b" ".join(words) + b" " if words else b""


def gram_counts(raw: bytes) -> np.ndarray:
    """How often every bucket of byte 1- to 4-grams occurs."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint64)
    total = np.zeros(BUCKETS, np.int64)
    h = np.zeros(len(b), np.uint64)
    for n in range(1, 5):
        if len(b) < n:
            break
        h = h[:len(b) - n + 1] * np.uint64(257) + b[n - 1:] + np.uint64(1)
        at = (h * _MIX) >> np.uint64(50)
        total += np.bincount(at.astype(np.int64), minlength=BUCKETS)
    return total


@dataclass(frozen=True)
class Model:
    """``logp[bucket, language]``; a last column stands for no language."""

    languages: tuple[str, ...]
    logp: np.ndarray


def primary(label: Column) -> Column:
    """The primary subtag of a language label ('en' of 'en-US' and ' EN_gb'),
    null if there is none."""
    tag = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]{2,8})(?:[-_]|$)", 1)
    return F.when(tag != "", tag)


def fit(labelled: DataFrame, per_language: int = 2_000,
        doc_id: str = "doc_id", text: str = "text", label: str = "lang") -> Model:
    """Fit on at most ``per_language`` labelled rows (those with the smallest
    hash of their id) of every primary subtag among the labels."""
    rows = labelled.select(F.col(doc_id).alias("id"), F.col(text).alias("text"),
                           primary(F.col(label)).alias("lang")) \
        .filter("lang is not null and length(text) > 0")
    langs = tuple(sorted(r["lang"] for r in rows.select("lang").distinct().collect()))
    if not langs:
        return Model((), np.full((BUCKETS, 1), -math.log(BUCKETS)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    ids = (rows.select("id", "lang")
           .withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language))
    # at most per_language pairs of two longs per language, so the texts mostly stay where they are
    few = ids.select(F.col("id").alias("i"), F.xxhash64("lang").alias("l"))
    if per_language * len(langs) * 16 <= 32 << 20:
        few = F.broadcast(few)
    sample = rows.join(few, (F.col("id") == F.col("i")) & (F.xxhash64("lang") == F.col("l")),
                       "left_semi")

    def count(batches):
        got: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, lang in zip(values(batch.column(0)), batch.column(1).to_pylist()):
                raw = letters(t)
                got[lang] = got.get(lang, 0) + gram_counts(raw)
        for lang, c in got.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()),
                 pa.array(c[at], pa.int64())], ["lang", "bucket", "n"])

    # at most BUCKETS rows per language
    counts = (sample.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    at = {x: i for i, x in enumerate(langs)}
    n = np.full((BUCKETS, len(langs) + 1), 0.5)
    n[counts["bucket"].to_numpy(), np.array([at[x] for x in counts["lang"].to_pylist()], int)] \
        += counts["n"].to_numpy()
    n[:, -1] = 1.0
    return Model(langs, np.log(n / n.sum(axis=0)))


def text_evidence(docs: DataFrame, model: Model, text: str, temper: float,
                  columns: list[str]) -> DataFrame:
    """The ``columns`` of ``docs`` with __ll (log likelihood of the text per
    language, the last for no language, each relative to the best) and
    __letters (bytes of words).

    N-grams overlap, so their sum is tempered by ``temper``; at 0.25 the four
    that end at a character count as one observation.
    """
    cast = docs.sparkSession.sparkContext.broadcast(model.logp)   # BUCKETS x languages
    k = len(model.languages) + 1

    def run(batches):
        logp = cast.value
        for batch in batches:
            ll, size = [], []
            for t in values(batch.column(text)):
                raw = letters(t)
                s = gram_counts(raw) @ logp if raw else np.zeros(k)
                ll.append(((s - s.max()) * temper).tolist())
                size.append(len(raw))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(ll, pa.list_(pa.float64())),
                 pa.array(size, pa.int64())], [*columns, "__ll", "__letters"])

    plain = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*columns, text])])
    schema = plain.select(*[F.col(f"`{c}`") for c in columns]).withColumns(
        {"__ll": F.array().cast("array<double>"), "__letters": F.lit(0).cast("long")}).schema
    return plain.mapInArrow(run, schema)


def _counts(rows: DataFrame, key: str, k: int) -> DataFrame:
    """Text decisions per value of ``key``: an array of ``k`` numbers."""
    pairs = (rows.filter(F.col(key).isNotNull() & F.col("__map").isNotNull())
             .groupBy(key, "__map").agg(F.count(F.lit(1)).cast("double").alias("n")))
    return pairs.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("__map", "n"))).alias("m")).select(
        key, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(
            F.element_at("m", i), F.lit(0.0))).alias("c"))


def identify(docs: DataFrame, model: Model, text: str = "text", declared: Column | None = None,
             suffix: Column | None = None, host: Column | None = None,
             domain: Column | None = None, temper: float = 0.25, strength: float = 20.0,
             min_posterior: float = 0.5, columns: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_id, lang_posterior, lang_text (the text's own vote)
    and lang_kept.  With ``columns``, only those of ``docs`` are kept and
    written on the way; whole texts need not be.

    Evidence that is null is left out.  A document is rejected (lang_kept
    false, lang_id null) if its text has no letters or if no language reaches
    ``min_posterior``, the column "no language" included, so a null or empty
    text is rejected whatever is declared.  What declares a language that the
    model does not have is kept if it has letters (lang_id null if no language
    reaches ``min_posterior``).  Posteriors add over evidence, so
    ties need equal evidence; the alphabetically first language then wins.
    Rows are judged alike whether repeated or not; null ids do not matter; an
    empty table gives no row; other columns are kept.
    """
    k = len(model.languages) + 1
    null = F.lit(None).cast("string")
    # columns under generated names, the evidence from the given ones
    plain, back = set_apart(docs.select(*[F.col(f"`{c}`") for c in (
        docs.columns if columns is None else columns)]))
    columns = plain.columns
    rows = docs.select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(back(plain).columns, columns)],
        F.col(f"`{text}`").alias("__text"),
        primary(declared if declared is not None else null).alias("__declared"),
        (suffix if suffix is not None else null).alias("__suffix"),
        (host if host is not None else null).alias("__host"),
        (domain if domain is not None else null).alias("__domain"))
    seen = materialize(
        text_evidence(rows, model, "__text", temper, [
            *columns, "__declared", "__suffix", "__host", "__domain"]).withColumn(
            "__map", F.when(F.col("__letters") > 0,
                            F.array_position("__ll", F.array_max("__ll")).cast("int") - 1)),
        "text_evidence")
    votes = seen.select("__declared", "__suffix", "__host", "__domain", "__map")

    whole = {r["__map"]: r["count"] for r in
             votes.filter("__map is not null").groupBy("__map").count().collect()}
    total = [whole.get(i, 0) + 0.5 for i in range(k)]           # k numbers
    n = sum(total)
    base = F.array(*[F.lit(c / n) for c in total])

    def shrunk(counts: Column, towards: Column) -> Column:
        size = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, towards, lambda c, p: (c + strength * p) / (size + strength))

    domains = _counts(votes, "__domain", k).select("__domain", shrunk(F.col("c"), base).alias("p_domain"))
    # a host's domain is a function of the host; rows of a host without one fall back to the whole
    host_domain = votes.filter("__host is not null").groupBy("__host") \
        .agg(F.max("__domain").alias("__domain"))
    hosts = (_counts(votes, "__host", k).join(host_domain, "__host")
             .join(domains, "__domain", "left")
             .select("__host", shrunk(F.col("c"), F.coalesce("p_domain", base)).alias("p_host")))

    def likelihood(key: str, name: str) -> DataFrame:
        """log p(value | language), smoothed towards p(value)."""
        c = _counts(votes, key, k)
        share = F.aggregate(F.col("c"), F.lit(0.0), lambda a, x: a + x) / n
        sizes = F.array(*[F.lit(float(t)) for t in total])
        return c.select(key, F.zip_with("c", sizes, lambda x, t: F.log(
            (x + strength * share) / (t + strength))).alias(name))

    joined = (seen.join(hosts, "__host", "left")
              .join(likelihood("__declared", "l_declared"), "__declared", "left")
              .join(likelihood("__suffix", "l_suffix"), "__suffix", "left"))
    zero = F.array_repeat(F.lit(0.0), k)
    score = F.col("__ll")
    for term in (F.transform(F.coalesce("p_host", base), lambda p: F.log(p)), F.coalesce("l_declared", zero),
                 F.coalesce("l_suffix", zero)):
        score = F.zip_with(score, term, lambda a, b: a + b)
    names = F.array(*[F.lit(x) for x in (*model.languages, "")])
    out = (joined.withColumn("__score", score).withColumn("__best", F.array_max("__score"))
           .withColumn("__at", F.array_position("__score", F.col("__best")).cast("int"))
           .withColumn("__post", F.lit(1.0) / F.aggregate(
               F.transform("__score", lambda x: F.exp(x - F.col("__best"))), F.lit(0.0),
               lambda a, x: a + x)))
    told = (F.col("__letters") > 0) & (F.col("__at") < k) & (F.col("__post") >= min_posterior)
    other = (F.col("__letters") > 0) & F.col("__declared").isNotNull() \
        & ~F.col("__declared").isin(list(model.languages))
    return back(out.select(
        *columns,
        F.when(told, F.get(names, F.col("__at") - 1)).alias("lang_id"),
        F.round("__post", 6).alias("lang_posterior"),
        F.when(F.col("__map") < k - 1, F.get(names, F.col("__map"))).alias("lang_text"),
        (told | other).alias("lang_kept")))


def page_evidence(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with __text, __declared_lang, __suffix_of, __host_of and
    __domain_of, taken from markup and address."""
    h = F.coalesce(F.col(html), F.lit(""))
    body = F.regexp_replace(F.regexp_replace(
        h, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " "), r"(?s)<[^>]*>|&[a-zA-Z#0-9]+;", " ")
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")),
                                    r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))
    host = F.when(host != "", host)
    return pages.withColumns({
        "__text": body,
        "__declared_lang": F.regexp_extract(h, r"""(?is)<html\b[^>]*?\blang=["']?([a-z0-9_-]+)""", 1),
        "__suffix_of": F.substring_index(host, ".", -1), "__host_of": host,
        "__domain_of": F.substring_index(host, ".", -2)})


def identify_documents(docs: DataFrame, model: Model | None = None,
                       columns: list[str] | None = None) -> DataFrame:
    """:func:`identify` for (doc_id, text, lang, source) documents: ``lang``
    is what they declare, ``source`` their host.  Without a model one is
    fitted on them."""
    return identify(docs, model or fit(docs), "text", declared=F.col("lang"), host=F.col("source"),
                    columns=columns)


def identify_pages(pages: DataFrame, model: Model) -> DataFrame:
    """:func:`identify` for (page_id, url, html) pages, with the evidence of
    markup and address; page_id and the decision."""
    p = page_evidence(pages)
    return identify(p, model, "__text", declared=F.col("__declared_lang"),
                    suffix=F.col("__suffix_of"), host=F.col("__host_of"),
                    domain=F.col("__domain_of"), columns=["page_id"]) \
        .select("page_id", "lang_id", "lang_posterior", "lang_text", "lang_kept")
