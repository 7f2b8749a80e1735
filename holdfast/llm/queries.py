"""Queries of this subpackage, registered by the entry module."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann, credentials, exact_topk, fingerprints, hard_negatives, language_id, line_dedup,
               lm_scoring, merkle, ngram_join, packing, piece_bpe, warc)
from .common import read


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"),
                        public_tokenizers.path("byte_bpe_50k.json"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode(read(spark, sf_dir, "documents"),
                            public_tokenizers.path("piece_bpe_32k.model"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.report(read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, counts=True).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256)
        .alias("text_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return language_id.identify_documents(docs, columns=["doc_id", "lang", "source"])


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_id.fit(read(spark, sf_dir, "documents"))
    return language_id.identify_pages(read(spark, sf_dir, "pages"), model)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.search(read(spark, sf_dir, "embeddings"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(read(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(read(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return merkle.verify(read(spark, sf_dir, "documents"), tampered)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", label))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(read(spark, sf_dir, "documents").select("doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_packing, op2_ann, op3_sentencepiece, op4_secrets, op5_line_dedup, op6_language_id,
        op7_exact_topk, op8_warc, op9_lm_scoring, op10_ngram_join, op11_merkle_manifest,
        op12_hard_negatives, op13_fingerprints, pages_language_id, pipeline)}

ORACLES: dict[str, str] = {
    "op7_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER)
            AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END
         AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f""",
    "op11_merkle_manifest": """
WITH RECURSIVE bytes AS (
  SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents WHERE doc_id IS NOT NULL),
crc AS (                                    -- CRC-32, one step per bit
  SELECT doc_id, s, 0 AS bit, 4294967295::BIGINT AS c FROM bytes
  UNION ALL
  SELECT doc_id, s, bit + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END
  FROM (SELECT doc_id, s, bit,
               CASE WHEN bit % 8 = 0 THEN xor(c, ascii(s[bit // 8 + 1])) ELSE c END AS x FROM crc)
  WHERE bit < 8 * length(s)),
hit AS (SELECT doc_id FROM crc WHERE bit = 8 * length(s) AND xor(c, 4294967295) % 7 = 0),
f AS (
  SELECT doc_id, lang,
    coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') AS a,
    coalesce(octet_length(encode(source)) || ':' || source, '-') AS b,
    coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS c,
    coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS d,
    coalesce(octet_length(encode(CAST(n_chars + 1 AS VARCHAR))) || ':' || (n_chars + 1), '-') AS d1,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS e,
    doc_id IN (SELECT doc_id FROM hit) AS bad
  FROM documents),
g AS (
  SELECT doc_id, lang, sha256(a || b || c || d || e) AS leaf,
         sha256(a || b || c || CASE WHEN bad THEN d1 ELSE d END || e) AS checked FROM f),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS n FROM g),
low AS (
  SELECT 0 AS level, lang, pos AS i, leaf AS h, n FROM leaves
  UNION ALL
  SELECT level + 1, lang, i // 2, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 1) // 2
  FROM low WHERE n > 1 GROUP BY level, lang, i // 2),
tips AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n
  FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, i, h, n FROM tips
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 1) // 2
  FROM high WHERE n > 1 GROUP BY level, i // 2),
walk AS (                                   -- from a leaf to its subroot
  SELECT doc_id, lang, leaf, pos, 0 AS level, pos AS i, n, checked AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT w.doc_id, w.lang, w.leaf, w.pos, w.level + 1, w.i // 2, (w.n + 1) // 2,
         sha256(CASE WHEN w.i % 2 = 1 THEN s.h || w.h ELSE w.h || coalesce(s.h, '') END),
         w.proof || coalesce(s.h, '')
  FROM walk w LEFT JOIN low s ON s.level = w.level AND s.lang IS NOT DISTINCT FROM w.lang
    AND s.i = w.i + 1 - 2 * (w.i % 2)
  WHERE w.n > 1),
climb AS (                                  -- and on to the root
  SELECT w.doc_id, w.leaf, w.pos, t.h AS subroot, 0 AS level, t.i, t.n, w.h, w.proof
  FROM walk w JOIN tips t ON w.n = 1 AND t.lang IS NOT DISTINCT FROM w.lang
  UNION ALL
  SELECT w.doc_id, w.leaf, w.pos, w.subroot, w.level + 1, w.i // 2, (w.n + 1) // 2,
         sha256(CASE WHEN w.i % 2 = 1 THEN s.h || w.h ELSE w.h || coalesce(s.h, '') END),
         w.proof || coalesce(s.h, '')
  FROM climb w LEFT JOIN high s ON s.level = w.level AND s.i = w.i + 1 - 2 * (w.i % 2)
  WHERE w.n > 1)
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, c.h AS folded_root,
       c.h = r.h AS verified
FROM climb c, (SELECT h FROM high WHERE n = 1) r WHERE c.n = 1""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_inner_product(a.w, c.w) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r
    FROM s WHERE same) WHERE r <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score,
         s.vec_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id
                                 ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score)
SELECT * FROM n WHERE rank <= 10""",
}
