"""One registered query per operator, each over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractflow.llm import classlm, hnsw, html, langid, mixing, negatives, pieces, resampling, sharding, simhash, topk, toxicity, warc
from contractflow.llm.common import bound_batches, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(function: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(bound_batches(spark), folder)

    QUERIES[function.__name__] = run
    return function


@query
def op1_simhash(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint("fingerprint").alias("fingerprint"), "component_id")


@query
def op2_top_k(spark, folder):
    return topk.top_k(table(spark, folder, "embeddings"), k=20, scale=64.0)


ORACLE["op2_top_k"] = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS vector
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.vector, c.vector) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.vector) = len(c.vector)),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query
def op3_toxicity(spark, folder):
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op4_pieces(spark, folder):
    return pieces.sample_segmentations(table(spark, folder, "documents"), k=2)


@query
def op5_warc(spark, folder):
    return warc.round_trip(table(spark, folder, "pages"), least_bytes=0)


ORACLE["op5_warc"] = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
facts AS (
  SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS digest,
    max(page_id) OVER (PARTITION BY payload) AS first
  FROM payloads)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(digest, 5 * CAST(i // 4 AS INTEGER) + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31
      AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM facts
"""


@query
def op6_hnsw(spark, folder):
    return hnsw.nearest(table(spark, folder, "embeddings"), k=20)


@query
def op7_mixing(spark, folder):
    return mixing.mix_report(table(spark, folder, "documents"))


@query
def op8_language(spark, folder):
    return langid.identify_languages(table(spark, folder, "documents"))


@query
def op9_sharding(spark, folder):
    placed = sharding.shard_by_bytes(table(spark, folder, "documents"), 16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_html(spark, folder):
    return html.main_texts(table(spark, folder, "pages"))


@query
def op11_class_lm(spark, folder):
    return classlm.score_texts(table(spark, folder, "documents"))


@query
def op12_resampling(spark, folder):
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLE["op12_resampling"] = """
WITH RECURSIVE crc AS (
  SELECT list(CAST(c AS BIGINT) ORDER BY i) AS steps FROM (
    SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k:
      CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
texts AS (
  SELECT 1 AS side, doc_id, row_number() OVER () AS row, text FROM documents
  UNION ALL SELECT 2, NULL, NULL, text FROM benchmark),
cut AS (
  SELECT side, doc_id, row, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM texts),
counted AS (SELECT side, row, word, count(*) AS n FROM cut GROUP BY ALL),
hashed AS (
  SELECT word, xor(list_reduce(
    list_concat([4294967295], list_transform(range(strlen(word)), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM counted), crc),
totals AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 1), 0) AS s, coalesce(sum(n) FILTER (side = 2), 0) AS t
  FROM counted JOIN hashed USING (word) GROUP BY bucket),
whole AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM totals),
gained AS (
  SELECT bucket, CAST(floor(1000 * ln((totals.t + 1)::DOUBLE * (whole.s + 10000) / ((totals.s + 1)::DOUBLE * (whole.t + 10000)))) AS BIGINT)
    AS gain FROM totals, whole),
weights AS (
  SELECT row, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight
  FROM counted JOIN hashed USING (word) JOIN gained USING (bucket) WHERE side = 1 GROUP BY row),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
    (CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM texts LEFT JOIN weights USING (row) WHERE side = 1),
numbered AS (
  SELECT *, n_features >= 20 AS able, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
    10 * count(*) FILTER (n_features >= 20) OVER () // 100 AS quota FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= quota THEN place END AS rank FROM numbered
"""


@query
def op13_hard_negatives(spark, folder):
    return negatives.hard_negatives(table(spark, folder, "embeddings"))


ORACLE["op13_hard_negatives"] = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vector
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.vector, c.vector) AS BIGINT) AS score
  FROM usable a JOIN usable c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id AND len(a.vector) = len(c.vector)),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
inside AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, n.vec_id AS negative_id, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM inside WHERE rank <= 3
"""
