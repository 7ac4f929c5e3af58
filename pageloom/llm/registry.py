"""The queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import uuid

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html, license, packing, pii, quality, sharding, simhash, topk
from .common import checkpoint_dir, read_table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(read_table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = html.extract(read_table(spark, sf_dir, "pages"))
    return made.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bpe.encode_decode(read_table(spark, sf_dir, "documents"))
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return made.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = f"{checkpoint_dir(spark)}/slot_maps/{uuid.uuid4().hex}"
    made = sharding.shard(read_table(spark, sf_dir, "documents"), store)
    return made.select("doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = license.licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.spans(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    counts = [count(k) for k in pii.BASE]
    return made.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), F.size("pii").cast("bigint").alias("n_spans"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return made.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quality.quality(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_html_extraction": op2_html_extraction,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_sharding": op4_sharding,
    "op5_license_scan": op5_license_scan,
    "op6_pii": op6_pii,
    "op7_simhash": op7_simhash,
    "op8_top_k": op8_top_k,
    "op9_quality": op9_quality,
    "op10_packing": op10_packing,
    "pipeline": corpus_pipeline.run,
}

_TOP_K_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

#: Operators whose full result SQL can express; the others are tested against brute force in tests/llm.
ORACLE_SQL = {"op5_license_scan": license.oracle_sql(), "op8_top_k": _TOP_K_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
