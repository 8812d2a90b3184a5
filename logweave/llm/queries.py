"""The corpus operators as queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import exact_dedup, fill_middle, filter_audit, fingerprint, html_extract, minhash, mixing, ngram_join, quality, spm, substring, toxicity, warc


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_components(documents(spark, sf_dir))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_round_trip(pages(spark, sf_dir))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.document_fingerprints(documents(spark, sf_dir))


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(pages(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "source", "mix_epoch", "mix_order")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode_documents(documents(spark, sf_dir).select("doc_id", "text"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir), digest=True)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(documents(spark, sf_dir), labels(spark, sf_dir))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"))
    digest = lambda x: F.sha2(x, 256)
    chars = lambda c: F.char_length(c).cast("long").alias(c.removeprefix("fim_") + "_chars")
    return cut.select(
        "doc_id", F.col("fim_n").alias("n"), F.col("fim_form").alias("form"), chars("fim_prefix"), chars("fim_middle"),
        digest(F.col("fim_output")).alias("output_sha256"), digest(fill_middle.restored(F.col("fim_output"), F.col("fim_form"))).alias("restored_sha256"),
    )


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_components(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard": op1_ngram_jaccard,
        "op2_warc": op2_warc,
        "op3_fingerprints": op3_fingerprints,
        "op4_mixing": op4_mixing,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_html_main_text": op7_html_main_text,
        "op8_quality": op8_quality,
        "op9_repeated_passages": op9_repeated_passages,
        "op10_toxicity": op10_toxicity,
        "op11_filter_audit": op11_filter_audit,
        "op12_fill_middle": op12_fill_middle,
        "op13_minhash": op13_minhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op6_exact_dedup": OP6_SQL, "op11_filter_audit": filter_audit.SQL, "op12_fill_middle": fill_middle.SQL}


OP2_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p
), m AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS kept FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM m
"""


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM d
"""
