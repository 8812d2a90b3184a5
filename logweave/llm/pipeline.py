"""A training corpus from `documents`: good documents, no copies, no near copies, mixed sources, token ids.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's
docs. Every stage takes the columns of documents and drops others, whatever their names; each works on all rows that
its predecessor kept, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logweave.llm import exact_dedup, mixing, ngram_join, quality, spm
from logweave.llm.common import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Null and empty texts have the score of a text without words; a null id is an id without labels; rows that share an
    id or a text are judged by themselves, in bounded memory whatever a text's length. Without labels all stay.
    """
    return quality.keep_good(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the smallest doc_id; null counts as empty, null ids come last.

    Rows that share id and text are one document, of which one row stays; rows of one id with different texts are
    different documents. Texts of any length are hashed in place.
    """
    return exact_dedup.drop_exact(docs.select(*COLUMNS))


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id, as `drop_near` tells them.

    Documents without words stay; null ids come last and are told apart by their texts; a text takes memory in
    proportion to its words.
    """
    return ngram_join.drop_near(docs.select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight wants them; each at least once.

    A null source is a source; null and empty texts have no tokens and are read once for each full reading of their
    source; equal rows are read equally often.
    """
    return mixing.mix_sources(docs.select(*COLUMNS)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each reading of a document, checked to give the text back.

    Null and empty texts have no ids; null ids and repeated rows pass through; a text takes memory in proportion to
    its ids.
    """
    return spm.encode_documents(docs.select("doc_id", "source", "text"))


STAGES = [("quality", good), ("exact_dedup", distinct), ("near_dedup", dissimilar), ("mixing", mixed), ("tokens", tokens)]

#: SQL has no word for the trained classifier and the token search; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the whole of `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
