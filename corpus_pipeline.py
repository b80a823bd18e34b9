"""From raw documents to token ids: quality rules, near-dedup, secret scan, source mix, encoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake import session
from threatlake.llm import bpe, minhash, mixing, quality, secret_scan
from threatlake.llm.queries import vocabulary_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or the compression bands reject."""
    return quality.filter_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return minhash.drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by its kind; all documents stay."""
    return secret_scan.redact(docs, length="n_chars")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks of the mix: a row for each piece of a document, as often as the mix takes it."""
    return mixing.mix(docs, length="n_chars")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every piece, and the text that they decode to."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary_path(), decoded="decoded")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("secret_scan", secrets),
    ("source_mix", source_mix), ("bpe_encoding", encoding)]

#: Compression ratios and merges of a vocabulary are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over `documents`; each result is written to the shared folder and reread."""
    session.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = session.land(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
