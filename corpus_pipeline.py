"""The corpus pipeline: five stages from ``documents`` to packed training windows.

Each stage takes ``(spark, docs, sf_dir)``, where ``docs`` is what the stage before it kept,
and returns a DataFrame, which is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``.

Defined results: a null or empty text fails the first stage's rules and goes; rows that repeat
an id and a text are one document after the second stage, rows that repeat an id with different
texts stay apart; a null source is a source of its own; of equal documents the one with the least
id stays; an empty table gives an empty result; columns that ``documents`` has besides its own pass
through all stages but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradloom.llm import order_minhash, packing, rule_ledger, secret_scan, source_mix
from gradloom.llm.common import cut
from gradloom.llm.queries import tokenizer_path

MASK = "[SECRET]"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the current policy rejects."""
    return rule_ledger.keep(docs, "web-2")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return order_minhash.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, credentials that look live masked; ``n_chars`` follows the text."""
    masked = secret_scan.mask_live(docs, mask=MASK)
    return masked.withColumn("n_chars", F.when(F.contains("text", F.lit(MASK)), F.length("text")).otherwise(F.col("n_chars")))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by target weights; a document stands as often as the mix uses it."""
    return source_mix.select(docs)


def window_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in windows of 1024 ids. Workers keep their caches while other
    stages run, so these are smaller than where packing runs alone."""
    return packing.op9(docs, tokenizer_path("byte_bpe_50k.json"), cache=150_000, at_a_time=2_000_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("secret scans", secret_scans),
    ("source mixing", source_mixing),
    ("window packing", window_packing),
]

#: SQL can express neither the alignment of the second stage nor the tokenizer of the last.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
