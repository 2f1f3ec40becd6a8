"""The queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gradloom.llm import chat_format, hard_negatives, multi_index, order_minhash, packing, pii, rule_ledger, secret_scan, source_mix, text_density, token_files, url_reputation, whitening
from gradloom.llm.oracle import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES", "tokenizer_path"]


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file stands; its folder is not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pfor_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.op1(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.op2(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.op3(_table(spark, sf_dir, "documents"))


def op4_deobfuscated_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op4(_table(spark, sf_dir, "documents"))


def op5_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_density.op5(_table(spark, sf_dir, "pages"))


def op6_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.op6(_table(spark, sf_dir, "documents"))


def op7_flow_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.op7(_table(spark, sf_dir, "documents"))


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.op8(_table(spark, sf_dir, "embeddings"))


def op9_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op9(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ledger.op10(_table(spark, sf_dir, "documents"))


def op11_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.op11(_table(spark, sf_dir, "embeddings"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.op12(_table(spark, sf_dir, "conversations"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.op13(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_pfor_files, op2_url_reputation, op3_order_minhash, op4_deobfuscated_pii, op5_text_density, op6_secret_ownership, op7_flow_mix, op8_multi_index, op9_sum_of_squares,
    op10_rule_ledger, op11_bit_sliced, op12_chat_format, op13_whitening,
)}
