"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm import bpe, chat, decontam, licenses, linededup, lmscore, pii, quality, simhash, tokencount
from inkstone.llm.sql import ORACLE

#: The key of the pseudonyms; a deployment passes its own to the operator.
KEY = "inkstone"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontam.report(decontam.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the decision list's verdict for every document."""
    out = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document and of each of its lines."""
    return tokencount.count(_table(spark, sf_dir, "documents"), RANKS)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and matching templates of every document."""
    return licenses.report(licenses.find(_table(spark, sf_dir, "documents")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the later occurrences of three-line windows."""
    return linededup.deduplicate(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document."""
    return lmscore.cross_entropy_difference(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every document."""
    return bpe.digests(_table(spark, sf_dir, "documents"), RANKS)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms in place of personal data."""
    return pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), KEY).select("doc_id", *[F.coalesce(F.col("found")[k], F.lit(0)).alias(f"n_{k}") for k in pii.KINDS], "text")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, formatted and read back, and the probe."""
    return chat.format_report(chat.with_probe(_table(spark, sf_dir, "conversations")), RANKS)


def queries() -> dict[str, Query]:
    """By name."""
    found = [
        op1_decontamination,
        op2_quality_rules,
        op3_token_counts,
        op4_license_scan,
        op5_line_dedup,
        op6_simhash,
        op7_lm_scoring,
        op8_byte_bpe,
        op9_pii,
        op10_chat_format,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return dict(ORACLE)
