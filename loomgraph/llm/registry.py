"""The thin ``opN_<name>`` queries over the driver's tables, and their oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, html_text, near_dedup, oracles, quality, secrets, suffix_dedup, token_counts, toxicity, warc
from .common import scratch_path, table


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by a cache that starts empty, so every distinct text is encoded."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), scratch_path(spark, "token-cache"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by a ledger that starts empty, so every distinct blob is scanned."""
    return secrets.digest_columns(secrets.scan(table(spark, sf_dir, "documents"), scratch_path(spark, "secret-ledger")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest_columns(found)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_duplicates": op1_near_duplicates,
        "op2_token_counts": op2_token_counts,
        "op3_secret_scan": op3_secret_scan,
        "op4_toxicity": op4_toxicity,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_html_text": op6_html_text,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_quality_rules": op8_quality_rules,
        "op9_warc": op9_warc,
        "op10_decontamination": op10_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    """SQL can express neither a tokenizer, nor learning, nor page parsing."""
    return dict(oracles.SQL)
