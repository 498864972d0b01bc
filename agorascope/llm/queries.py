"""The registered queries of the training-data operators, one per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from agorascope.llm import bpe, decontaminate, filter_audit, line_dedup, pii, prefix_trie, quality, sharding, simhash, suffix_dedup, token_counts, toxicity, url_rules
from agorascope.llm.common import table


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.components(table(spark, folder, "documents"))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), bpe.vocabulary(), ["doc_id"])


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shards(table(spark, folder, "documents"), 24)


def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.report(table(spark, folder, "documents"))


def op8_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.report(table(spark, folder, "pages"), table(spark, folder, "labels"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts.lengths(table(spark, folder, "documents"), bpe.vocabulary())
    return token_counts.histogram(counted)


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(table(spark, folder, "documents"))


def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.report(table(spark, folder, "documents"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.report(table(spark, folder, "conversations"))


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_decontaminate": op2_decontaminate,
    "op3_simhash": op3_simhash,
    "op4_quality": op4_quality,
    "op5_bpe": op5_bpe,
    "op6_sharding": op6_sharding,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_url_rules": op8_url_rules,
    "op9_token_counts": op9_token_counts,
    "op10_pii": op10_pii,
    "op11_line_dedup": op11_line_dedup,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES: dict[str, str] = {
    "op2_decontaminate": decontaminate.ORACLE,
    "op11_line_dedup": line_dedup.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
