"""Registered queries of the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mendwell.llm import chat, exact_dedup, mixing, near_dups, neighbours, packing, phrases, prefix_trie, quality, secrets, sharding, token_counts, url_filter
from mendwell.llm.oracles import ORACLES


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.report(_table(spark, folder, "documents"))


def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_dups.report(_table(spark, folder, "documents"))


def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.report(_table(spark, folder, "documents"))


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    return url_filter.report(pages, url_filter.document_marks(pages, _table(spark, folder, "labels")))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.report(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.report(_table(spark, folder, "documents"))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    quality = mixing.label_weights(_table(spark, folder, "labels"))
    return mixing.report(_table(spark, folder, "documents"), quality)


def op8_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.report(_table(spark, folder, "embeddings"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.report(_table(spark, folder, "documents"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.report(_table(spark, folder, "documents"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.report(_table(spark, folder, "conversations"))


def op12_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    return chat.report(_table(spark, folder, "conversations"))


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.report(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_sharding": op3_sharding,
    "op4_url_filter": op4_url_filter,
    "op5_quality": op5_quality,
    "op6_secret_scan": op6_secret_scan,
    "op7_mixing": op7_mixing,
    "op8_neighbours": op8_neighbours,
    "op9_token_counts": op9_token_counts,
    "op10_packing": op10_packing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_chat_windows": op12_chat_windows,
    "op13_phrases": op13_phrases,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
