"""The operators over their whole tables, as queries with fixed results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, jaccard, language, packing, pii, repeats, secrets, tokens, topk
from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_report(rows.unionByName(chat.probe(spark)))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(table(spark, sf_dir, "embeddings"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_chat_format, op3_jaccard_join, op4_token_counts, op5_pii, op6_exact_topk, op7_substring_dedup, op8_decontamination, op9_best_fit_packing, op10_language_id)}
SQL = {"op2_chat_format": chat.CHAT_SQL, "op3_jaccard_join": jaccard.SIMILAR_SQL, "op6_exact_topk": topk.TOPK_SQL, "op7_substring_dedup": repeats.REPEATS_SQL, "op8_decontamination": decontam.CONTAMINATION_SQL}
