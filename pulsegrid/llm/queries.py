"""Queries over the given tables, one per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import (
    adaptive_scan,
    conversation_repair,
    decontaminate,
    filtered_clustering,
    language,
    licenses,
    near_dedup,
    packing,
    quality,
    quotations,
    secrets,
    token_files,
    toxicity,
)
from pulsegrid.llm.checks import CHECKS
from pulsegrid.llm.common import table

__all__ = ["CHECKS", "QUERIES"]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classify(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op6_chat_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.conversations(table(spark, sf_dir, "conversations"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return packing.pack(documents, clusters=near_dedup.classify(documents).select("doc_id", "component_id"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(table(spark, sf_dir, "documents"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(table(spark, sf_dir, "conversations"))


def op12_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_scan.nearest(table(spark, sf_dir, "embeddings"))


def op13_filtered_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered_clustering.report(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_token_files, op3_toxicity, op4_near_duplicates, op5_license_scan, op6_chat_quotations,
        op7_decontamination, op8_secret_scan, op9_best_fit_packing, op10_language,
        op11_structure_repair, op12_adaptive_scan, op13_filtered_clustering,
    )
}
