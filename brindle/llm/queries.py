"""The queries of this subpackage: thin, over whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import decontamination, language, licenses, mixing, near_duplicates, neighbours, pii, quality, suffix_dedup, window_dedup
from brindle.llm._tables import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.dedup(table(spark, sf_dir, "documents"), with_text=False)


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.link(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), with_text=False)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_license_scan, op3_window_dedup, op4_neighbours, op5_decontamination, op6_jaccard_join, op7_pii, op8_mixing, op9_suffix_dedup, op10_quality)}


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": licenses.oracle(), "op3_window_dedup": window_dedup.oracle(), "op6_jaccard_join": near_duplicates.oracle(), "op8_mixing": mixing.oracle()}
