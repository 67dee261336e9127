"""The queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.containers import chatml_size, container_report, fill_containers
from textmill.llm.languages import fit_profiles
from textmill.llm.leaks import leak_report, leaked_items
from textmill.llm.mixture import mix_sources, mixture_report
from textmill.llm.near_duplicates import near_duplicate_classes, near_duplicate_pairs
from textmill.llm.pairs import pair_defects
from textmill.llm.sentences import sentence_units


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = near_duplicate_pairs(spark.read.parquet(f"{d}/filter_results.parquet"), "sample_id", "sample", threshold=0.70, size=3)
    return pairs.withColumnsRenamed({"id_a": "sample_id_a", "id_b": "sample_id_b"})


def _test_items(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/eval_items.parquet").where("split = 'test'").select("item_id", "question", "lang").distinct()


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of documents at the usual five words and 0.8."""
    return near_duplicate_classes(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text")


def _conversations(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", chatml_size().alias("size")).where("size is not null")


def p2_packed(spark: SparkSession, d: str) -> DataFrame:
    return fill_containers(_conversations(spark, d), spark.read.parquet(f"{d}/pack_targets.parquet"), "conv_id", "size")


def p2_unused(spark: SparkSession, d: str) -> DataFrame:
    return container_report(p2_packed(spark, d), spark.read.parquet(f"{d}/pack_targets.parquet"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    profiles = fit_profiles(spark.read.parquet(f"{d}/documents.parquet"))
    return pair_defects(spark.read.parquet(f"{d}/preference_pairs.parquet"), profiles)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(spark.read.parquet(f"{d}/documents.parquet"), _test_items(spark, d)).select("doc_id", "item_id").distinct()


def p4_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Items that leaked in pieces of five words or more, in any order."""
    leaks = leaked_items(spark.read.parquet(f"{d}/documents.parquet"), _test_items(spark, d), min_run=5, min_run_dense=10)
    return leak_report(leaks.where(F.col("covered") * 2 >= F.col("item_size")))


def p5_mixtures(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/mixture_targets.parquet"))


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture_report(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/mixture_targets.parquet"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return sentence_units(spark.read.parquet(f"{d}/documents.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_classes": p1_classes, "p2_packed": p2_packed, "p2_unused": p2_unused, "p3_found": p3_found, "p4_found": p4_found, "p4_coverage": p4_coverage, "p5_mixtures": p5_mixtures, "p5_shares": p5_shares, "p6_found": p6_found}


def oracle_sql() -> dict[str, str]:
    from textmill.llm import oracles

    return oracles.oracle_sql()
