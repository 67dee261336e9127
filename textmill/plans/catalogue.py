"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textmill.plans import curation, experiments, roundtrips, sequences
from textmill.plans.curation import curated_documents  # noqa: F401

_PARTS = (curation, sequences, experiments, roundtrips)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for part in _PARTS for k, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for part in _PARTS for k, sql in part.ORACLES.items()}
