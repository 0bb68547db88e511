"""The registry of queries over the driver's tables, and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import actions, beliefs, graphs, lifecycle, more, records, reports, scalars, search, streams  # noqa: F401  (each registers its queries)
from .registry import ORACLES, QUERIES, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["i01_bm25_search"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
