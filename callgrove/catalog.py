"""Registry of the queries and their SQL, gathered from the modules in callgrove.plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from callgrove.plans import concordance_queries, filter_queries, model_queries, pipeline_queries, projection_queries, source_queries, statistic_queries  # noqa: F401
from callgrove.plans.registry import ORACLES, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["cnc3_summary"](spark, sf_dir)
