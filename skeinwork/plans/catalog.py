"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skeinwork.plans import aggregation, ingestion, modelling, monitoring, pipeline, recsys, relational, scalars, windows

MODULES = (pipeline, scalars, relational, aggregation, windows, recsys, monitoring, modelling, ingestion)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.p2_counts(spark, sf_dir)
