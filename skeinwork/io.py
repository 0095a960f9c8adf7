"""Loading the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read `<sf_dir>/<name>.parquet`; naming columns makes the intended projection explicit."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
