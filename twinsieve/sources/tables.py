"""Parquet table source of the test schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinsieve.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads <sf_dir>/<name>.parquet, a file or a folder of parts."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
