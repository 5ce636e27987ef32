"""Parquet tables of a library directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``root`` (one file or a directory of parts)."""
    return spark.read.parquet(f"{root}/{name}.parquet")
