"""Readers of the stored tables: Parquet with a fixed schema where one is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The stored table ``name``; a file or a folder of files."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
