"""Readers for document and event tables."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan one Parquet table; column pruning and filters are left to Catalyst."""
    return spark.read.parquet(f"{root}/{name}.parquet")
