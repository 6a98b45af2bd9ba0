"""Readers of the driver's Parquet tables."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table under `sf_dir`, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
