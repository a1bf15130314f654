"""Readers of the Parquet tables that the registered queries run on."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; Spark reads it, so any Hadoop path will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
