"""Readers for the Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of long texts. Analysing a text costs more than reading it, so its splits should be smaller than
    those of other tables: ``spark.sql.files.maxPartitionBytes`` and the row groups decide that."""
    return table(spark, folder, name)
