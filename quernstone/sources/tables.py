"""Reading the Parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import reachable


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{folder}/{name}.parquet")
