"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colform.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
