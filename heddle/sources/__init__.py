"""Where rows come from: the driver's tables, and constant rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def constant(spark: SparkSession, value: str, name: str = "status") -> DataFrame:
    """One row with one constant, as a health check answers."""
    return spark.range(1).select(F.lit(value).alias(name))
