"""Distinct counts that can be merged: sketches per fine group, put together for coarser ones, beside the exact count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Binary logarithm of a sketch's registers; the relative standard error is some 1.04 / sqrt(2 ** LG).
LG = 12


def sketches(df: DataFrame, by: list[str], value: str, lg: int = LG) -> DataFrame:
    """One sketch per group (column ``sketch``), built on the map side; a sketch has some ``2 ** lg`` bytes however large its group. Nulls don't count."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(value, lg).alias("sketch"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups from those of finer ones, with their estimates; no row of the original table is read again."""
    both = parts.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))
    return both.withColumn("estimate", F.hll_sketch_estimate("sketch"))


def exact(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The exact count (column ``n``). Distinct pairs are made first, with partial sums, so that a hot group is spread over its values."""
    pairs = df.select(*by, value).distinct()
    return pairs.groupBy(*by).agg(F.count(value).alias("n"))


def bound(lg: int = LG, errors: float = 5.0) -> float:
    """The relative error that ``errors`` standard errors make."""
    return errors * 1.04 / 2 ** (lg / 2)
