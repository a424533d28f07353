"""Keyed constant lookups with a default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def variant(key: Column, variants: dict[str, str], default: str, on_unknown: str = "default") -> Column:
    """The variant of a key, for tables of a few entries.

    An absent key takes the default's. Null stands for absent: whether a key was left out or given as nothing, which the
    surveyed lookup tells apart, is one value here. A key that the table lacks takes the default's too or, with
    ``on_unknown="nothing"`` (as the surveyed lookup does), gives null.
    """
    pairs = [F.lit(x) for pair in variants.items() for x in pair]
    found, other = F.try_element_at(F.create_map(*pairs), key), F.lit(variants[default])
    if on_unknown == "default":
        return F.coalesce(found, other)
    return F.when(key.isNull(), other).otherwise(found)


def variants_of(*axes: tuple[Column, dict[str, str], str]) -> Column:
    """The variants of several axes (key, variants, default) in their order; axes whose key is unknown are left out."""
    return F.array_compact(F.array(*[variant(*axis, on_unknown="nothing") for axis in axes]))


def join_variants(rows: DataFrame, key: str, variants: DataFrame, default: str) -> DataFrame:
    """The same against a table ``key, value``; Spark broadcasts it if its size allows."""
    named = variants.select(F.col("key").alias("_key"), F.col("value").alias("variant"))
    fallback = variants.filter(F.col("key") == default).agg(F.first("value").alias("_default"))  # one row
    joined = rows.join(named, rows[key] == F.col("_key"), "left").join(F.broadcast(fallback))
    return joined.withColumn("variant", F.coalesce("variant", "_default")).drop("_key", "_default")
