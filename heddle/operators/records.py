"""Updates of single fields of a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from heddle.functions import checked


def set_flag(rows: DataFrame, record: str, field: str, value: Column) -> DataFrame:
    """``rows`` with one boolean field of a struct set from a three-valued input; the other fields stay."""
    return rows.withColumn(record, rows[record].withField(field, checked(value)))
