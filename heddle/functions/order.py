"""Ordered values as numbers, so that time and number columns can be dealt into blocks and bins alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def position(df: DataFrame, column: str) -> Column:
    """``column`` as a double that grows with it: whole seconds of a time, days of a date in seconds, a number itself.

    Times without zone are taken as they are written, so no clock change puts them out of order.
    """
    kind, value = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.DateType):
        return (F.unix_date(value) * F.lit(86_400)).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        day = F.unix_date(value.cast("date")).cast("long") * F.lit(86_400)
        return (day + F.hour(value) * 3600 + F.minute(value) * 60 + F.second(value)).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_seconds(value).cast("double")
    if isinstance(kind, T.NumericType):
        return value.cast("double")
    raise TypeError(f"{column} is neither a time nor a number")


def cell(df: DataFrame, column: str) -> Column:
    """``column`` as a whole number that tells all of its values apart: microseconds of a time, days of a date, a whole number itself."""
    kind, value = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("long")
    if isinstance(kind, T.TimestampNTZType):
        day = F.unix_date(value.cast("date")).cast("long") * F.lit(86_400)
        second = F.extract(F.lit("SECOND"), value) * F.lit(1_000_000)
        return (day + F.hour(value) * 3600 + F.minute(value) * 60) * F.lit(1_000_000) + second.cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, T.IntegralType):
        return value.cast("long")
    raise TypeError(f"{column} is neither a time nor a whole number")


def free(*frames: DataFrame, prefix: str = "_h") -> str:
    """A prefix that no column of the frames starts with, whatever the case."""
    taken = [c.lower() for df in frames for c in df.columns]
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return prefix


def fresh(df: DataFrame) -> DataFrame:
    """The same rows with columns of their own identity, so that a table can be joined to one made from it."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])
