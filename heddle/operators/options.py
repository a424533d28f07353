"""Option lists: type-to-filter search and one-to-one projection.

That search is a case-insensitive substring test is an assumption; the rule's source could not be seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search(options: DataFrame, column: str, query: str) -> DataFrame:
    """Options whose text contains ``query``, whatever the case; an empty query keeps all that are not null."""
    return options.filter(F.contains(F.lower(column), F.lower(F.lit(query))))


def search_or_message(options: DataFrame, column: str, query: str, message: str) -> DataFrame:
    """``item, message``: the texts that ``search`` finds, or if there are none one row with the message for an empty result."""
    found = search(options, column, query).select(F.col(column).alias("item"), F.lit(None).cast("string").alias("message"))
    hits = search(options, column, query).limit(1).agg(F.count("*").alias("n"))  # one row, after one hit at most for each task
    return found.union(hits.filter("n = 0").select(F.lit(None).cast("string"), F.lit(message)))


def items_of(options: Column, **outputs) -> Column:
    """The same projection of an array of options, in its order; each output is made from an element and its place."""
    return F.transform(options, lambda x, i: F.struct(*[value(x, i).alias(name) for name, value in outputs.items()]))


def items(options: DataFrame, **outputs: Column) -> DataFrame:
    """One output row per option."""
    return options.select(*[value.alias(name) for name, value in outputs.items()])
