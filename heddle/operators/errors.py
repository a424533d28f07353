"""Reduction of validation errors to what a form field shows.

Content given outright wins. Else errors are distinct by exact message (absent ones share a key), each at its
first position with its last value; one key gives a scalar, more give a list. The number of
keys counts before blank messages (absent or empty) are dropped, so a list can be empty. Entities without errors,
and those whose only key is blank, show nothing and have no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reduce_errors(rows: DataFrame, key: str, errors: str = "errors", content: str | None = None, whole: bool = False) -> DataFrame:
    """``key, kind, items``: kind is ``content``, ``scalar`` or ``list``; items are the messages shown, in order.

    With ``whole`` the items are the errors themselves, each with the fields of its last value (content: an error of that message, other fields null).

    ``errors`` is an array of structs with a ``message``; elements may be null. Lists are expected
    to be short (a field's errors): each comes together in one row, as it came in.
    """
    given = F.coalesce(rows[content] != "", F.lit(False)) if content else F.lit(False)
    each = rows.filter(~given).select(key, F.posexplode(errors).alias("pos", "error"))
    distinct = each.groupBy(key, F.col("error.message").alias("message")).agg(
        F.min("pos").alias("first"), F.max_by("error", "pos").alias("error")
    )
    counted = distinct.withColumn("keys", F.count("*").over(Window.partitionBy(key)))
    blank = F.coalesce(F.col("message") == "", F.lit(True))
    item = F.when(~blank, F.struct(F.col("first"), F.col("error")))
    shown = counted.groupBy(key).agg(F.max("keys").alias("keys"), F.sort_array(F.collect_list(item)).alias("items"))
    shape = (lambda x: x["error"]) if whole else (lambda x: x["error"]["message"])
    kept = shown.filter((F.col("keys") > 1) | (F.size("items") > 0)).select(
        key, F.when(F.col("keys") == 1, "scalar").otherwise("list").alias("kind"), F.transform("items", shape).alias("items")
    )
    if content is None:
        return kept
    told = F.col(content)
    if whole:
        kind = rows.schema[errors].dataType.elementType
        told = F.struct(*[(told if f.name == "message" else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind])
    return kept.union(rows.filter(given).select(key, F.lit("content"), F.array(told)))
