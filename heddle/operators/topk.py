"""The greatest rows of each group and of all rows, chosen before anything is shuffled as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.order import free

#: Parts into which a group is dealt for the first choice.
PARTS = 64


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, parts: int = PARTS, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group by ``order``, with their place (from 1) in the column ``rank``.

    A group is dealt to ``parts`` parts by a hash of its rows; each part's first ``k`` go on to the choice for the whole group. So a group of
    any size sends ``parts * k`` rows to one task at most. ``order`` should end in a key: rows that it doesn't tell apart are taken in any order.
    Null is a group of its own. Columns of maps, which have no hash, are not dealt by.
    """
    p = free(df)
    if rank.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {rank}")
    plain = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    part = F.pmod(F.xxhash64(*plain), F.lit(parts))
    first = df.withColumn(f"{p}part", part)
    first = first.withColumn(f"{p}n", F.row_number().over(Window.partitionBy(*by, f"{p}part").orderBy(*order))).filter(F.col(f"{p}n") <= k)
    whole = Window.partitionBy(*by).orderBy(*order)
    return first.drop(f"{p}part", f"{p}n").withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= k)


def top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of all: each task keeps ``k`` in a heap and sends only those. ``k`` must fit into one task's memory."""
    return df.orderBy(*order).limit(k)
