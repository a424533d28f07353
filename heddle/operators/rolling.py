"""Aggregates over the time before each row, for keys of any size.

A key's time is parted into bins as wide as the frame reaches back. A frame then lies in a row's own bin and the one before, so
each row is copied into the next bin, where it is counted but not put out. Windows run by key and bin: a key with a third of all
rows is dealt to as many tasks as it has bins, for twice the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.order import free, position


def rolling(df: DataFrame, by: list[str], at: str, seconds: int, **aggregates: Column) -> DataFrame:
    """``df`` with aggregates over the rows of its key from ``seconds`` before its time up to its time, both included.

    Rows of one time see each other, as in a range frame. ``at`` is a time (whole seconds count) or a number, in which case ``seconds`` is in its units. A
    row without time has nulls; a null key is a key. Aggregates must be of plain columns, as they are taken again over copies.
    """
    p = free(df)
    bin_, place, mine = f"{p}bin", f"{p}place", f"{p}mine"
    rows = df.withColumn(place, position(df, at)).withColumn(bin_, F.floor(F.col(place) / F.lit(float(seconds))).cast("long"))
    copies = F.when(F.col(bin_).isNull(), F.array(F.struct(F.lit(None).cast("long").alias("b"), F.lit(True).alias("m")))).otherwise(
        F.array(F.struct(F.col(bin_).alias("b"), F.lit(True).alias("m")), F.struct((F.col(bin_) + 1).alias("b"), F.lit(False).alias("m")))
    )
    dealt = rows.withColumn(f"{p}copy", F.explode(copies))
    dealt = dealt.withColumns({bin_: F.col(f"{p}copy.b"), mine: F.col(f"{p}copy.m")}).drop(f"{p}copy")
    frame = Window.partitionBy(*by, bin_).orderBy(place).rangeBetween(-seconds, Window.currentRow)
    known = F.col(place).isNotNull()
    found = dealt.withColumns({name: F.when(known, value.over(frame)) for name, value in aggregates.items()})
    return found.filter(mine).select(*df.columns, *aggregates)
