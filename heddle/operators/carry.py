"""What the rows of one table before (or after) each row of another hand on to it, key by key: the nearest, the greatest, or the sum.

A row is dealt once, by its key, and a window runs over the key's time. Only keys that hold a noticeable share of all rows are parted into blocks of
time; from block to block one row is carried, so such a key is dealt to as many tasks as it has blocks, and other keys have no blocks to carry.
Instants of a key that hold a noticeable share of the rows are folded before they are dealt. Shares are measured: one row comes to the driver.
"""

from __future__ import annotations

from itertools import pairwise
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.order import free, position

#: Rows that a block of one key would hold if all rows were of that key.
BLOCK_ROWS = 1_000_000

#: A share of one in so many is noticed.
STEPS = 500

#: How a value is handed on: over rows, and of what two stretches hand on.
PICKS = {"last": F.coalesce, "max": F.greatest, "sum": lambda a, b: F.coalesce(a + b, a, b)}


class Layout(NamedTuple):
    """Width of blocks in the unit of ``order.position``; hashes of keys to be parted, and of a key's instants to be folded."""

    width: float
    hot: list[int]
    crowded: list[int]


def spread(n: int, first: float | None, last: float | None, rows: int = BLOCK_ROWS) -> float:
    """Width of blocks that hold ``rows`` of ``n`` rows, from the times at both hundredths of the ends."""
    if not n or last <= first:
        return 1.0
    return max(1e-9, (last - first) / max(1.0, 0.98 * n / rows))


def _often(quantiles: list[int] | None) -> list[int]:
    return sorted({int(a) for a, b in pairwise(quantiles or []) if a == b})


def layout(rows: DataFrame, key: list[str], at: str, own: str, width: float | None = None) -> Layout:
    """Measured over the rows of both sides; those of the left have ``own``. A value with two steps' share stands twice among the quantiles.

    Tables too small for a share to matter have no hot keys, unless a width is given.
    """
    steps = [i / STEPS for i in range(1, STEPS)]
    often = lambda value: F.percentile_approx(value, steps, 10 * STEPS)
    shares = [often(F.hash(*key)) if key else F.lit(None).cast("array<int>"), often(F.when(F.col(own), F.hash(*key, at)))]
    n, place, hot, crowded = rows.agg(F.count(at), F.percentile_approx(position(rows, at), [0.01, 0.99], 1000), *shares).first()
    if width is None and n < 100 * STEPS:
        hot = crowded = None
    return Layout(spread(n, *(place or (None, None))) if width is None else width, _often(hot), _often(crowded))


def carried(
    left: DataFrame, given: DataFrame, by: dict[str, str], left_at: str, given_at: str, value: str, into: str, pick: str = "last",
    forward: bool = False, strict: bool = False, width: float | None = None, inner: bool = False,
) -> DataFrame:
    """``left`` with a column ``into``: what the rows of ``given`` before it (``forward``: after it) hand on, of equal keys.

    ``given`` has one row for each key and time, with its ``value``; ``strict`` leaves out the row of the same time. Nothing is handed on to
    null keys and times (``inner`` leaves them out); nor does anything come from them.
    """
    p = free(left, given)
    key, at, own, handed, block = [f"{p}k{i}" for i in range(len(by))], f"{p}at", f"{p}own", f"{p}handed", f"{p}block"

    def named(df: DataFrame, keys, time: str, *more) -> DataFrame:
        position(df, time)  # refuses what is neither a time nor a number
        return df.select(*[F.col(c).alias(k) for c, k in zip(keys, key, strict=True)], F.col(time).alias(at), *more)

    asked, told = named(left, by, left_at), named(given, by.values(), given_at)
    both = asked.withColumn(own, F.lit(True)).unionAll(told.withColumn(own, F.lit(False))).dropna(subset=[*key, at])
    kinds = {c: both.schema[c].dataType for c in [*key, at]}
    plan = layout(both, key, at, own, width)

    # Keys and times that both tables hold in one type are not kept twice.
    twice = {o: c for c, o in [*zip(by, key, strict=True), (left_at, at)] if left.schema[c].dataType == kinds[o]}
    rest = [c for c in left.columns if c not in twice.values()]
    whole = named(left, by, left_at, *rest).withColumns({c: F.col(c).cast(t) for c, t in kinds.items()})
    told = named(given, by.values(), given_at, F.col(value).alias(handed)).withColumns({c: F.col(c).cast(t) for c, t in kinds.items()})
    told = told.dropna(subset=[*key, at])
    whole = whole.dropna(subset=[*key, at]) if inner else whole
    back = [*[F.col(o).alias(c) for o, c in twice.items()], *rest]

    heat = F.hash(*key).isin(plan.hot) if key else F.lit(True)
    lost = F.lit(False)
    for c in [*key, at]:
        lost = lost | F.col(c).isNull()

    def dealt(df: DataFrame) -> DataFrame:
        place = F.when(heat, F.floor(position(df, at) / F.lit(plan.width)).cast("long")).otherwise(F.lit(0).cast("long"))
        return df.withColumn(block, F.when(lost, F.spark_partition_id().cast("long")).otherwise(place))

    def handed_on(rows: DataFrame) -> DataFrame:
        """``rows`` with what is handed on to them."""
        mine, theirs = dealt(rows).withColumn(own, F.lit(True)), dealt(told)
        # At one time, the row that is asked for comes after the one that is given, or before it if that one may not match.
        turn = F.col(own) if not strict else ~F.col(own)
        seen = Window.partitionBy(*key, block).orderBy(F.desc(at) if forward else F.asc(at), turn).rowsBetween(Window.unboundedPreceding, 0)
        over = {"last": lambda c: F.last(c, ignorenulls=True), "max": F.max, "sum": F.sum}[pick]
        rows = mine.unionByName(theirs.withColumn(own, F.lit(False)), allowMissingColumns=True)
        inside = rows.withColumn(handed, over(handed).over(seen)).filter(own).drop(own)
        if not key or plan.hot:
            # What blocks before hand on: one row for each block of either side.
            edge = over(handed) if pick != "last" else F.min_by(handed, at) if forward else F.max_by(handed, at)
            blocks = theirs.filter(heat).groupBy(*key, block).agg(edge.alias(f"{p}edge"))
            held = mine.filter(heat & ~lost).select(*key, block).distinct().join(blocks, [*key, block], "full")
            away = F.col(block).desc() if forward else F.col(block).asc()
            before = Window.partitionBy(*key).orderBy(away).rowsBetween(Window.unboundedPreceding, -1)
            edges = held.select(*key, block, over(f"{p}edge").over(before).alias(f"{p}edge")).filter(F.col(f"{p}edge").isNotNull())
            inside = inside.join(edges, [*key, block], "left").withColumn(handed, PICKS[pick](F.col(handed), F.col(f"{p}edge"))).drop(f"{p}edge")
        return inside.withColumn(handed, F.when(~lost, F.col(handed))).drop(block)

    if not plan.crowded:
        return handed_on(whole).select(*back, F.col(handed).alias(into))
    busy = F.coalesce(F.hash(*key, at).isin(plan.crowded), F.lit(False)) & ~lost
    calm = handed_on(whole.filter(~busy)).select(*back, F.col(handed).alias(into))
    instants = handed_on(whole.filter(busy).select(*key, at).distinct())
    met = whole.filter(busy).join(F.broadcast(instants), [*key, at], "left")
    return calm.unionByName(met.select(*back, F.col(handed).alias(into)))
