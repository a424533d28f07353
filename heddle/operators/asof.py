"""As-of join: to each row the nearest row of another table before or after it in time.

Rows of the right table with one key and time are folded to one, and each row of the left table moves once, to the rows of its key (``carry``). A key
with a noticeable share of all rows is dealt to as many tasks as it has blocks of time, and from block to block only its last (or first) match is carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.order import free, fresh, position
from heddle.operators.carry import BLOCK_ROWS, carried, spread


def block_width(frames: list[tuple[DataFrame, str]], rows: int = BLOCK_ROWS) -> float:
    """Width of blocks, in the unit of ``order.position``, that gives ``rows`` rows a block between the hundredths at the ends.

    One row comes to the driver. Times far from the others make blocks of their own and don't widen the rest.
    """
    at = None
    for df, column in frames:
        one = df.select(position(df, column).alias("at"))
        at = one if at is None else at.unionAll(one)
    n, ends = at.agg(F.count("at"), F.percentile_approx("at", [0.01, 0.99], 1000)).first()
    return spread(n, *(ends or (None, None)), rows)


def asof_join(
    left: DataFrame, right: DataFrame, by: dict[str, str], left_at: str, right_at: str, how: str = "left",
    direction: str = "backward", strict: bool = False, within: Column | None = None, ties: tuple[str, ...] = (), width: float | None = None,
) -> DataFrame:
    """``left`` with the columns of the row of ``right`` that is nearest before (``backward``) or after (``forward``) it.

    ``by`` maps key columns of ``left`` to those of ``right``; empty: all rows are of one key. The columns of both tables must
    have different names. ``strict`` leaves out rows of the same time. ``within``: an interval (or number) that the two times are apart at most; a
    nearest row farther away is no match. Of several rows of ``right`` with one key and time the greatest by ``ties`` is taken,
    and by all of its columns in their order where those don't decide, nulls being least; so the result doesn't depend on how rows are dealt
    (columns of maps, which have no order, must be left out).

    A null key matches nothing, nor does a null time; with ``how="inner"`` rows without a match are left out.
    """
    if how not in ("left", "inner") or direction not in ("backward", "forward"):
        raise ValueError("how is left or inner, direction backward or forward")
    if {c.lower() for c in left.columns} & {c.lower() for c in right.columns}:
        raise ValueError("the tables must not share column names")
    p, left, right = free(left, right), fresh(left), fresh(right)
    position(left, left_at), position(right, right_at)
    match, forward = f"{p}match", direction == "forward"
    first = [c for c in ties] + [c for c in right.columns if c not in ties]
    given = right.groupBy(*by.values(), right_at).agg(F.max(F.struct(*first)).alias(match))
    found = carried(left, given, by, left_at, right_at, match, match, "last", forward, strict, width, inner=how == "inner")
    if within is not None:
        other = F.col(match)[right_at]
        near = other <= F.col(left_at) + within if forward else other >= F.col(left_at) - within
        found = found.withColumn(match, F.when(near, F.col(match)))
    if how == "inner":
        found = found.filter(F.col(match).isNotNull())
    return found.select(*left.columns, *[F.col(match)[c].alias(c) for c in right.columns])
