"""Range joins: points in intervals, and intervals that overlap, without a nested loop; and what intervals hold a point, without its pairs.

Pairs are found by equality joins on bins. Interval lengths are dealt into levels, each twice as wide as the one before. An interval stands in the one or
two bins of its level that it touches; a point looks into one bin of each level that any interval has. So an interval is copied twice
at most however long it is, a point as often as there are levels (some ten; 65 at most). The width of the
narrowest bins is the median length, measured from the intervals. The exact condition is tested on what meets in a bin. Keys with a few intervals only need no bins
and no copies: all of their intervals are tested. A bin that holds many points is split by Spark's skew handling, as it is an equality join of the plain kind.

Whether any interval holds a point (``semi``, ``anti``) follows from the greatest end of the intervals that start before it; no pair is made.
``holding`` counts the intervals that hold a point, with the least and the greatest of their values, from parts of intervals in bins; no pair is made there either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.order import cell, free, fresh, position
from heddle.operators.carry import BLOCK_ROWS, carried, spread

#: Which ends of an interval belong to it.
CLOSED = ("left", "right", "both", "neither")
HOW = ("inner", "left", "semi", "anti")
#: Levels with bins; longer intervals (endless ones too) stand at one more, which is a single bin.
LEVELS = 64

#: A key with so many intervals, or fewer, has no bins.
FEW = 64

#: Keys with more intervals are told by a broadcast up to this number; past it, all keys have bins.
DENSE = 10_000


def _inside(at: Column, start: Column, end: Column, closed: str) -> Column:
    after = at >= start if closed in ("left", "both") else at > start
    return after & (at <= end if closed in ("right", "both") else at < end)


def _levels(intervals: DataFrame, start: str, end: str, width: float | None) -> tuple[float, list[int]]:
    """The width of the narrowest bins, and the levels that occur: a row of at most ``LEVELS + 1`` numbers comes to the driver."""
    length = (position(intervals, end) - position(intervals, start)).alias("length")
    lengths = intervals.select(length).filter(F.col("length") >= 0)
    if width is None:
        width = lengths.agg(F.percentile_approx("length", 0.5, 100)).first()[0]
    width = float(width or 0)
    width = width if 0 < width < float("inf") else 1.0
    found = lengths.agg(F.collect_set(_level(F.col("length"), width))).first()[0]
    return width, sorted(found)


def _level(length: Column, width: float) -> Column:
    """The least level whose bins are as wide as the length."""
    ratio = length / F.lit(width)
    need = F.greatest(F.ceil(F.log2(F.greatest(ratio, F.lit(1.0)))), F.lit(0))
    return F.when(ratio < F.lit(2.0**LEVELS / 2), need).otherwise(F.lit(LEVELS)).cast("int")


def _bin(place: Column, level: Column, width: float) -> Column:
    at = F.floor(place / (F.lit(width) * F.pow(F.lit(2.0), level))).cast("long")
    return F.when(level < LEVELS, at).otherwise(F.when(place.isNotNull(), F.lit(0)))


def _met(looks: DataFrame, placed: DataFrame, by: dict[str, str], meet: Column, points: DataFrame, intervals: DataFrame) -> DataFrame:
    for name, other in by.items():
        meet = meet & (looks[name] == placed[other])
    return looks.join(placed, meet).select(*[looks[c] for c in points.columns], *[placed[c] for c in intervals.columns])


def points_in_intervals(
    points: DataFrame, intervals: DataFrame, by: dict[str, str], at: str, start: str, end: str, closed: str = "left",
    how: str = "inner", width: float | None = None,
) -> DataFrame:
    """Pairs of a point and an interval that holds it: the columns of ``points``, then those of ``intervals``.

    ``by`` maps key columns of ``points`` to those of ``intervals``; it may be empty. The tables must have different column
    names. ``closed`` names the ends that belong to an interval. ``how``: ``inner``; ``left`` keeps points in no interval, with nulls; ``semi``
    keeps each point in some interval once, ``anti`` the others (both have the columns of ``points`` only).

    A null key, time or end matches nothing; nor does an interval whose end comes before its start. Repeated rows match each on their own.
    """
    if closed not in CLOSED or how not in HOW:
        raise ValueError(f"closed is one of {CLOSED}, how one of {HOW}")
    if {c.lower() for c in points.columns} & {c.lower() for c in intervals.columns}:
        raise ValueError("the tables must not share column names")
    p, points, intervals = free(points, intervals), fresh(points), fresh(intervals)
    if how == "left":
        inner, anti = (points_in_intervals(points, intervals, by, at, start, end, closed, x, width) for x in ("inner", "anti"))
        return inner.unionByName(anti, allowMissingColumns=True)
    sound = intervals.dropna(subset=[*by.values(), start, end]).filter(F.col(start) <= F.col(end))
    if how != "inner":
        latest = f"{p}latest"
        told = sound.groupBy(*by.values(), start).agg(F.max(end).alias(latest))
        known = carried(points, told, by, at, start, latest, latest, "max", strict=closed in ("right", "neither"), inner=how == "semi")
        held = F.col(latest) >= F.col(at) if closed in ("right", "both") else F.col(latest) > F.col(at)
        return known.filter(held if how == "semi" else ~F.coalesce(held, F.lit(False))).select(*points.columns)

    level, bin_, dense = f"{p}level", f"{p}bin", f"{p}dense"
    keys, known = list(by.values()), points.dropna(subset=[*by, at])
    binned = F.lit(True)
    if keys:
        full = sound.groupBy(*keys).count().filter(F.col("count") > FEW).select(*[F.col(k).alias(f"{p}{i}") for i, k in enumerate(keys)], F.lit(True).alias(dense))
        n = full.limit(DENSE + 1).count()
        if n == 0:
            return _met(known, sound, by, _inside(known[at], sound[start], sound[end], closed), points, intervals)
        if n <= DENSE:
            binned = F.coalesce(F.col(dense), F.lit(False))

            def marked(df: DataFrame, names) -> DataFrame:
                told = F.broadcast(full.withColumnsRenamed({f"{p}{i}": k for i, k in enumerate(names)}))
                return df.join(told, list(names), "left").select(*df.columns, dense)

            sound, known = marked(sound, keys), marked(known, by)
    first, last = position(intervals, start), position(intervals, end)
    width, present = _levels(sound.filter(binned), start, end, width)
    none = F.lit(-1)
    own = F.when(binned, _level(last - first, width)).otherwise(none)
    bins = F.sequence(_bin(first, F.col(level), width), _bin(last, F.col(level), width))
    placed = sound.withColumn(level, own).withColumn(bin_, F.explode(F.when(F.col(level) >= 0, bins).otherwise(F.array(F.lit(0).cast("long")))))
    levels = F.when(binned, F.lit(present).cast("array<int>")).otherwise(F.array(none))
    looks = known.withColumn(level, F.explode(levels))
    looks = looks.withColumn(bin_, F.when(F.col(level) >= 0, _bin(position(points, at), F.col(level), width)).otherwise(F.lit(0).cast("long")))
    looks, placed = fresh(looks), fresh(placed)
    meet = (looks[level] == placed[level]) & (looks[bin_] == placed[bin_]) & _inside(looks[at], placed[start], placed[end], closed)
    return _met(looks, placed, by, meet, points, intervals)


def _stabbed(points: DataFrame, parts: DataFrame, keys: list[str], p: str, cap: int) -> DataFrame:
    """Counts and extremes of the intervals [``s``, ``e``] that hold each point ``t``; all are whole numbers, points and intervals different ones.

    An interval of n cells belongs to the level whose bins have the greatest power of two up to n cells: it is the end of one bin and the start of another, at
    most with a whole bin between them. Within a bin, ends and starts are nested, so running counts and extremes are enough.
    Longer intervals than twice a bin of level ``cap`` are such an end and a start there; the bins between them are intervals of bins, to be found likewise.
    """
    s, e, t, level, bin_, own = (f"{p}{x}" for x in ("s", "e", "t", "level", "bin", "own"))
    stats = [f"{p}n", f"{p}least", f"{p}greatest"]
    fold = [F.sum(stats[0]).alias(stats[0]), F.min(stats[1]).alias(stats[1]), F.max(stats[2]).alias(stats[2])]
    at = lambda c: F.expr(f"shiftright({c}, {level})")
    cells = F.length(F.bin(F.col(e) - F.col(s) + 1)) - 1
    dealt = parts.withColumn(level, F.least(cells, F.lit(cap)))
    present = sorted(r[0] for r in dealt.select(level).distinct().collect())
    dealt = dealt.withColumn(f"{p}from", at(s)).withColumn(f"{p}to", at(e))
    one = lambda b, side, place: F.struct(F.col(b).alias(bin_), F.lit(side).alias(f"{p}side"), F.col(place).alias(f"{p}place"))
    middle = F.struct((F.col(f"{p}from") + 1).alias(bin_), F.lit(0).alias(f"{p}side"), F.expr(f"shiftleft({p}from + 1, {level})").alias(f"{p}place"))
    wide = F.col(f"{p}to") - F.col(f"{p}from")
    pieces = F.when(wide == 0, F.array(one(f"{p}from", 0, s))).when(
        (wide == 2) & (F.col(level) < cap), F.array(one(f"{p}from", 0, s), middle, one(f"{p}to", 1, e))
    ).otherwise(F.array(one(f"{p}from", 0, s), one(f"{p}to", 1, e)))
    stood = dealt.select(*keys, level, *stats, F.explode(pieces).alias("x")).select(*keys, level, "x.*", *stats)
    stood = stood.groupBy(*keys, level, bin_, f"{p}side", f"{p}place").agg(*fold).withColumn(own, F.lit(False))
    looks = points.withColumn(level, F.explode(F.lit(present).cast("array<int>"))).withColumn(bin_, at(t))
    looks = looks.withColumn(f"{p}place", F.col(t)).withColumn(own, F.lit(True))
    rows = stood.unionByName(looks, allowMissingColumns=True)
    found = None
    of = Window.partitionBy(*keys, level, bin_)
    for side, order in ((0, F.asc(f"{p}place")), (1, F.desc(f"{p}place"))):
        seen = of.orderBy(order, own).rowsBetween(Window.unboundedPreceding, 0)
        for name, run in zip(stats, (F.sum, F.min, F.max), strict=True):
            rows = rows.withColumn(f"{name}{side}", run(F.when(F.col(f"{p}side") == side, F.col(name))).over(seen))
    both = rows.filter(own)
    found = both.select(
        *keys, t, (F.coalesce(f"{stats[0]}0", F.lit(0)) + F.coalesce(f"{stats[0]}1", F.lit(0))).alias(stats[0]),
        F.least(f"{stats[1]}0", f"{stats[1]}1").alias(stats[1]), F.greatest(f"{stats[2]}0", f"{stats[2]}1").alias(stats[2]),
    )
    if cap < LEVELS and present and present[-1] == cap:
        # Whole bins between both ends, as intervals of bins; points of one bin are one point there.
        inner = dealt.filter((F.col(level) == cap) & (wide > 1)).select(*keys, (F.col(f"{p}from") + 1).alias(s), (F.col(f"{p}to") - 1).alias(e), *stats)
        inner = inner.groupBy(*keys, s, e).agg(*fold)
        block = F.expr(f"shiftright({t}, {cap})")
        far = _stabbed(points.select(*keys, block.alias(t)).distinct(), inner, keys, p, LEVELS).withColumnRenamed(t, f"{p}block")
        far = points.withColumn(f"{p}block", block).join(far, [*keys, f"{p}block"]).select(*keys, t, *stats)
        found = found.unionByName(far)
    return found.groupBy(*keys, t).agg(*fold)


def holding(
    points: DataFrame, intervals: DataFrame, by: dict[str, str], at: str, start: str, end: str, value: str, names: tuple[str, str, str],
    closed: str = "left", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``points`` with three columns: how many intervals with a ``value`` hold each, and the least and the greatest of these values.

    As ``points_in_intervals`` and a grouping would give, but the work grows with the rows, not with the pairs. Times, dates and whole numbers only.
    """
    if closed not in CLOSED:
        raise ValueError(f"closed is one of {CLOSED}")
    p, points, intervals = free(points, intervals), fresh(points), fresh(intervals)
    keys, s, e, t = [f"{p}k{i}" for i in range(len(by))], f"{p}s", f"{p}e", f"{p}t"
    stats = [f"{p}n", f"{p}least", f"{p}greatest"]
    if len({str(x) for x in (points.schema[at].dataType, intervals.schema[start].dataType, intervals.schema[end].dataType)} - {"ByteType()", "ShortType()", "IntegerType()", "LongType()"}) > 1:
        raise TypeError("points and ends of intervals are of one type")
    opened = cell(intervals, start) + (0 if closed in ("left", "both") else 1)
    ended = cell(intervals, end) - (0 if closed in ("right", "both") else 1)
    theirs = intervals.select(*[F.col(c).alias(k) for c, k in zip(by.values(), keys, strict=True)], opened.alias(s), ended.alias(e), F.col(value).alias(f"{p}value"))
    theirs = theirs.dropna().filter(F.col(s) <= F.col(e))
    parts = theirs.groupBy(*keys, s, e).agg(F.count("*").alias(stats[0]), F.min(f"{p}value").alias(stats[1]), F.max(f"{p}value").alias(stats[2]))
    asked = points.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], cell(points, at).alias(t)).dropna().distinct()
    both = asked.select(F.col(t).alias("at")).unionAll(parts.select(F.col(s).alias("at")))
    n, ends = both.agg(F.count("at"), F.percentile_approx("at", [0.01, 0.99], 1000)).first()
    cap = LEVELS if n <= block_rows else max(0, int(spread(n, *ends, block_rows)).bit_length() - 1)
    found = _stabbed(asked, parts, keys, p, cap)
    same = cell(points, at) == F.col(t)
    for c, k in zip(by, keys, strict=True):
        same = same & (points[c] == found[k])
    return points.join(found, same, "left").select(
        *points.columns, F.coalesce(stats[0], F.lit(0)).alias(names[0]), F.col(stats[1]).alias(names[1]), F.col(stats[2]).alias(names[2])
    )


def overlapping(
    left: DataFrame, right: DataFrame, by: dict[str, str], left_span: tuple[str, str], right_span: tuple[str, str], closed: str = "left",
) -> DataFrame:
    """All pairs of intervals (start, end) that have a time in common: the columns of ``left``, then those of ``right``.

    ``closed``: ``left`` (ends don't belong to intervals, and one without length holds nothing) or ``both``. Of two intervals that overlap, one
    starts within the other: each pair is found once, as a point in an interval.
    """
    if closed not in ("left", "both"):
        raise ValueError("closed is left or both")
    (a, b), (c, d) = left_span, right_span
    sound = lambda df, s, e: df.filter(F.col(s) < F.col(e) if closed == "left" else F.col(s) <= F.col(e))
    left, right = sound(left, a, b), sound(right, c, d)
    one = points_in_intervals(left, right, by, a, c, d, closed)
    other = points_in_intervals(right, left, {v: k for k, v in by.items()}, c, a, b, "neither" if closed == "left" else "right")
    return one.unionByName(other.select(*left.columns, *right.columns))
