"""As-of and range joins against plain loops, with nulls, ties, repeated rows, empty tables and a hot key."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from heddle.functions import order
from heddle.operators import asof, ranges


def _rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def _asof_tables(rnd):
    left = [(rnd.choice([1, 2, None, 3]) if rnd.random() < 0.3 else 1, rnd.choice([None, *range(40)]), i // 2) for i in range(120)]
    right = [(rnd.choice([1, 2, None]) if rnd.random() < 0.3 else 1, rnd.choice([None, *range(0, 40, 3)]), rnd.choice([None, 1, 2, 3])) for _ in range(50)]
    return left, right


def _asof(left, right, forward, strict, within, inner):
    out = []
    for k, t, i in left:
        fits = [x for x in right if None not in (k, t, x[1]) and x[0] == k and (x[1] > t if forward else x[1] < t) | (x[1] == t and not strict)]
        best = None
        if fits:
            near = (min if forward else max)(x[1] for x in fits)
            best = max((x for x in fits if x[1] == near), key=lambda x: -1 if x[2] is None else x[2])
            if within is not None and abs(best[1] - t) > within:
                best = None
        if best or not inner:
            out.append((k, t, i, *(best or (None,) * 3)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize(("within", "inner", "width"), [(None, False, None), (2, True, 1.0), (None, True, 5.0), (2, False, 1000.0)])
def test_asof_matches_a_loop(spark, forward, strict, within, inner, width):
    left, right = _asof_tables(random.Random(7))
    a = spark.createDataFrame(left, "k int, t int, i int").repartition(3)
    b = spark.createDataFrame(right, "rk int, rt int, v int").repartition(3)
    found = asof.asof_join(
        a, b, {"k": "rk"}, "t", "rt", how="inner" if inner else "left", direction="forward" if forward else "backward", strict=strict,
        within=None if within is None else F.lit(within), ties=("v",), width=width,
    )
    assert _rows(found) == _asof(left, right, forward, strict, within, inner)


def test_asof_of_odd_tables(spark):
    left, right = _asof_tables(random.Random(8))
    a, b = spark.createDataFrame(left, "k int, t int, i int"), spark.createDataFrame(right, "rk int, rt int, v int")
    assert asof.asof_join(a.limit(0), b, {"k": "rk"}, "t", "rt").count() == 0
    assert asof.asof_join(a, b.limit(0), {"k": "rk"}, "t", "rt").filter("rt IS NULL").count() == len(left)
    assert asof.asof_join(a, b, {}, "t", "rt").filter("t IS NOT NULL AND rt IS NULL").count() == sum(x[1] is not None and x[1] < min(y[1] for y in right if y[1] is not None) for x in left)
    mine = a.select(F.col("k").alias("_hk0"), F.col("t").alias("_hat"), F.col("i").alias("_hmatch"))  # names like those used inside
    assert _rows(asof.asof_join(mine, b, {"_hk0": "rk"}, "_hat", "rt", ties=("v",))) == _asof(left, right, False, False, None, False)
    again = a.select(F.col("k").alias("k2"), F.col("t").alias("t2"), F.col("i").alias("i2"))  # a table with itself
    assert asof.asof_join(a, again, {"k": "k2"}, "t", "t2", how="inner").filter("t = t2").count() == sum(None not in x for x in left)
    with pytest.raises(ValueError, match="share"):
        asof.asof_join(a, a, {"k": "k"}, "t", "t")
    with pytest.raises(TypeError, match="neither"):
        asof.asof_join(a, b.withColumn("rt", F.col("rt").cast("string")), {"k": "rk"}, "t", "rt")


def test_asof_spreads_a_hot_key(spark):
    """One key with a third of all rows: no task of the windows gets more than a few blocks of it."""
    n = 60_000
    left = spark.range(n).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 5_000).alias("k"), (F.col("id") * 7 % n).alias("t"))
    right = left.select(F.col("k").alias("rk"), F.col("t").alias("rt"), F.lit(1).alias("v"))
    width = asof.block_width([(left, "t"), (right, "rt")], rows=2_000)
    assert n / 100 < width < n / 20
    found = asof.asof_join(left, right, {"k": "rk"}, "t", "rt", width=width, how="inner")
    assert found.filter("t = rt").count() == n
    blocks = left.filter("k = -1").groupBy(F.floor(order.position(left, "t") / width)).count()
    assert blocks.agg(F.max("count")).first()[0] < n / 3 / 20
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_hot_instant_is_folded_before_the_shuffle(spark):
    left = spark.range(30_000).select(F.lit(1).alias("k"), F.lit(5).alias("t"), F.col("id").alias("i"))
    right = spark.range(30_000).select(F.lit(1).alias("rk"), F.lit(4).alias("rt"), F.col("id").alias("v"))
    assert asof.asof_join(left, right, {"k": "rk"}, "t", "rt", ties=("v",)).filter("v = 29999").count() == 30_000


def test_positions_grow_with_time(spark):
    rows = [(dt.datetime(2024, 3, 31, h, m), dt.date(2024, 3, h + 1), h) for h in range(6) for m in (0, 30)]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b date, c int").withColumn("d", F.col("c").cast("timestamp"))
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # the hour from 2 to 3 is missing there
    try:
        found = [tuple(r) for r in df.select(*[order.position(df, c) for c in "abcd"]).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    for column in zip(*found, strict=True):
        assert list(column) == sorted(column)
    assert len({x[0] for x in found}) == len(rows)


def _range_tables(rnd):
    points = [(rnd.choice([1, 2, None]), rnd.choice([None, *(x / 2 for x in range(80))]), i // 2) for i in range(70)]
    spans = []
    for j in range(40):
        s = rnd.choice([None, *(x / 2 for x in range(80))])
        e = None if s is None or rnd.random() < 0.1 else s + rnd.choice([-1.0, 0.0, 0.5, 1.0, 3.0, 30.0, float("inf")])
        spans.append((rnd.choice([1, 2, None]), s, e, j))
    return points + points[:5], spans + spans[:2]


def _holds(t, s, e, closed):
    return (t >= s if closed in ("left", "both") else t > s) and (t <= e if closed in ("right", "both") else t < e)


@pytest.mark.parametrize("closed", ranges.CLOSED)
@pytest.mark.parametrize("keyed", [True, False])
def test_points_in_intervals_match_a_loop(spark, closed, keyed):
    points, spans = _range_tables(random.Random(9))
    a = spark.createDataFrame(points, "k int, t double, i int").repartition(3)
    b = spark.createDataFrame(spans, "sk int, s double, e double, j int")
    want = {"inner": [], "left": [], "semi": [], "anti": []}
    for x in points:
        met = [
            y for y in spans
            if None not in (x[1], y[1], y[2]) and (not keyed or x[0] is not None and x[0] == y[0]) and y[1] <= y[2] and _holds(x[1], y[1], y[2], closed)
        ]
        want["inner"] += [x + y for y in met]
        want["left"] += [x + y for y in met] or [(*x, *(None,) * 4)]
        want["semi" if met else "anti"].append(x)
    for how, rows in want.items():
        found = ranges.points_in_intervals(a, b, {"k": "sk"} if keyed else {}, "t", "s", "e", closed, how)
        assert _rows(found) == sorted(map(repr, rows)), how
    assert ranges.points_in_intervals(a, b.limit(0), {"k": "sk"}, "t", "s", "e", closed, "left").count() == len(points)
    assert ranges.points_in_intervals(a, b.limit(0), {"k": "sk"}, "t", "s", "e", closed).count() == 0
    assert ranges.points_in_intervals(a.limit(0), b, {"k": "sk"}, "t", "s", "e", closed, "left").count() == 0


@pytest.mark.parametrize("closed", ["left", "both"])
def test_overlaps_match_a_loop(spark, closed):
    spans = _range_tables(random.Random(10))[1]
    a = spark.createDataFrame(spans, "k int, s double, e double, j int")
    b = a.toDF("k2", "s2", "e2", "j2")
    sound = [x for x in spans if None not in x[:3] and (x[1] < x[2] or closed == "both" and x[1] == x[2])]
    meet = (lambda x, y: x[1] < y[2] and y[1] < x[2]) if closed == "left" else (lambda x, y: x[1] <= y[2] and y[1] <= x[2])
    want = [x + y for x in sound for y in sound if x[0] == y[0] and meet(x, y)]
    assert _rows(ranges.overlapping(a, b, {"k": "k2"}, ("s", "e"), ("s2", "e2"), closed)) == sorted(map(repr, want))


def test_range_join_has_no_nested_loop(spark):
    points = spark.range(20_000).select((F.col("id") * 31 % 20_000).alias("t"))
    spans = spark.range(5_000).select((F.col("id") * 4).alias("s"), (F.col("id") * 4 + F.pow(2, F.col("id") % 9)).cast("long").alias("e"))
    found = ranges.points_in_intervals(points, spans, {}, "t", "s", "e")
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert found.count() == sum(max(0, min(20_000, i * 4 + 2 ** (i % 9)) - i * 4) for i in range(5_000))
    width, levels = ranges._levels(spans, "s", "e", None)
    assert width == 16.0 and levels == [0, 1, 2, 3, 4]  # lengths below the median share the narrowest bins
