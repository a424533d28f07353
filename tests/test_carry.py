"""Tables that are large enough for hot keys and crowded instants to be noticed, against plain joins; and what such joins may move."""

import random

import pytest
from pyspark.sql import functions as F

from heddle.operators import asof, ranges
from heddle.plans import joins


def _same(one, other):
    assert one.exceptAll(other).count() == 0
    assert other.exceptAll(one).count() == 0


def _large(spark, times=9_000):
    """Points: a key of a third, a tenth of the rows at one instant of it, lost keys and times, and thousands of small keys."""
    i = F.col("id")
    key = F.when(i % 10 == 0, -1).when(i % 3 == 0, -1).when(i % 101 == 0, F.lit(None)).otherwise(i % 4_000)
    at = F.when(i % 10 == 0, 4_321).when(i % 103 == 0, F.lit(None)).otherwise(i * 7 % times)
    return spark.range(60_000).select(key.alias("k"), at.alias("t"), i.alias("i"))


@pytest.mark.parametrize("forward", [False, True])
def test_asof_with_hot_keys_and_instants(spark, forward):
    left = _large(spark)
    right = spark.range(3_000).select(F.when(F.col("id") % 10 == 0, -1).otherwise(F.col("id") % 500).alias("rk"), (F.col("id") * 11 % 9_000).alias("rt"), F.col("id").alias("v"))
    fits = (F.col("k") == F.col("rk")) & (F.col("rt") >= F.col("t") if forward else F.col("rt") <= F.col("t"))
    near = F.min if forward else F.max
    best = near(F.struct("rt", (-F.col("v") if forward else F.col("v")).alias("v")))
    want = left.join(right, fits, "left").groupBy("k", "t", "i").agg(best.alias("b")).select("k", "t", "i", F.col("b.rt").alias("rt"), F.abs("b.v").alias("v"))
    found = asof.asof_join(left, right, {"k": "rk"}, "t", "rt", direction="forward" if forward else "backward", ties=("v",))
    _same(found.select("k", "t", "i", "rt", "v"), want)


def test_asof_moves_a_row_once(spark):
    """No key is hot: the left table is read once and shuffled once, and there are no blocks to carry from."""
    left = spark.range(60_000).select((F.col("id") % 9_000).alias("k"), (F.col("id") * 7 % 50_000).alias("t"), F.col("id").alias("i"))
    right = left.toDF("rk", "rt", "v")
    plan = asof.asof_join(left, right, {"k": "rk"}, "t", "rt", ties=("v",))._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("Range (") == 2
    assert "Join" not in plan.optimizedPlan().toString()


def _spans(rnd, times):
    spans = []
    for j in range(60):
        s = rnd.choice([None, *times])
        e = None if s is None or rnd.random() < 0.1 else s + rnd.choice([-1, 0, 1, 2, 3, 7, 30, 200, 5_000])
        spans.append((rnd.choice([1, 2, None]), s, e, rnd.choice([None, *range(20)])))
    return spans + spans[:3]


@pytest.mark.parametrize("closed", ranges.CLOSED)
@pytest.mark.parametrize(("keyed", "block_rows"), [(True, 5), (False, 5), (False, 1_000_000)])
def test_holding_matches_a_loop(spark, closed, keyed, block_rows):
    rnd = random.Random(11)
    times = range(-90, 90)
    points = [(rnd.choice([1, 2, None]), rnd.choice([None, *times]), i) for i in range(80)]
    spans = _spans(rnd, times)
    want = []
    for k, t, i in points:
        low = lambda s: s <= t if closed in ("left", "both") else s < t  # noqa: B023, E731
        high = lambda e: t <= e if closed in ("right", "both") else t < e  # noqa: B023, E731
        met = [v for key, s, e, v in spans if None not in (t, s, e, v) and (not keyed or k is not None and k == key) and s <= e and low(s) and high(e)]
        want.append((k, t, i, len(met), min(met, default=None), max(met, default=None)))
    a, b = spark.createDataFrame(points, "k int, t int, i int"), spark.createDataFrame(spans, "sk int, s int, e int, v int")
    by = {"k": "sk"} if keyed else {}
    found = ranges.holding(a, b, by, "t", "s", "e", "v", ("n", "least", "greatest"), closed, block_rows)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))


def test_holding_tells_microseconds(spark):
    rows = [("2024-01-01 00:00:00.000001", "2024-01-01 00:00:00.000003", "2024-01-01 00:00:00.000002"), ("1969-12-31 23:59:59.5", "1970-01-01 00:00:00.25", "1970-01-01 00:00:00.25")]
    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.createDataFrame(rows, "s string, e string, t string").select(*[F.col(c).cast(kind) for c in "set"], F.lit(1).alias("v"))
        found = ranges.holding(df.select("t"), df.select("s", "e", "v"), {}, "t", "s", "e", "v", ("n", "a", "b"))
        assert sorted(r.n for r in found.collect()) == [0, 1]


def test_error_bursts_make_no_pairs(spark, tmp_path):
    """3,000 purchases within the minutes of 3,000 errors: nine million pairs, of which none is to be a row."""
    at = (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.lit(1))).cast("timestamp_ntz")
    kind = F.when(F.col("id") % 2 == 0, "error").otherwise("purchase")
    rows = spark.range(6_000).select(F.col("id").alias("event_id"), at.alias("ts"), F.lit(1).cast("long").alias("user_id"), kind.alias("event_type"), F.lit(5.0).alias("value"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    found = joins.range_error_bursts(spark, str(tmp_path))
    assert found.filter("n = 3000 AND first_error = 0").count() == 3_000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "ts#" not in "".join(line for line in plan.splitlines() if " Join " in line and (">=" in line or "<=" in line))


@pytest.mark.parametrize("closed", ranges.CLOSED)
def test_semi_and_anti_make_no_pairs(spark, closed):
    """Hot keys and instants, lost rows, ends of each kind; a key of 20,000 points in each of 300 intervals makes no rows but the points."""
    points = _large(spark)
    key = F.when(F.col("id") % 10 == 0, -1).otherwise(F.col("id") % 500)
    spans = spark.range(3_000).select(key.alias("sk"), (F.col("id") * 11 % 9_000).alias("s"), (F.col("id") * 11 % 9_000 + F.col("id") % 40).alias("e"))
    spans = spans.unionAll(spark.createDataFrame([(-1, 4_321, 4_321), (-1, 100, 50), (None, 1, 9)], "sk long, s long, e long"))
    met = (F.col("k") == F.col("sk")) & (F.col("s") <= F.col("e")) & ranges._inside(F.col("t"), F.col("s"), F.col("e"), closed)
    for how in ("semi", "anti"):
        found = ranges.points_in_intervals(points, spans, {"k": "sk"}, "t", "s", "e", closed, how)
        _same(found, points.join(spans, met, f"left_{how}"))
        assert "Generate explode" not in found._jdf.queryExecution().optimizedPlan().toString()  # no copies to meet in bins


@pytest.mark.parametrize("dense", [0, 1, 3])
def test_keys_with_few_intervals_have_no_bins(spark, dense, monkeypatch):
    """Points are copied to levels only where a key has many intervals, whether such keys are told by a broadcast or are too many for it."""
    monkeypatch.setattr(ranges, "DENSE", 2)
    points = spark.range(4_000).select(F.when(F.col("id") % 97 == 0, F.lit(None)).otherwise(F.col("id") % 50).alias("k"), (F.col("id") * 7 % 1_000).alias("t"), F.col("id").alias("i"))
    few = spark.range(200).select((F.col("id") % 50).alias("sk"), (F.col("id") * 5).alias("s"), (F.col("id") * 5 + F.pow(2, F.col("id") % 9)).cast("long").alias("e"), F.col("id").alias("j"))
    many = spark.range(100 * dense).select((F.col("id") % max(1, dense)).alias("sk"), (F.col("id") * 3).alias("s"), (F.col("id") * 3 + F.pow(2, F.col("id") % 7)).cast("long").alias("e"), (F.col("id") + 1_000).alias("j"))
    spans = few.unionAll(many)
    found = ranges.points_in_intervals(points, spans, {"k": "sk"}, "t", "s", "e")
    _same(found, points.join(spans, (F.col("k") == F.col("sk")) & (F.col("t") >= F.col("s")) & (F.col("t") < F.col("e"))))
    if not dense:
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate explode" not in plan


def test_session_errors_make_no_pairs(spark, tmp_path):
    """300 users with a session in the same ten minutes, and an error of each in it: 300 times 299 pairs, of which none is to be a row."""
    i, minute = F.col("id") % 300, F.floor(F.col("id") / 300) * 5
    at = (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=minute.cast("int"))).cast("timestamp_ntz")
    rows = spark.range(900).select(F.col("id").alias("event_id"), at.alias("ts"), i.alias("user_id"), F.when(minute == 5, "error").otherwise("view").alias("event_type"), F.lit(1.0).alias("value"))
    odd = rows.filter("event_type = 'error'").limit(2).withColumn("user_id", F.lit(None).cast("long"))  # of no user: counted nowhere
    rows.unionAll(odd).write.parquet(str(tmp_path / "events.parquet"))
    found = joins.range_sessions(spark, str(tmp_path))
    assert found.filter("n = 299").count() == found.count() == 300
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if " Join " in x and ("till" in x or "since" in x)]
