"""Rolling frames, top rows, mergeable counts, multisets, JSON and the table function: nulls, ties, hot keys, empty tables."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.functions import budget
from heddle.operators import distinct, rolling, topk


def _rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_rolling_matches_a_loop(spark):
    rnd = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    rows = [(rnd.choice([1, 1, 1, 2, None]), rnd.choice([None, *(start + dt.timedelta(days=rnd.randrange(60)) for _ in range(9))]), rnd.choice([None, 1, 5, -2])) for _ in range(150)]
    df = spark.createDataFrame(rows, "k int, at timestamp_ntz, v int").repartition(3)
    for days in (0.5, 7, 100):
        reach = dt.timedelta(days=days)
        want = []
        for k, t, v in rows:
            seen = [x[2] for x in rows if t is not None and x[1] is not None and x[0] == k and t - reach <= x[1] <= t]
            known = [x for x in seen if x is not None]
            want.append((k, t, v, len(seen) if t else None, sum(known) if known else None))
        found = rolling.rolling(df, ["k"], "at", int(days * 86_400), n=F.count("*"), s=F.sum("v"))
        assert _rows(found) == sorted(map(repr, want))
    assert rolling.rolling(df.limit(0), ["k"], "at", 60, n=F.count("*")).count() == 0


def test_rolling_spreads_a_hot_key(spark):
    df = spark.range(50_000).select(F.lit(1).alias("k"), F.col("id").alias("at"), F.col("id").alias("_hbin"))
    found = rolling.rolling(df, ["k"], "at", 500, n=F.count("*"))
    assert found.agg(F.min("n"), F.max("n"), F.count("*")).first() == (1, 501, 50_000)
    assert found.filter("at = _hbin").count() == 50_000  # a column named like those used inside


def test_top_per_group(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([1, 1, 1, 1, 2, None]), rnd.choice([None, 1, 2, 3]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, v int, i int").repartition(4)
    found = topk.top_per_group(df, ["g"], [F.desc_nulls_last("v"), F.asc("i")], 7)
    want = []
    for g in (1, 2, None):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-(r[1] or -9), r[2]))[:7]
        want += [(*r, n + 1) for n, r in enumerate(mine)]
    assert _rows(found) == sorted(map(repr, want))
    assert topk.top_per_group(df.limit(0), ["g"], [F.asc("i")], 3).count() == 0
    with pytest.raises(ValueError, match="rank"):
        topk.top_per_group(df.withColumn("RANK", F.lit(1)), ["g"], [F.asc("i")], 3)
    assert topk.top(df, [F.asc("i")], 5).count() == 5
    plan = topk.top(df, [F.asc("i")], 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan  # each task keeps its own first rows


def test_sketches_merge_within_the_bound(spark):
    df = spark.range(60_000).select((F.col("id") % 24).alias("hour"), (F.col("id") * 7919 % 20_011).alias("v"))
    df = df.unionAll(spark.createDataFrame([(0, None), (99, None)], "hour long, v long"))
    hours = distinct.sketches(df, ["hour"], "v")
    whole = distinct.merged(hours.withColumn("all", F.lit(1)), ["all"]).first()["estimate"]
    assert abs(whole - 20_011) <= distinct.bound() * 20_011
    counts = {r.hour: r.n for r in distinct.exact(df, ["hour"], "v").collect()}
    assert counts[99] == 0 and counts[0] == 2_500 and len(counts) == 25
    for r in distinct.merged(hours, ["hour"]).collect():
        assert abs(r.estimate - counts[r.hour]) <= max(1, distinct.bound() * counts[r.hour])
    assert distinct.exact(df.limit(0), ["hour"], "v").count() == distinct.merged(distinct.sketches(df.limit(0), ["hour"], "v"), ["hour"]).count() == 0


def test_multisets_with_nulls_and_repeats(spark):
    a = spark.createDataFrame([(1, None)] * 3 + [(None, "x")] * 2 + [(2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, None)] + [(None, "x")] * 5 + [(2, "z")], "k int, v string")
    assert _rows(a.exceptAll(b)) == ["(1, None)", "(1, None)", "(2, 'y')"]
    assert _rows(a.intersectAll(b)) == ["(1, None)", "(None, 'x')", "(None, 'x')"]
    assert a.exceptAll(b.limit(0)).count() == 6 and a.intersectAll(b.limit(0)).count() == 0


def _batches(rows, most):
    out = []
    for k in sorted({r[0] for r in rows}, key=lambda x: (x is not None, x)):
        n = batch = weight = 0
        first = None
        for _, i, w in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            w = w or 0
            if n and weight + w > most or not n:
                if n:
                    out.append((k, batch, first, n, weight))
                batch, first, n, weight = batch + 1, i, 0, 0
            n, weight = n + 1, weight + w
        out.append((k, batch, first, n, weight))
    return sorted(map(repr, out))


@pytest.mark.parametrize("size", [10_000, 7])
def test_batches_match_a_loop(spark, size):
    rnd = random.Random(3)
    rows = [(rnd.choice([1, 2, 3, None]), i, rnd.choice([None, 0, 1, 5, 9, 30])) for i in range(300)]
    spark.createDataFrame(rows, "k long, i long, w long").repartition(3).createOrReplaceTempView("heddle_test_rows")
    budget.register(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
    try:
        for most in (0, 10, 25):
            found = spark.sql(f"SELECT * FROM heddle_batches(TABLE(SELECT k, i, w FROM heddle_test_rows) PARTITION BY k ORDER BY i, {most})".replace("BY i,", "BY (i),"))
            assert _rows(found) == _batches(rows, most)
        empty = spark.sql("SELECT * FROM heddle_batches(TABLE(SELECT k, i, w FROM heddle_test_rows WHERE k > 9) PARTITION BY (k), 5)")
        assert empty.count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_greedy_goes_on_with_an_open_batch():
    assert budget.greedy(np.array([3, 3, 3]), 6, -1).tolist() == [0, 2]
    assert budget.greedy(np.array([3, 3, 3]), 6, 3).tolist() == [1]
    assert budget.greedy(np.array([0, 0]), 6, 6).tolist() == []
