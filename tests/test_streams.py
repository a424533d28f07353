"""Streams with state against their tables: arrival out of order, restarts from a checkpoint, late rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from heddle.streaming import carts, joins

SF = "/root/testdata/sf0.001"
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def _rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    carts.use_rocksdb(spark)
    yield
    spark.conf.set(name, before) if before else spark.conf.unset(name)


def _events(n, seed, hours=72, users=4):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        at = START + dt.timedelta(seconds=rnd.randrange(hours * 3600))
        rows.append((i, at, rnd.choice([*range(users), None]), rnd.choice(["click", "click", "purchase", "view"]), rnd.choice([None, 1.25, 0.1, 7.0])))
    return sorted(rows, key=lambda r: r[1])


def _plain(rows, gap):
    """Carts by a loop over each user's events."""
    out, open_ = [], {}
    for i, ts, user, kind, value in sorted((r for r in rows if r[2] is not None and r[3] in ("click", "purchase")), key=lambda r: (r[2], r[1], r[0])):
        cart = open_.get(user)
        if cart and ts >= cart[1] + gap:
            out.append((user, cart[0], cart[1] + gap, cart[2], cart[3], "left"))
            cart = open_.pop(user) and None
        if kind == "purchase":
            if cart:
                out.append((user, cart[0], ts, cart[2], cart[3], "bought"))
                open_.pop(user)
        else:
            first, _, n, cents = cart or (ts, ts, 0, 0)
            open_[user] = (first, ts, n + 1, cents + round((value or 0) * 100))
    return out + [(u, c[0], c[1] + gap, c[2], c[3], "left") for u, c in open_.items()]


def _seen(found):
    return sorted((r.user_id, r.opened, r.closed, r.n, r.cents, r.outcome) for r in found.collect())


def test_carts_of_a_table(spark):
    rows = _events(600, 1)
    rows += [(1000 + i, rows[i][1], rows[i][2], rows[i][3], rows[i][4]) for i in range(0, 60, 3)]  # ties in time
    df = spark.createDataFrame(rows, SCHEMA)
    wanted = spark.createDataFrame(_plain(rows, dt.timedelta(hours=2)), carts.CARTS)
    assert _seen(carts.carts(df)) == _seen(wanted)
    assert carts.carts(df.limit(0)).count() == 0


def _feed(spark, rows, place, name):
    """One file that a stream takes as one batch."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(place / "parts" / name))
    (place / "in").mkdir(exist_ok=True)
    next((place / "parts" / name).glob("part-*")).rename(place / "in" / f"{name}.parquet")


def _run(spark, make, place, mode="append"):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(place / "in"))
    out = make(stream).writeStream.format("parquet").outputMode(mode).option("path", str(place / "out"))
    query = out.option("checkpointLocation", str(place / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    return query.recentProgress


def test_cart_stream_gives_the_table_rows_after_restarts(spark, rocksdb, tmp_path):
    rows = _events(400, 2)
    rnd = random.Random(3)
    # Rows come up to 50 minutes out of order, which the watermark allows for.
    rows.sort(key=lambda r: r[1] + dt.timedelta(minutes=rnd.uniform(0, 50)))
    end = (10_000, START + dt.timedelta(days=30), 999, "click", 1.0)  # moves the watermark past everything else
    parts = [rows[:130], rows[130:260], rows[260:], [end], [(10_001, end[1], 999, "view", 0.0)]]
    for i, part in enumerate(parts):
        _feed(spark, part, tmp_path, f"{i}")
        if i in (1, 3, 4):  # the query ends and starts again from its checkpoint
            _run(spark, carts.carts_stream, tmp_path)
    wanted = carts.carts(spark.createDataFrame(rows, SCHEMA))
    found = spark.read.parquet(str(tmp_path / "out"))
    assert _seen(found) == _seen(wanted) and wanted.filter("outcome = 'left'").count() > 5 and wanted.filter("outcome = 'bought'").count() > 5


def test_rows_behind_the_watermark_are_dropped_and_counted(spark, rocksdb, tmp_path):
    at = lambda h: START + dt.timedelta(hours=h)
    _feed(spark, [(1, at(0), 1, "click", 1.0), (2, at(10), 1, "click", 2.0)], tmp_path, "0")
    _feed(spark, [(3, at(20), 1, "purchase", 0.0)], tmp_path, "1")
    _feed(spark, [(4, at(1), 1, "click", 5.0), (5, at(19.5), 1, "click", 1.0)], tmp_path, "2")  # 4 comes 18 hours late
    _feed(spark, [(6, at(50), 2, "click", 1.0)], tmp_path, "3")
    progress = _run(spark, carts.carts_stream, tmp_path)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert joins.dropped_late(progress) == 1
    assert [(r[0], r[1].hour, r[3], r[5]) for r in _seen(found)] == [(1, 0, 1, "left"), (1, 10, 1, "left"), (1, 19, 1, "bought")]


def test_stream_join_gives_the_table_rows(spark, tmp_path):
    rows = _events(500, 4, hours=48)
    end = [(9_000, START + dt.timedelta(days=9), 77, "click", 0.0), (9_001, START + dt.timedelta(days=9), 77, "purchase", 0.0)]
    end2 = [(i + 2, t + dt.timedelta(days=1), u, k, v) for i, t, u, k, v in end]
    for i, part in enumerate([rows[:200], rows[200:], end, end2]):
        _feed(spark, part, tmp_path, str(i))
        if i in (0, 3):
            _run(spark, lambda s: joins.followed(s.filter("event_type = 'click'"), s.filter("event_type = 'purchase'")), tmp_path)
    df = spark.createDataFrame(rows, SCHEMA)
    wanted = joins.followed(df.filter("event_type = 'click'"), df.filter("event_type = 'purchase'"))
    found = spark.read.parquet(str(tmp_path / "out")).filter("first_id < 9000")
    assert _rows(found.select(wanted.columns)) == _rows(wanted)
    assert found.filter("next_id IS NULL").count() > 10 and found.filter("next_id IS NOT NULL").count() > 10


def test_repeats_go_from_streams_and_tables(spark, tmp_path):
    rows = _events(300, 5)
    twice = [r for r in rows for _ in range(2)]
    for i in range(3):
        _feed(spark, twice[i * 200 : i * 200 + 200], tmp_path, str(i))
        _run(spark, lambda s: joins.once(s, ["event_id"]), tmp_path)
    df = spark.createDataFrame(twice, SCHEMA)
    assert _rows(spark.read.parquet(str(tmp_path / "out"))) == _rows(joins.once(df, ["event_id"])) == _rows(spark.createDataFrame(rows, SCHEMA))
    users = joins.once(spark.createDataFrame(rows, SCHEMA), ["user_id"]).select("user_id", "ts")
    assert _rows(users) == _rows(spark.createDataFrame(rows, SCHEMA).groupBy("user_id").agg(F.min("ts").alias("ts")))
