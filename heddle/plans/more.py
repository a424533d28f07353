"""Queries over carts, stream joins, rolling frames, top rows, mergeable counts, multisets and JSON, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions.budget import Batches
from heddle.operators import distinct, rolling, topk
from heddle.sources import frames, table
from heddle.streaming import carts, joins


def _plain(df: DataFrame, *times: str) -> DataFrame:
    """Times without zone, as in the tables."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


def carts_of_users(spark, sf_dir: str) -> DataFrame:
    return _plain(carts.carts(table(spark, sf_dir, "events")), "opened", "closed")


def views_then_purchases(spark, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    found = joins.followed(events.filter("event_type = 'view'"), events.filter("event_type = 'purchase'"), within="12 hours")
    return _plain(found, "first_ts", "next_ts")


def first_of_each_type(spark, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return _plain(joins.once(events, ["user_id", "event_type"]), "ts").select("user_id", "event_type", "ts")


def rolling_spend(spark, sf_dir: str) -> DataFrame:
    """Orders with what their customer ordered in the year up to them, in cents."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", cents.alias("cents"))
    return rolling.rolling(
        orders, ["o_custkey"], "o_orderdate", 365 * 86_400, n=F.count("*"), spent=F.sum("cents"), greatest=F.max("cents")
    )


def top_lines(spark, sf_dir: str) -> DataFrame:
    """The five dearest lines of each supplier."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return topk.top_per_group(lines, ["l_suppkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 5)


def top_orders(spark, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return topk.top(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], 100)


def daily_users(spark, sf_dir: str) -> DataFrame:
    """Different users of each day: the exact count, and whether the estimate merged from hourly sketches is within five standard errors of it."""
    events = table(spark, sf_dir, "events").select("user_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"))
    day = F.to_date("hour").alias("day")
    hourly = distinct.sketches(events, ["hour"], "user_id")
    daily = distinct.merged(hourly.withColumn("day", day), ["day"])
    counted = distinct.exact(events.withColumn("day", day), ["day"], "user_id")
    near = F.abs(F.col("estimate") - F.col("n")) <= F.greatest(F.lit(1.0), F.col("n") * distinct.bound())
    return counted.join(daily, "day").select("day", "n", near.alias("near"))


def _lines(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Flags and modes of lines as they are, and corrected: returned lines shipped in 1995 become open, and unknown (null) statuses are added."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", F.year("l_shipdate").alias("year"))
    early = (F.col("l_returnflag") == "R") & (F.col("year") == 1995)
    fixed = lines.withColumn("l_returnflag", F.when(early, "N").when(F.col("l_suppkey") % 10 != 0, F.col("l_returnflag")))
    return lines, fixed


def lines_lost(spark, sf_dir: str) -> DataFrame:
    """Lines that the corrected version has fewer of, each as often as it is missing."""
    lines, fixed = _lines(spark, sf_dir)
    return lines.exceptAll(fixed)


def lines_kept(spark, sf_dir: str) -> DataFrame:
    """Lines that both versions have, each as often as both have it."""
    lines, fixed = _lines(spark, sf_dir)
    return lines.intersectAll(fixed)


def event_props(spark, sf_dir: str) -> DataFrame:
    """Values from the events' JSON, read once as a variant. A malformed text, a missing path and a value of another kind are null."""
    rows = table(spark, sf_dir, "events").select("event_id", "props")
    # Every eleventh text loses its last brace, every thirteenth has a text where a number is expected.
    broken = F.when(F.col("event_id") % 11 == 0, F.rtrim(F.lit("}"), F.col("props"))).when(
        F.col("event_id") % 13 == 0, F.lit('{"k": "none", "list": [1, 2]}')
    ).otherwise(F.col("props"))
    read = rows.select("event_id", F.try_parse_json(broken).alias("v"))
    return read.select(
        "event_id", F.col("v").isNotNull().alias("sound"), F.try_variant_get("v", "$.k", "bigint").alias("k"),
        F.try_variant_get("v", "$.list[1]", "bigint").alias("second"),
    )


def event_batches(spark, sf_dir: str) -> DataFrame:
    """Each user's events in batches of 100 at most, taken greedily in their order."""
    cents = F.coalesce(F.round(F.col("value") * 100), F.lit(0)).cast("long")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", cents.alias("cents"), "ts")
    return Batches(rows.asTable().partitionBy("user_id").orderBy("ts", "event_id"), F.lit(10_000))


def frames_round_trip(spark, sf_dir: str) -> DataFrame:
    """All lines, written to the library's own files by order and read back, summed for each order."""
    place = frames.scratch(spark)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate")
    frames.write_frames(lines, place, "l_orderkey")
    back = frames.read_frames(spark, place)
    return back.groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.max("l_shipdate").alias("last"), F.min("l_returnflag").alias("flag")
    )


QUERIES = {
    "i14_carts": carts_of_users, "i15_views_then_purchases": views_then_purchases, "i16_first_of_each_type": first_of_each_type,
    "i17_rolling_spend": rolling_spend, "i18_top_lines": top_lines, "i18_top_orders": top_orders, "i19_daily_users": daily_users,
    "i20_lines_lost": lines_lost, "i20_lines_kept": lines_kept, "i21_event_props": event_props, "i22_event_batches": event_batches, "s1_frames_round_trip": frames_round_trip,
}

_BOTH = """
a AS (SELECT l_suppkey, l_returnflag, year(l_shipdate)::INT AS year FROM lineitem),
b AS (SELECT l_suppkey, CASE WHEN l_returnflag = 'R' AND year = 1995 THEN 'N' WHEN l_suppkey % 10 <> 0 THEN l_returnflag END AS l_returnflag, year FROM a)"""

ORACLES = {
    "i14_carts": """
WITH m AS (SELECT user_id, ts, event_id, event_type = 'purchase' AS buys, coalesce(round(value * 100), 0)::BIGINT AS cents FROM events
  WHERE event_type IN ('click', 'purchase') AND user_id IS NOT NULL AND ts IS NOT NULL),
g AS (SELECT *, coalesce(ts < lag(ts) OVER w + INTERVAL 2 HOUR AND NOT lag(buys) OVER w, false) AS goes FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT *, sum(CASE WHEN goes THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g WHERE goes OR NOT buys)
SELECT user_id, min(ts) AS opened, coalesce(max(ts) FILTER (WHERE buys), max(ts) + INTERVAL 2 HOUR) AS closed, count(*) FILTER (WHERE NOT buys) AS n,
  (sum(cents) FILTER (WHERE NOT buys))::BIGINT AS cents, CASE WHEN bool_or(buys) THEN 'bought' ELSE 'left' END AS outcome FROM k GROUP BY user_id, k""",
    "i15_views_then_purchases": """
SELECT a.user_id, a.event_id AS first_id, a.ts AS first_ts, b.event_id AS next_id, b.ts AS next_ts
FROM (SELECT * FROM events WHERE event_type = 'view') a LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b
ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 12 HOUR""",
    "i16_first_of_each_type": "SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY ALL",
    "i17_rolling_spend": """
WITH c AS (SELECT o_orderkey, o_custkey, o_orderdate, round(o_totalprice * 100)::BIGINT AS cents FROM orders)
SELECT *, count(*) OVER w AS n, (sum(cents) OVER w)::BIGINT AS spent, max(cents) OVER w AS greatest
FROM c WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND CURRENT ROW)""",
    "i18_top_lines": """
SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)::INT AS rank FROM lineitem QUALIFY rank <= 5""",
    "i18_top_orders": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    "i19_daily_users": "SELECT ts::DATE AS day, count(DISTINCT user_id) AS n, true AS near FROM events GROUP BY ALL",
    "i20_lines_lost": f"WITH {_BOTH} SELECT * FROM a EXCEPT ALL SELECT * FROM b",
    "i20_lines_kept": f"WITH {_BOTH} SELECT * FROM a INTERSECT ALL SELECT * FROM b",
    "i21_event_props": """
WITH b AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN rtrim(props, '}') WHEN event_id % 13 = 0 THEN '{"k": "none", "list": [1, 2]}' ELSE props END AS p FROM events),
j AS (SELECT event_id, CASE WHEN json_valid(p) THEN p END AS p FROM b)
SELECT event_id, p IS NOT NULL AS sound, TRY_CAST(json_extract_string(p, '$.k') AS BIGINT) AS k, TRY_CAST(json_extract_string(p, '$.list[1]') AS BIGINT) AS second FROM j""",
    "i22_event_batches": """
WITH RECURSIVE e AS MATERIALIZED (
  SELECT user_id, event_id, coalesce(round(value * 100), 0)::BIGINT AS cents, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (
  SELECT user_id, i, event_id, 1::BIGINT AS batch, cents AS held FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.i, e.event_id, r.batch + (r.held + e.cents > 10000)::BIGINT, CASE WHEN r.held + e.cents > 10000 THEN e.cents ELSE r.held + e.cents END
  FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id AS key, batch, arg_min(event_id, i) AS first_id, count(*) AS n, max(held) AS weight FROM r GROUP BY ALL""",
    "s1_frames_round_trip": """
SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS quantity, max(l_shipdate) AS last, min(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey""",
}
