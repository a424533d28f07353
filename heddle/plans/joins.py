"""Queries over the as-of and range joins, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.order import cell
from heddle.operators.asof import asof_join
from heddle.operators.carry import carried
from heddle.operators.ranges import holding, overlapping, points_in_intervals
from heddle.sources import table

#: Days that an order stays open, by its priority.
OPEN_DAYS = {"1-URGENT": 3, "2-HIGH": 10, "3-MEDIUM": 30, "4-NOT SPECIFIED": 90, "5-LOW": 365}


def _orders(spark, sf_dir: str, *names: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(*names)


def _shipped(spark, sf_dir: str) -> DataFrame:
    """Lines with their order's customer."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    owners = _orders(spark, sf_dir, "o_orderkey", "o_custkey")
    return lines.join(owners, lines["l_orderkey"] == owners["o_orderkey"]).drop("o_orderkey")


def asof_events_orders(spark, sf_dir: str) -> DataFrame:
    """Each event with the last order before it of the customer of the user's number."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    orders = _orders(spark, sf_dir, "o_orderkey", "o_custkey", "o_orderdate")
    found = asof_join(events, orders, {"user_id": "o_custkey"}, "ts", "o_orderdate", ties=("o_orderkey",))
    return found.select("event_id", "user_id", "o_orderkey", "o_orderdate")


def asof_ship_orders(spark, sf_dir: str) -> DataFrame:
    """Each line with the latest order of its customer when it was shipped, at most 60 days old."""
    orders = _orders(spark, sf_dir, "o_orderkey", "o_custkey", "o_orderdate").toDF("latest", "owner", "day")
    sixty = F.expr("INTERVAL 60 DAYS")
    found = asof_join(_shipped(spark, sf_dir), orders, {"o_custkey": "owner"}, "l_shipdate", "day", within=sixty, ties=("latest",))
    return found.select("l_orderkey", "l_linenumber", "latest", "day")


def asof_next_purchase(spark, sf_dir: str) -> DataFrame:
    """Views with the user's next purchase, if there is one."""
    events = table(spark, sf_dir, "events")
    views = events.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    bought = events.filter("event_type = 'purchase'").select(F.col("event_id").alias("bought"), F.col("user_id").alias("buyer"), F.col("ts").alias("bought_at"))
    found = asof_join(views, bought, {"user_id": "buyer"}, "ts", "bought_at", how="inner", direction="forward", strict=True, ties=("bought",))
    return found.select("event_id", "bought", "bought_at")


def _open_orders(spark, sf_dir: str, *names: str) -> DataFrame:
    """Orders as intervals: the date, and when their priority's days have passed."""
    days = F.create_map(*[F.lit(x) for pair in OPEN_DAYS.items() for x in pair])
    end = F.col("o_orderdate") + F.make_dt_interval(days[F.col("o_orderpriority")])
    return _orders(spark, sf_dir, "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority").select(
        "o_orderkey", "o_custkey", "o_orderdate", end.alias("until")
    ).toDF(*names)


def range_lines_in_orders(spark, sf_dir: str) -> DataFrame:
    """Lines shipped while other orders of the same customer were open: how many, and the first and last of them."""
    spans = _open_orders(spark, sf_dir, "other", "owner", "opened", "closed")
    found = points_in_intervals(_shipped(spark, sf_dir), spans, {"o_custkey": "owner"}, "l_shipdate", "opened", "closed")
    found = found.filter("other <> l_orderkey")
    return found.groupBy("l_orderkey", "l_linenumber").agg(
        F.count("*").alias("n"), F.min("other").alias("least"), F.max("other").alias("greatest")
    )


def range_idle_lines(spark, sf_dir: str) -> DataFrame:
    """Lines that were shipped when no order of their customer was open."""
    spans = _open_orders(spark, sf_dir, "other", "owner", "opened", "closed")
    found = points_in_intervals(_shipped(spark, sf_dir), spans, {"o_custkey": "owner"}, "l_shipdate", "opened", "closed", closed="both", how="anti")
    return found.select("l_orderkey", "l_linenumber", "l_shipdate")


def range_overlapping_orders(spark, sf_dir: str) -> DataFrame:
    """Orders of one customer that were open at the same time: for each, how many later ones, and days in common."""
    one, two = (_open_orders(spark, sf_dir, *(f"{x}_{n}" for n in ("key", "owner", "from", "to"))) for x in "ab")
    found = overlapping(one, two, {"a_owner": "b_owner"}, ("a_from", "a_to"), ("b_from", "b_to")).filter("a_key < b_key")
    common = F.date_diff(F.least("a_to", "b_to"), F.greatest("a_from", "b_from"))
    return found.groupBy("a_key").agg(F.count("*").alias("n"), F.sum(common).alias("days"))


def range_error_bursts(spark, sf_dir: str) -> DataFrame:
    """Purchases of any user in the minutes after an error, as many as the error's value (a join without equal keys)."""
    events = table(spark, sf_dir, "events")
    bought = events.filter("event_type = 'purchase'").select("event_id", "ts")
    minutes = F.make_dt_interval(mins=F.floor("value").cast("int"))
    errors = events.filter("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("ts").alias("since"), (F.col("ts") + minutes).alias("till"))
    found = holding(bought, errors, {}, "ts", "since", "till", "error_id", ("errors", "least", "greatest"))
    return found.groupBy("event_id").agg(F.sum("errors").alias("n"), F.min("least").alias("first_error"))


def range_sessions(spark, sf_dir: str) -> DataFrame:
    """Errors of any user within the other users' sessions (events less than 30 minutes apart), counted by session."""
    events = table(spark, sf_dir, "events")
    mine = Window.partitionBy("user_id").orderBy("ts")
    fresh = F.coalesce(F.col("ts") >= F.lag("ts").over(mine) + F.expr("INTERVAL 30 MINUTES"), F.lit(True))
    marked = events.select("user_id", "ts", fresh.cast("int").alias("fresh"))
    numbered = marked.withColumn("k", F.sum("fresh").over(mine.rowsBetween(Window.unboundedPreceding, 0)))
    sessions = numbered.groupBy("user_id", "k").agg(F.min("ts").alias("since"), F.max("ts").alias("till")).drop("k")
    # Errors up to a session's end less those before its start, of all users (group 0) and of its own (group 1); no pairs are made.
    sound = sessions.dropna().select("user_id", "since", cell(sessions, "since").alias("first"), cell(sessions, "till").alias("last"))
    ends = F.array(*[F.struct(at.alias("upto"), F.lit(sign).alias("sign")) for at, sign in ((F.col("last"), 1), (F.col("first") - 1, -1))])
    whose = F.array(*[F.struct(F.lit(g).alias("of_group"), who.alias("who")) for g, who in ((0, F.lit(0).cast("long")), (1, F.col("user_id").cast("long")))])
    asked = sound.select("user_id", "since", F.explode(ends).alias("x"), whose.alias("whose")).select("user_id", "since", "x.*", F.explode("whose").alias("y"))
    asked = asked.select("user_id", "since", "upto", "sign", "y.*")
    errors = events.filter("event_type = 'error'").dropna(subset=["user_id", "ts"]).select(cell(events, "ts").alias("at"), F.explode(whose).alias("y"))
    told = errors.groupBy(F.col("y.of_group").alias("group"), F.col("y.who").alias("of"), "at").agg(F.count("*").alias("errors"))
    found = carried(asked, told, {"of_group": "group", "who": "of"}, "upto", "at", "errors", "upto_now", "sum")
    counted = F.coalesce("upto_now", F.lit(0)) * F.col("sign") * F.when(F.col("of_group") == 0, 1).otherwise(-1)
    return found.groupBy("user_id", "since").agg(F.sum(counted).alias("n")).filter("n > 0")


QUERIES = {
    "j1_asof_events_orders": asof_events_orders, "j1_asof_ship_orders": asof_ship_orders, "j1_asof_next_purchase": asof_next_purchase,
    "j2_range_lines_in_orders": range_lines_in_orders, "j2_range_idle_lines": range_idle_lines,
    "j2_range_overlapping_orders": range_overlapping_orders, "j2_range_error_bursts": range_error_bursts, "j2_range_sessions": range_sessions,
}

_DAYS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in OPEN_DAYS.items())
_SPANS = f"""
s AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS f, o_orderdate + to_days(CASE o_orderpriority {_DAYS} END) AS t FROM orders),
l AS (SELECT l_orderkey, l_linenumber, l_shipdate, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_LAST = "o AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL)"

ORACLES = {
    "j1_asof_events_orders": f"""
WITH {_LAST} SELECT event_id, user_id, o_orderkey, o_orderdate
FROM events ASOF LEFT JOIN o ON user_id = o_custkey AND ts >= o_orderdate""",
    "j1_asof_ship_orders": f"""
WITH {_LAST}, l AS (SELECT l_orderkey, l_linenumber, l_shipdate, o_custkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
j AS (SELECT * FROM l ASOF LEFT JOIN o ON c = o_custkey AND l_shipdate >= o_orderdate)
SELECT l_orderkey, l_linenumber, CASE WHEN l_shipdate - INTERVAL 60 DAYS <= o_orderdate THEN o_orderkey END AS latest,
  CASE WHEN l_shipdate - INTERVAL 60 DAYS <= o_orderdate THEN o_orderdate END AS day FROM j""",
    "j1_asof_next_purchase": """
WITH b AS (SELECT user_id AS buyer, ts AS bought_at, max(event_id) AS bought FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT event_id, bought, bought_at FROM (SELECT * FROM events WHERE event_type = 'view') ASOF JOIN b ON user_id = buyer AND ts < bought_at""",
    "j2_range_lines_in_orders": f"""
WITH {_SPANS} SELECT l_orderkey, l_linenumber, count(*) AS n, min(k) AS least, max(k) AS greatest
FROM l JOIN s ON c = o_custkey AND l_shipdate >= f AND l_shipdate < t WHERE k <> l_orderkey GROUP BY ALL""",
    "j2_range_idle_lines": f"""
WITH {_SPANS} SELECT l_orderkey, l_linenumber, l_shipdate FROM l
WHERE NOT EXISTS (SELECT 1 FROM s WHERE c = o_custkey AND l_shipdate >= f AND l_shipdate <= t)""",
    "j2_range_overlapping_orders": f"""
WITH {_SPANS} SELECT a.k AS a_key, count(*) AS n, sum(date_diff('day', greatest(a.f, b.f), least(a.t, b.t)))::BIGINT AS days
FROM s a JOIN s b ON a.c = b.c AND a.f < b.t AND b.f < a.t AND a.k < b.k GROUP BY ALL""",
    "j2_range_error_bursts": """
WITH e AS (SELECT event_id AS error_id, ts AS since, ts + to_minutes(floor(value)::INT) AS till FROM events WHERE event_type = 'error')
SELECT event_id, count(error_id) AS n, min(error_id) AS first_error
FROM (SELECT * FROM events WHERE event_type = 'purchase') LEFT JOIN e ON ts >= since AND ts < till GROUP BY event_id""",
    "j2_range_sessions": """
WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
s AS (SELECT user_id, min(ts) AS since, max(ts) AS till FROM k GROUP BY user_id, k)
SELECT s.user_id, since, count(*) AS n FROM s JOIN events e ON e.event_type = 'error' AND e.user_id <> s.user_id AND e.ts BETWEEN since AND till GROUP BY ALL""",
}
