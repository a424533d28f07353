"""Queries outside the llm subpackage and the SQL that gives the same rows, by name.

Names that start with p are the parity set; those that start with i are reports beyond it, those with j joins, those with s sources.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle import functions, sources
from heddle.operators import constraints, errors, lookup, options, records
from heddle.plans import joins, more, reports
from heddle.streaming import events

FLAGSHIP = "p2_error_list"

#: Fixed values.
HEALTHY = "heddle is running"
ROLES = ("user", "assistant")
SIZES = {"A": "sm", "N": "default", "R": "lg"}
NOTHING_FOUND = "No items found."
VARIANTS = {"view": "outline", "click": "ghost", "purchase": "default", "error": "destructive"}


def p1_healthcheck(spark, sf_dir):
    return sources.constant(spark, HEALTHY)


def p2_error_list(spark, sf_dir):
    """Roles stand for messages and the system's for a blank one; the first text may be content."""
    rows = sources.table(spark, sf_dir, "conversations")
    message = F.when(F.col("role") == "system", F.lit("")).otherwise(F.col("role"))
    lists = rows.groupBy("conv_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("turn", message.alias("message")))), lambda x: F.struct(x["message"].alias("message"))
        ).alias("errors")
    )
    shown = errors.reduce_errors(lists, "conv_id")
    return shown.select("conv_id", "kind", F.array_join("items", "|").alias("items"))


def p2_error_values(spark, sf_dir):
    """The same lists with each message's last turn, which is kept at the message's first place."""
    rows = sources.table(spark, sf_dir, "conversations")
    message = F.when(F.col("role") == "system", F.lit("")).otherwise(F.col("role"))
    lists = rows.groupBy("conv_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("turn", message.alias("message")))), lambda x: F.struct(x["message"].alias("message"), x["turn"].alias("turn"))
        ).alias("errors")
    )
    shown = errors.reduce_errors(lists, "conv_id", whole=True)
    return shown.select("conv_id", "kind", F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["message"], x["turn"])), "|").alias("items"))


def p3_option_search(spark, sf_dir):
    return options.search(sources.table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "RING")


def p3_empty_result(spark, sf_dir):
    return options.search_or_message(sources.table(spark, sf_dir, "part"), "p_name", "no such part", NOTHING_FOUND)


def p4_constraints(spark, sf_dir):
    rows = sources.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    broken = constraints.violations(rows, required=("text",), domains={"role": ROLES})
    return rows.select("conv_id", "turn", F.array_join(broken, "; ").alias("violations"))


def p5_record_update(spark, sf_dir):
    rows = sources.table(spark, sf_dir, "labels")
    record = F.struct(F.lit(True).alias("email"), F.lit(False).alias("sms"), F.lit(True).alias("push"))
    held = rows.select("doc_id", record.alias("settings"), F.when(F.col("quality") == 1, F.col("toxic") == 1).alias("input"))
    return records.set_flag(held, "settings", "sms", held["input"]).select("doc_id", "settings.*")


def p6_item_projection(spark, sf_dir):
    nations = sources.table(spark, sf_dir, "nation")
    return options.items(nations, key=F.col("n_nationkey"), value=F.col("n_name"))


def p6_array_projection(spark, sf_dir):
    """Nations of a region as an array, latest key first; the text shows that the order is kept."""
    lists = sources.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(
        F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")), asc=False).alias("options")
    )
    shown = options.items_of(F.col("options"), place=lambda x, i: i, value=lambda x, i: x["n_name"])
    return lists.select("n_regionkey", F.array_join(F.transform(shown, lambda x: F.concat_ws(":", x["place"], x["value"])), "|").alias("items"))


def p7_variant_axes(spark, sf_dir):
    rows = sources.table(spark, sf_dir, "lineitem")
    status = {"F": "outline", "X": "ghost"}
    found = lookup.variants_of((F.nullif("l_returnflag", F.lit("N")), SIZES, "N"), (F.col("l_linestatus"), status, "X"))
    return rows.select("l_orderkey", "l_linenumber", F.array_join(found, " ").alias("variants"))


def p7_variant_lookup(spark, sf_dir):
    rows = sources.table(spark, sf_dir, "events")
    marks = functions.include((F.col("value") > 50, F.lit("large")), (F.col("event_type") == "error", F.lit("alert")))
    return rows.select(
        "event_id", lookup.variant(F.col("event_type"), VARIANTS, "purchase").alias("variant"), F.array_join(marks, " ").alias("marks")
    )


def i8_label_rollup(spark, sf_dir):
    return reports.label_rollup(sources.table(spark, sf_dir, "documents"), sources.table(spark, sf_dir, "labels"))


def i10_turn_checks(spark, sf_dir):
    return reports.turn_checks(sources.table(spark, sf_dir, "conversations"))


def i13_hourly_events(spark, sf_dir):
    return events.hourly(sources.table(spark, sf_dir, "events")).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


def i13_sessions(spark, sf_dir):
    return events.sessions(sources.table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_healthcheck, p2_error_list, p2_error_values, p3_option_search, p3_empty_result, p4_constraints, p5_record_update, p6_item_projection,
        p6_array_projection, p7_variant_lookup, p7_variant_axes, i8_label_rollup, i10_turn_checks, i13_hourly_events, i13_sessions,
    )
}
QUERIES |= joins.QUERIES | more.QUERIES

ORACLES: dict[str, str] = joins.ORACLES | more.ORACLES | {
    "p1_healthcheck": f"SELECT '{HEALTHY}' AS status",
    "p2_error_list": """
WITH d AS (SELECT conv_id, CASE WHEN role = 'system' THEN '' ELSE role END AS m, min(turn) AS f FROM conversations GROUP BY ALL),
k AS (SELECT conv_id, count(*) AS keys, coalesce(string_agg(m, '|' ORDER BY f) FILTER (m <> ''), '') AS items,
  count(*) FILTER (m <> '') AS shown FROM d GROUP BY conv_id)
SELECT conv_id, CASE WHEN keys = 1 THEN 'scalar' ELSE 'list' END AS kind, items FROM k WHERE keys > 1 OR shown > 0""",
    "p2_error_values": """
WITH d AS (SELECT conv_id, CASE WHEN role = 'system' THEN '' ELSE role END AS m, min(turn) AS f, max(turn) AS l FROM conversations GROUP BY ALL),
k AS (SELECT conv_id, count(*) AS keys, coalesce(string_agg(m || ':' || l, '|' ORDER BY f) FILTER (m <> ''), '') AS items,
  count(*) FILTER (m <> '') AS shown FROM d GROUP BY conv_id)
SELECT conv_id, CASE WHEN keys = 1 THEN 'scalar' ELSE 'list' END AS kind, items FROM k WHERE keys > 1 OR shown > 0""",
    "p3_option_search": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')",
    "p3_empty_result": f"""
WITH f AS (SELECT p_name AS item FROM part WHERE contains(lower(p_name), 'no such part'))
SELECT item, NULL::VARCHAR AS message FROM f UNION ALL SELECT NULL, '{NOTHING_FOUND}' WHERE NOT EXISTS (SELECT 1 FROM f)""",
    "p4_constraints": """
SELECT conv_id, turn, concat_ws('; ', CASE WHEN coalesce(text, '') = '' THEN 'text is required' END,
  CASE WHEN role NOT IN ('user', 'assistant') THEN 'role is not an option' END) AS violations FROM conversations""",
    "p5_record_update": "SELECT doc_id, true AS email, quality = 1 AND toxic = 1 AS sms, true AS push FROM labels",
    "p6_item_projection": "SELECT n_nationkey AS key, n_name AS value FROM nation",
    "p6_array_projection": """
SELECT n_regionkey, string_agg(place || ':' || n_name, '|' ORDER BY place) AS items
FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) - 1 AS place FROM nation) GROUP BY n_regionkey""",
    "p7_variant_axes": """
SELECT l_orderkey, l_linenumber, concat_ws(' ', CASE l_returnflag WHEN 'A' THEN 'sm' WHEN 'R' THEN 'lg' ELSE 'default' END,
  CASE l_linestatus WHEN 'F' THEN 'outline' END) AS variants FROM lineitem""",
    "p7_variant_lookup": """
SELECT event_id, CASE event_type WHEN 'view' THEN 'outline' WHEN 'click' THEN 'ghost' WHEN 'error' THEN 'destructive' ELSE 'default' END AS variant,
  concat_ws(' ', CASE WHEN value > 50 THEN 'large' END, CASE WHEN event_type = 'error' THEN 'alert' END) AS marks FROM events""",
    "i8_label_rollup": """
SELECT source, lang, count(*) AS n_docs, count(quality) AS n_labelled, coalesce(sum(quality), 0)::BIGINT AS n_good,
  coalesce(sum(toxic), 0)::BIGINT AS n_toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (source, lang)""",
    "i10_turn_checks": """
SELECT conv_id, turn, coalesce(turn = lag(turn) OVER w + 1, true) AS follows, coalesce(role <> lag(role) OVER w, true) AS changes
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "i13_hourly_events": """
SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL""",
    "i13_sessions": """
WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
}
