"""Carts: what users put together before they buy or leave, as a table and as a stream with state.

A ``click`` puts something into the user's cart, worth the event's value. A ``purchase`` closes a cart as ``bought``; with no cart open it
does nothing. A cart whose user neither clicks nor buys for ``gap`` is ``left``, at the time when the gap has passed. Events of a user are taken by
time, those of one time by ``event_id``; other types of events, and events without user or time, play no part. Values are added up in hundredths, so the order of
additions cannot show.

The stream gives the rows of the table. Events wait in the user's state until the watermark has passed them, so it doesn't
matter in which order they come; what comes later than the watermark is dropped by Spark. State per user: the open cart (four numbers) and the
events that wait, those of the watermark's delay. A timer wakes a user whose next event is due or whose cart is to be closed.
The stream needs the RocksDB state store (``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from heddle.streaming.events import timed

GAP_SECONDS = 2 * 3600
CARTS = "user_id long, opened timestamp, closed timestamp, n long, cents long, outcome string"


def _moves(events: DataFrame) -> DataFrame:
    """Clicks and purchases with their worth in hundredths."""
    kept = timed(events).filter(F.col("event_type").isin("click", "purchase") & F.col("user_id").isNotNull() & F.col("ts").isNotNull())
    cents = F.coalesce(F.round(F.col("value") * 100), F.lit(0)).cast("long")
    return kept.select("user_id", "ts", "event_id", (F.col("event_type") == "purchase").alias("buys"), cents.alias("cents"))


def carts(events: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """All carts of a table, those that are still open at its end as left."""
    mine = Window.partitionBy("user_id").orderBy("ts", "event_id")
    moves = _moves(events)
    near = F.col("ts") < F.lag("ts").over(mine) + F.make_dt_interval(secs=F.lit(gap))
    goes_on = F.coalesce(near & ~F.lag("buys").over(mine), F.lit(False))
    marked = moves.withColumn("goes_on", goes_on).filter(F.col("goes_on") | ~F.col("buys"))
    numbered = marked.withColumn("k", F.sum((~F.col("goes_on")).cast("long")).over(mine))
    clicks = ~F.col("buys")
    bought = F.max(F.when(F.col("buys"), F.col("ts")))
    grouped = numbered.groupBy("user_id", "k").agg(
        F.min("ts").alias("opened"), F.max("ts").alias("last"), bought.alias("bought"), F.count_if(clicks).alias("n"),
        F.sum(F.when(clicks, F.col("cents"))).alias("cents"),
    )
    return grouped.select(
        "user_id", "opened", F.coalesce("bought", F.col("last") + F.make_dt_interval(secs=F.lit(gap))).alias("closed"), "n", "cents",
        F.when(F.col("bought").isNotNull(), "bought").otherwise("left").alias("outcome"),
    )


class Cart(StatefulProcessor):
    """Times in the state are microseconds."""

    def __init__(self, gap: int):
        self.gap = gap * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, event_id long, buys boolean, cents long")
        self.open = handle.getValueState("open", "opened long, last long, n long, cents long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new = [(r.micros, r.event_id, r.buys, r.cents) for r in rows]
        self.waiting.appendList(new)
        self.handle.registerTimer(min(x[0] for x in new) // 1000)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        due = [x for x in held if x[0] < now]
        cart = tuple(self.open.get()) if self.open.exists() else None
        was, out = cart, []
        for ts, _, buys, cents in due:
            if cart and ts >= cart[1] + self.gap:
                out.append(self._closed(key, cart, cart[1] + self.gap, "left"))
                cart = None
            if buys and cart:
                out.append(self._closed(key, cart, ts, "bought"))
                cart = None
            elif not buys:
                opened, _, n, worth = cart or (ts, ts, 0, 0)
                cart = (opened, ts, n + 1, worth + cents)
        if cart and cart[1] + self.gap < now:
            out.append(self._closed(key, cart, cart[1] + self.gap, "left"))
            cart = None
        if due:
            later = [x for x in held if x[0] >= now]
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        else:
            later = held
        if cart is None and was is not None:
            self.open.clear()
        elif cart is not None and cart != was:
            self.open.update(cart)
        wake = [x[0] for x in later[:1]] + ([cart[1] + self.gap] if cart else [])
        if wake:
            self.handle.registerTimer(max(min(wake) // 1000, now // 1000 + 1))
        return iter(out)

    def close(self) -> None:
        pass

    @staticmethod
    def _closed(key: tuple, cart: tuple, at: int, outcome: str) -> Row:
        return Row(user_id=key[0], opened_us=cart[0], closed_us=at, n=cart[2], cents=cart[3], outcome=outcome)


def carts_stream(events: DataFrame, gap: int = GAP_SECONDS, late: str = "1 hour") -> DataFrame:
    """Carts of a stream of events, each put out when the watermark (``late`` behind the newest event) has passed its end."""
    moves = _moves(events).withWatermark("ts", late).withColumn("micros", F.unix_micros("ts"))
    found = moves.groupBy("user_id").transformWithState(
        Cart(gap), "user_id long, opened_us long, closed_us long, n long, cents long, outcome string", "Append", "EventTime"
    )
    return found.select(
        "user_id", F.timestamp_micros("opened_us").alias("opened"), F.timestamp_micros("closed_us").alias("closed"), "n", "cents", "outcome"
    )


def use_rocksdb(spark: SparkSession) -> None:
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
