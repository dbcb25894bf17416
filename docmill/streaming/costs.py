"""Cost summaries of streamed usage events (STR1 with CST5, CST6): per request, and per batch of requests.

A request has no last event, so its summary is closed by event time: when the watermark has passed ``idle`` after the
latest event seen, a timer hands out what the request's state holds and clears it.  The state is one row of totals,
however many events there were.

Late events.  An event that comes after its request was closed, but not behind the watermark, opens the request
anew and leaves a further part; parts add up, so ``merge_parts`` of everything handed out is what the batch job gives.
An event behind the watermark is dropped and counted by Spark (``numRowsDroppedByWatermark`` in the query's
progress), so ``lateness`` has to cover what the source can be late.  Copies of an event within ``lateness``, told by
``event_id``, count once.

Skew.  ``split`` shares the events of each request among so many states by their id, each with parts of its own.

Defined cases: an event without a price makes its part incomplete and adds nothing; one without an event time or a
request id is left out, as no watermark can close it; sums are exact decimals.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from decimal import Context
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docmill.operators.cost import COST, CURRENCY, price_events

#: The state store that timers and typed state need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EXACT = Context(prec=76)
PART = f"request_id {{kind}}, slot int, first_ms long, last_ms long, events long, known_cost {COST}, complete boolean"
FILES = f"batch_id {{kind}}, total_files long, succeeded long, known_cost {COST}, complete boolean, closed_by string"


def use_state_store(spark: SparkSession) -> None:
    """Set the store for the queries that are started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _Closing(StatefulProcessor):
    """Totals of one key with a single timer that moves with its latest event."""

    state: str

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", self.state)

    def _restart(self, at_ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at_ms + self.idle_ms)

    def _finish(self) -> None:
        self.totals.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def close(self) -> None:
        pass


class RequestTotals(_Closing):
    """Adds the priced events of a request; hands out a part when the request has been idle."""

    state = f"first_ms long, last_ms long, events long, known_cost {COST}, complete boolean"

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        first, last, n, known, complete = tuple(self.totals.get()) if self.totals.exists() else (None, None, 0, 0, True)
        for r in rows:
            first = r.at_ms if first is None else min(first, r.at_ms)
            last = r.at_ms if last is None else max(last, r.at_ms)
            n += 1
            if r.estimate_cost is None:
                complete = False
            else:
                known = EXACT.add(known, r.estimate_cost)
        self.totals.update((first, last, n, EXACT.create_decimal(known), complete))
        self._restart(last)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.totals.exists():
            first, last, n, known, complete = self.totals.get()
            self._finish()
            yield Row(request_id=key[0], slot=key[1], first_ms=first, last_ms=last, events=n, known_cost=known, complete=complete)


class BatchTotals(_Closing):
    """Adds the results of a batch; hands it out when all its files are there, or when it has been idle."""

    state = f"expected long, total_files long, succeeded long, known_cost {COST}, complete boolean, last_ms long"

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        expected, n, good, known, complete, last = tuple(self.totals.get()) if self.totals.exists() else (None, 0, 0, 0, True, None)
        for r in rows:
            expected = r.expected_files if expected is None else expected
            n += 1
            good += bool(r.success)
            known = EXACT.add(known, r.known_cost or 0)
            complete = complete and bool(r.complete)
            last = r.at_ms if last is None else max(last, r.at_ms)
        known = EXACT.create_decimal(known)
        if expected is not None and n >= expected:
            self._finish()
            yield Row(batch_id=key[0], total_files=n, succeeded=good, known_cost=known, complete=complete, closed_by="files")
        else:
            self.totals.update((expected, n, good, known, complete, last))
            self._restart(last)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.totals.exists():
            _, n, good, known, complete, _ = self.totals.get()
            self._finish()
            yield Row(batch_id=key[0], total_files=n, succeeded=good, known_cost=known, complete=complete, closed_by="time")


def _ms(interval: timedelta) -> int:
    return interval // timedelta(milliseconds=1)


def _words(interval: timedelta) -> str:
    return f"{_ms(interval)} milliseconds"


def request_cost_parts(
    events: DataFrame, model_rates: DataFrame, unit_rates: DataFrame,
    lateness: timedelta = timedelta(minutes=10), idle: timedelta = timedelta(minutes=30), split: int = 1,
) -> DataFrame:
    """Parts of request summaries from a stream of usage events with ``event_id``, ``request_id`` and ``event_time``."""
    kind = events.schema["request_id"].dataType.simpleString()
    timed = events.where("event_time is not null and request_id is not null").withWatermark("event_time", _words(lateness))
    once = timed.dropDuplicatesWithinWatermark(["event_id"])
    priced = price_events(once, model_rates, unit_rates)
    keyed = priced.select("request_id", F.pmod(F.xxhash64("event_id"), F.lit(split)).cast("int").alias("slot"), "event_time", F.unix_millis("event_time").alias("at_ms"), "estimate_cost")
    parts = keyed.groupBy("request_id", "slot").transformWithState(RequestTotals(_ms(idle)), PART.format(kind=kind), "Append", "EventTime")
    times = {"first_at": F.timestamp_millis("first_ms"), "last_at": F.timestamp_millis("last_ms")}
    return parts.withColumns(times).drop("first_ms", "last_ms")


def merge_parts(parts: DataFrame, price_date: str | None = None) -> DataFrame:
    """One summary per request from all its parts: the columns of ``summarize_requests`` and the number of parts."""
    sums = parts.groupBy("request_id").agg(
        F.sum("known_cost").cast(COST).alias("known_cost"), F.bool_and("complete").alias("complete"), F.sum("events").alias("events"), F.count("*").alias("parts")
    )
    return sums.select(
        "request_id",
        F.lit(CURRENCY).alias("currency"),
        F.lit(price_date).cast("date").alias("price_date"),
        F.when(F.col("complete"), F.col("known_cost")).alias("estimate_cost"),
        "known_cost",
        "complete",
        "events",
        "parts",
    )


def batch_cost_stream(results: DataFrame, lateness: timedelta = timedelta(minutes=10), idle: timedelta = timedelta(minutes=30)) -> DataFrame:
    """Batch summaries from a stream of result rows: batch_id, file_id, expected_files, success, known_cost, complete, event_time.

    A batch is closed by its last file, or incomplete in number after ``idle``.
    """
    kind = results.schema["batch_id"].dataType.simpleString()
    timed = results.where("event_time is not null and batch_id is not null").withWatermark("event_time", _words(lateness))
    once = timed.dropDuplicatesWithinWatermark(["batch_id", "file_id"])
    rows = once.select("batch_id", F.col("expected_files").cast("long").alias("expected_files"), "success", F.col("known_cost").cast(COST).alias("known_cost"), "complete", "event_time", F.unix_millis("event_time").alias("at_ms"))
    return rows.groupBy("batch_id").transformWithState(BatchTotals(_ms(idle)), FILES.format(kind=kind), "Append", "EventTime")
