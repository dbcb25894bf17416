"""Prices by the list that was valid at the time of the call (SRC7, JN2, JN3).

A list holds until the next one takes effect, as a whole: a model that the newer list leaves out has no price then.
Validities don't overlap, so the list of an event is found by equality on its day and a comparison within the day: the
lists are laid out by day (one row for each day, more where lists change within it), which is a small table with a
checked size, or else a shuffle join whose hot days adaptive execution splits.  Events before the first list have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.operators.cost import price_events
from docmill.operators.sizing import MAX_BROADCAST_ROWS, small_side

LIST = "price_list"


def list_days(prices: DataFrame) -> DataFrame:
    """``day``, ``valid_from``, ``valid_to`` of each list on each day it is valid; the last list has its first day only, without an end."""
    start = F.col("effective_date").try_cast("timestamp")
    # one row per price list in force, a handful for each year
    lists = prices.select(start.alias("valid_from")).where("valid_from is not null").distinct()
    lists = lists.withColumn("valid_to", F.lead("valid_from").over(Window.orderBy("valid_from")))
    last = F.coalesce(F.col("valid_to") - F.expr("interval 1 microsecond"), F.col("valid_from"))
    days = F.sequence(F.to_date("valid_from"), F.to_date(last))
    return lists.select(F.explode(days).alias("day"), "valid_from", "valid_to")


def with_list(events: DataFrame, prices: DataFrame, time: str = "event_time", max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Events with ``price_list``, the time from which the list that is valid for them holds; null before the first."""
    days = list_days(prices)
    end = days.agg(F.max("day").alias("day")).first()["day"]  # one value
    # from the last list's first day on nothing changes any more
    day = F.least(F.to_date(time), F.lit(end)) if end is not None else F.to_date(time)
    days = small_side(days.withColumnRenamed("day", "__day"), max_broadcast_rows)
    valid = (F.col("__at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("__at") < F.col("valid_to")))
    keyed = events.withColumns({"__d": day, "__at": F.col(time)})
    joined = keyed.join(days, (F.col("__d") == F.col("__day")) & valid, "left")
    return joined.select(*events.columns, F.col("valid_from").alias(LIST))


def price_by_date(
    events: DataFrame, prices: DataFrame, model_rates: DataFrame, unit_rates: DataFrame, time: str = "event_time",
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Cost or unpriced reason of every event by the rates valid at its time; rates carry ``effective_date``."""
    at = F.col("effective_date").try_cast("timestamp")
    rates = [r.withColumn(LIST, at).drop("effective_date") for r in (model_rates, unit_rates)]
    return price_events(with_list(events, prices, time, max_broadcast_rows), *rates, max_broadcast_rows, version=LIST)
