"""Decimal-exact usage pricing and summaries (JN2-JN4, CST1-CST7, AGG12, AGG13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.operators.gates import MAX_BATCH_FILES, batch_detail
from docmill.operators.sizing import MAX_BROADCAST_ROWS, small_side

MODEL_CALL, UNIT_CALL = "llm", "ocr"
CURRENCY = "USD"
COST = "decimal(38,18)"
# A count times a price per token or unit has 36 digits at most, and the sum of three such products 38: all exact.
COUNT, PRICE = "decimal(11,0)", "decimal(24,18)"


def _count(c: Column) -> Column:
    return c.try_cast(COUNT)


def _per(rate: str, shift: str) -> Column:
    """A list price per million or thousand as the price of one."""
    return (F.col(rate) * F.lit(shift).cast(f"decimal({len(shift) - 2},{len(shift) - 2})")).cast(PRICE)


def price_events(
    events: DataFrame, model_rates: DataFrame, unit_rates: DataFrame, max_broadcast_rows: int = MAX_BROADCAST_ROWS,
    version: str | None = None,
) -> DataFrame:
    """Cost or unpriced reason of every usage event (CST1-CST4): one row in, one row out.

    ``version`` names a column of events and rates alike that tells several price lists apart.
    """
    listed = [version] if version else []
    models = small_side(
        model_rates.select(
            F.col("service").alias("__ms"), F.col("model").alias("__mm"), "min_exclusive", "max_input_tokens",
            "input_rate", "output_rate", "cached_rate", *[F.col(v).alias("__mv") for v in listed],
        ),
        max_broadcast_rows,
    )
    units = small_side(
        unit_rates.select(F.col("service").alias("__us"), F.col("feature").alias("__uf"), "rate_per_thousand", *[F.col(v).alias("__uv") for v in listed]),
        max_broadcast_rows,
    )
    tokens = F.col("input_tokens")
    in_tier = (F.col("min_exclusive").isNull() | (tokens > F.col("min_exclusive"))) & (
        F.col("max_input_tokens").isNull() | (tokens <= F.col("max_input_tokens"))
    )
    is_model = F.col("kind") == MODEL_CALL
    of_model = is_model & (F.col("service") == F.col("__ms")) & (F.col("model") == F.col("__mm")) & in_tier
    of_unit = ~is_model & (F.col("service") == F.col("__us")) & (F.col("feature") == F.col("__uf"))
    for v in listed:
        of_model, of_unit = of_model & (F.col(v) == F.col("__mv")), of_unit & (F.col(v) == F.col("__uv"))
    joined = events.join(models, of_model, "left").join(units, of_unit, "left")

    cached = F.coalesce(F.col("cached_input_tokens"), F.lit(0))
    unknown = F.when(
        is_model, F.col("input_tokens").isNull() | F.col("output_tokens").isNull()
    ).otherwise(F.col("units").isNull())
    no_rate = F.when(is_model, F.col("input_rate").isNull()).otherwise(F.col("rate_per_thousand").isNull())
    reason = (
        F.when(unknown, F.lit("usage_unavailable"))
        .when(no_rate, F.lit("rate_unavailable"))
        .when(is_model & (cached != 0) & F.col("cached_rate").isNull(), F.lit("cached_rate_unavailable"))
        .when(is_model & (F.col("input_tokens") < cached), F.lit("invalid_usage"))
    )
    million, thousand = "0.000001", "0.001"
    token_cost = (
        _count(tokens - cached) * _per("input_rate", million)
        + _count(cached) * F.coalesce(_per("cached_rate", million), F.lit(0).cast(PRICE))
        + _count(F.col("output_tokens")) * _per("output_rate", million)
    )
    unit_cost = _count(F.col("units")) * _per("rate_per_thousand", thousand)
    cost = F.when(is_model, token_cost.cast(COST)).otherwise(unit_cost.cast(COST))
    return joined.select(
        *events.columns,
        F.when(reason.isNull(), cost).alias("estimate_cost"),
        reason.alias("unpriced_reason"),
    )


def _summary(known: Column, complete: Column, price_date: str | None) -> list[Column]:
    return [
        F.lit(CURRENCY).alias("currency"),
        F.lit(price_date).cast("date").alias("price_date"),
        F.when(complete, known).alias("estimate_cost"),
        known.alias("known_cost"),
        complete.alias("complete"),
    ]


def summarize_requests(
    priced: DataFrame, requests: DataFrame | None = None, price_date: str | None = None
) -> DataFrame:
    """Cost per request (AGG12, CST5); a request without events costs 0 and is complete."""
    totals = priced.groupBy("request_id").agg(
        F.sum("estimate_cost").alias("__known"), F.bool_and(F.col("estimate_cost").isNotNull()).alias("__complete")
    )
    if requests is not None:
        totals = requests.select("request_id").join(totals, "request_id", "left")
    known = F.coalesce(F.col("__known"), F.lit(0).cast(COST)).cast(COST)
    complete = F.coalesce(F.col("__complete"), F.lit(True))
    return totals.select("request_id", *_summary(known, complete, price_date))


def summarize_batches(results: DataFrame, price_date: str | None = None, max_files: int = MAX_BATCH_FILES) -> DataFrame:
    """Counts and combined cost per batch (AGG13, CST6) from result rows with their cost columns.

    A batch over the file limit is rejected as a whole: status 413 with its number of files, nothing done and
    nothing charged.
    """
    totals = results.groupBy("batch_id").agg(
        F.count("*").alias("total_files"),
        F.count_if("success").alias("succeeded"),
        F.coalesce(F.sum("known_cost"), F.lit(0).cast(COST)).cast(COST).alias("__known"),
        F.bool_and("complete").alias("__complete"),
    )
    over = F.col("total_files") > max_files
    known = F.when(over, F.lit(0).cast(COST)).otherwise(F.col("__known"))
    return totals.select(
        "batch_id",
        F.when(over, F.lit(413)).otherwise(F.lit(200)).alias("status_code"),
        F.when(over, batch_detail(max_files)).alias("detail"),
        (~over & (F.col("succeeded") == F.col("total_files"))).alias("success"),
        "total_files",
        F.when(over, F.lit(0)).otherwise(F.col("succeeded")).cast("long").alias("succeeded"),
        F.when(over, F.lit(0)).otherwise(F.col("total_files") - F.col("succeeded")).cast("long").alias("failed"),
        *_summary(known, over | F.col("__complete"), price_date),
    )


def plain_decimal(c: Column) -> Column:
    """Decimal as text without exponent or trailing zeros (CST7)."""
    return F.regexp_replace(F.when(c == 0, F.lit("0")).otherwise(c.cast("string")), r"(?:(\.\d*?[1-9])|\.)0*$", "$1")
