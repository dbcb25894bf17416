"""Price list: JSON file to rate tables (SRC7, JN5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Member names of the price file.
_RATE = (
    "input_usd_per_million_tokens string, output_usd_per_million_tokens string, "
    "cached_input_usd_per_million_tokens string"
)
_TIER = (
    "max_input_tokens bigint, input_usd_per_million_tokens string, output_usd_per_million_tokens string, "
    "cached_input_usd_per_million_tokens string"
)
_STRUCT_RATE = _RATE.replace(" string", ": string")
_STRUCT_TIER = _TIER.replace(" string", ": string").replace(" bigint", ": bigint")
PRICE_FILE = (
    "effective_date string, "
    f"llm_rates map<string, map<string, struct<{_STRUCT_RATE}, tiers: array<struct<{_STRUCT_TIER}>>>>>, "
    "ocr_rates map<string, map<string, struct<usd_per_thousand_units: string>>>"
)
#: Prices per token or unit keep 18 decimals, so list prices per million keep 12; finer ones are violations.
MONEY = "decimal(20,12)"


def read_price_file(spark: SparkSession, path: str) -> DataFrame:
    """The price list of a file; an empty path means no prices, so that every event stays unpriced."""
    if not path:
        return spark.createDataFrame([], PRICE_FILE)
    return spark.read.schema(PRICE_FILE).option("multiLine", True).json(path)


def price_date(prices: DataFrame) -> str | None:
    """Effective date of a price list, which is one row."""
    row = prices.select("effective_date").first()
    return row["effective_date"] if row else None


RATE_NAMES = ("input_usd_per_million_tokens", "output_usd_per_million_tokens", "cached_input_usd_per_million_tokens")
_PRICES = {"input": "input_rate", "output": "output_rate", "cached_input": "cached_rate"}


def _per_key(prices: DataFrame, column: str, key: str) -> DataFrame:
    return prices.select("effective_date", F.explode(column).alias("service", "__by_key")).select(
        "effective_date", "service", F.explode("__by_key").alias(key, "rate")
    )


def _money(text: Column) -> Column:
    """An exact price, or null: no number, too large, or with more decimals than a price keeps."""
    wide = text.try_cast("decimal(38,18)")
    return F.when(wide == wide.try_cast(MONEY), wide.try_cast(MONEY))


def _bad(*texts: Column) -> Column:
    """Whether a price is given but is no exact price."""
    out = F.lit(False)
    for t in texts:
        decimals = F.length(F.regexp_extract(t, r"\.(\d*[1-9])0*$", 1))
        out = out | (t.isNotNull() & (_money(t).isNull() | (decimals > 12)))
    return out


def model_rates(prices: DataFrame, dated: bool = False) -> DataFrame:
    """One row per (service, model) and token range; with ``dated`` also per price list, by its ``effective_date``.

    A flat rate has an open range.  The first tier is open below, a tier ends at its own limit, and
    nothing lies above the last one.
    """
    rates = _per_key(prices, "llm_rates", "model")
    flat = F.array(
        F.struct(
            F.lit(None).cast("bigint").alias("max_input_tokens"),
            *[F.col(f"rate.{p}_usd_per_million_tokens") for p in ("input", "output", "cached_input")],
        )
    )
    by = ["effective_date"] if dated else []
    steps = rates.select(
        *by, "service", "model", F.posexplode(F.coalesce("rate.tiers", flat)).alias("tier", "r")
    )
    below = Window.partitionBy(*by, "service", "model").orderBy("tier")
    return steps.select(
        *by,
        "service",
        "model",
        "tier",
        F.lag("r.max_input_tokens").over(below).alias("min_exclusive"),
        F.col("r.max_input_tokens").alias("max_input_tokens"),
        *[_money(F.col(f"r.{p}_usd_per_million_tokens")).alias(n) for p, n in _PRICES.items()],
        _bad(*[F.col(f"r.{p}_usd_per_million_tokens") for p in _PRICES]).alias("invalid"),
    )


def unit_rates(prices: DataFrame, dated: bool = False) -> DataFrame:
    text = F.col("rate.usd_per_thousand_units")
    return _per_key(prices, "ocr_rates", "feature").select(
        *(["effective_date"] if dated else []), "service", "feature", _money(text).alias("rate_per_thousand"), _bad(text).alias("invalid")
    )


def unit_violations(rates: DataFrame) -> DataFrame:
    """Unit prices that make a price list invalid (JN5)."""
    problem = F.coalesce(
        F.when(F.col("invalid"), F.lit("rate_invalid")),
        F.when(F.col("rate_per_thousand").isNull(), F.lit("rate_missing")),
        F.when(F.col("rate_per_thousand") < 0, F.lit("rate_negative")),
    )
    return rates.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def rate_violations(rates: DataFrame) -> DataFrame:
    """Rows that make a price list invalid: tier limits not rising or not positive, bad rates (JN5)."""
    limit, low = F.col("max_input_tokens"), F.col("min_exclusive")
    problem = F.coalesce(
        F.when(limit <= 0, F.lit("limit_not_positive")),
        F.when(low.isNotNull() & ~F.coalesce(limit > low, F.lit(False)), F.lit("limits_not_increasing")),
        F.when(F.col("invalid"), F.lit("rate_invalid")),
        F.when(F.col("input_rate").isNull() | F.col("output_rate").isNull(), F.lit("rate_missing")),
        F.when(
            F.least("input_rate", "output_rate", F.coalesce("cached_rate", F.lit(0).cast(MONEY))) < 0,
            F.lit("rate_negative"),
        ),
    )
    return rates.withColumn("problem", problem).filter(F.col("problem").isNotNull())
