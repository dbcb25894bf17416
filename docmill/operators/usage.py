"""Provider responses to usage events (USE1-USE6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.operators.cost import MODEL_CALL, UNIT_CALL

# Providers whose calls leave no usage rows (USE5).
LOCAL_PROVIDERS = ("ollama",)


def _n(path: str) -> Column:
    return F.try_variant_get(F.col("__usage"), f"$.{path}", "bigint")


def _or_zero(path: str) -> Column:
    return F.coalesce(_n(path), F.lit(0))


def model_usage(calls: DataFrame) -> DataFrame:
    """Token counts of model calls (USE1-USE3, USE5, USE6): every call is a row, none is merged.

    ``calls`` has request_id, provider_style (openai or google), service, model, failed, status_code
    and usage (JSON text).  A failed openai-style call leaves a row, with null counts, only when it
    has no status or one of 500 and more.
    """
    google = F.col("provider_style") == "google"
    counted = ~F.col("failed")
    keep = (
        counted | google | F.col("status_code").isNull() | (F.col("status_code") >= 500)
    ) & ~F.col("provider_style").isin(*LOCAL_PROVIDERS)

    google_in = _n("prompt_token_count") + _or_zero("tool_use_prompt_token_count")
    google_out = _n("candidates_token_count") + _or_zero("thoughts_token_count")
    cached = F.when(google, _or_zero("cached_content_token_count")).otherwise(
        _or_zero("prompt_tokens_details.cached_tokens")
    )
    return (
        calls.filter(keep)
        .withColumn("__usage", F.try_parse_json("usage"))
        .select(
            "request_id",
            F.lit(MODEL_CALL).alias("kind"),
            "service",
            "model",
            F.lit(None).cast("string").alias("feature"),
            F.when(counted, F.when(google, google_in).otherwise(_n("prompt_tokens"))).alias("input_tokens"),
            F.when(counted, F.when(google, google_out).otherwise(_n("completion_tokens"))).alias("output_tokens"),
            F.when(counted, cached).otherwise(F.lit(0)).alias("cached_input_tokens"),
            F.lit(None).cast("bigint").alias("units"),
        )
    )


def unit_usage(calls: DataFrame, service: str = "google_vision", feature: str = "document_text_detection") -> DataFrame:
    """One unit per recognised image, null units for a failed call (USE4)."""
    none = F.lit(None).cast("bigint")
    return calls.select(
        "request_id",
        F.lit(UNIT_CALL).alias("kind"),
        F.lit(service).alias("service"),
        F.lit(None).cast("string").alias("model"),
        F.lit(feature).alias("feature"),
        none.alias("input_tokens"),
        none.alias("output_tokens"),
        none.alias("cached_input_tokens"),
        F.when(~F.col("failed"), F.lit(1).cast("bigint")).alias("units"),
    )
