"""Result envelopes, ordered batch results (SNK1, AGG14, TRC3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.operators.gates import MAX_BATCH_FILES, batch_detail

COST_COLUMNS = ("currency", "price_date", "estimate_cost", "known_cost", "complete")
RESULT_ITEM = ("ord", "status_code", "success", "request_id", "document_type", "filename", "data", "detail", "error", "cost")


def reply_detail() -> Column:
    """What a failed reply says: a gate's own text, or the error of a failed extraction with its lead."""
    failed = F.concat(F.lit("Extraction failed: "), F.col("error"))
    return F.when(F.col("status_code") == 422, failed).otherwise(F.coalesce("detail", "error"))


def envelope(with_trace: bool = False) -> Column:
    """Result row as a struct: data on success; else detail, and the error of a failed extraction (422)."""
    ok = F.col("success")
    return F.struct(
        F.col("success"),
        F.col("request_id"),
        F.col("document_type"),
        F.col("filename"),
        F.when(ok, F.col("data")).alias("data"),
        F.when(~ok, reply_detail()).alias("detail"),
        F.when(~ok & (F.col("status_code") == 422), F.col("error")).alias("error"),
        F.struct(*COST_COLUMNS).alias("cost"),
        *([F.col("trace")] if with_trace else []),
    )


def with_status(df: DataFrame) -> DataFrame:
    """Final status: the gate's own code, else 422 for a failed extraction, else 200 (FLT9)."""
    status = F.coalesce("status_code", F.when(F.col("error").isNotNull(), F.lit(422)).otherwise(F.lit(200)))
    return df.withColumn("status_code", status).withColumn("success", F.col("status_code") == 200)


def ordered_results(results: DataFrame, max_files: int = MAX_BATCH_FILES) -> DataFrame:
    """One row per batch: its status and its results in upload order (AGG14).

    A batch over the file limit has status 413, its detail, its number of files and no results; so a
    list never holds more than ``max_files`` results, and is built only from batches within the limit.
    """
    body = envelope()
    item = F.struct("ord", "status_code", *[body[c].alias(c) for c in RESULT_ITEM[2:]])
    totals = results.groupBy("batch_id").agg(F.count("*").alias("total_files"))
    within = results.join(totals.where(F.col("total_files") <= max_files).select("batch_id"), "batch_id", "left_semi")
    listed = within.groupBy("batch_id").agg(F.array_sort(F.collect_list(item)).alias("results"))
    over = F.col("total_files") > max_files
    return totals.join(listed, "batch_id", "left").select(
        "batch_id",
        F.when(over, F.lit(413)).otherwise(F.lit(200)).alias("status_code"),
        F.when(over, batch_detail(max_files)).alias("detail"),
        "total_files",
        "results",
    )
