"""Access rows, log tiers, retention and correlation (LOG2, SNK4, SNK5, JN9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.rounding import round_exact
from docmill.functions.text import blank_to_null, strip

ACCESS_LOGGER = "docmill.access"
WARNING_LEVELS = ("WARNING", "ERROR", "CRITICAL")
RETENTION_DAYS = 30


def client_ip(forwarded_for: Column, real_ip: Column, host: Column) -> Column:
    """First forwarded address, else the proxy's address, else the peer, else ``unknown``."""
    forwarded = F.when(blank_to_null(forwarded_for).isNotNull(), strip(F.substring_index(forwarded_for, ",", 1)))
    proxied = F.when(blank_to_null(real_ip).isNotNull(), strip(real_ip))
    return F.coalesce(forwarded, proxied, host, F.lit("unknown"))


def access_rows(requests: DataFrame) -> DataFrame:
    """Access log row of each request: address, rounded duration, 500 for an exception (LOG2)."""
    path = F.concat(
        F.col("path"), F.when(F.col("query") != "", F.concat(F.lit("?"), F.col("query"))).otherwise(F.lit(""))
    )
    ip = client_ip(F.col("forwarded_for"), F.col("real_ip"), F.col("host"))
    status = F.when(F.col("failed"), F.lit(500)).otherwise(F.col("status_code"))
    duration = round_exact(F.col("duration_seconds") * 1000.0, 2)
    out = requests.withColumns({"client_ip": ip, "status_code": status, "duration_ms": duration})
    message = F.format_string(
        '%s - "%s %s" %s %sms', "client_ip", "method", path, F.col("status_code").cast("string"),
        F.col("duration_ms").cast("string"),
    )
    return out.withColumn("message", message)


def with_log_date(logs: DataFrame) -> DataFrame:
    return logs.withColumn("log_date", F.to_date(F.left("timestamp", F.lit(10))))


def app_tier(logs: DataFrame) -> DataFrame:
    """Everything but access rows."""
    return logs.filter(F.coalesce(F.col("logger") != ACCESS_LOGGER, F.lit(True)))


def error_tier(logs: DataFrame) -> DataFrame:
    """Warnings and worse, access rows excluded."""
    return app_tier(logs).filter(F.col("level").isin(*WARNING_LEVELS))


def access_tier(logs: DataFrame) -> DataFrame:
    return logs.filter(F.col("logger") == ACCESS_LOGGER)


TIERS = {"app": app_tier, "error": error_tier, "access": access_tier}


def with_tier(logs: DataFrame) -> DataFrame:
    """Each row once per tier it belongs to, with the tier's name: one pass over the logs for all tiers (SNK4)."""
    access = F.coalesce(F.col("logger") == ACCESS_LOGGER, F.lit(False))
    tiers = F.when(access, F.array(F.lit("access"))).when(
        F.col("level").isin(*WARNING_LEVELS), F.array(F.lit("app"), F.lit("error"))
    ).otherwise(F.array(F.lit("app")))
    return logs.withColumn("tier", F.explode(tiers))


def retained(logs: DataFrame, as_of: Column | None = None, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows within the retention time; a partition filter when written by ``log_date`` (SNK5)."""
    today = as_of if as_of is not None else F.current_date()
    return logs.filter(F.col("log_date") >= F.date_sub(today, days))


def correlate(results: DataFrame, logs: DataFrame) -> DataFrame:
    """Log counts of each request next to its result (JN9): logs are summed before the join."""
    per_request = logs.filter(F.col("request_id") != "-").groupBy("request_id").agg(
        F.count("*").alias("log_lines"),
        F.count_if(F.col("level").isin(*WARNING_LEVELS)).alias("warnings"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.max("trace_id").alias("trace_id"),
        F.max("span_id").alias("span_id"),
        F.max("correlation_id").alias("correlation_id"),
    )
    return results.join(per_request, "request_id", "left")
