"""Partitioned sinks (SNK1-SNK5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.operators.logs import with_log_date, with_tier
from docmill.operators.results import envelope
from docmill.operators.trace import kept_traces


def write_results(results: DataFrame, path: str, with_trace: bool = False, mode: str = "append") -> None:
    """One JSON envelope per line, by request date (SNK1)."""
    out = results.select("request_date", F.to_json(envelope(with_trace)).alias("value"))
    out.write.mode(mode).partitionBy("request_date").text(path)


def write_traces(results: DataFrame, path: str, keep_trace: bool = False, mode: str = "append") -> None:
    """Trace of each kept request, by request date (SNK2, SNK3)."""
    kept = kept_traces(results, keep_trace)
    cols = ["request_date", "request_id", "document_type", "filename", "data", "trace"]
    kept.select(*cols).write.mode(mode).partitionBy("request_date").json(path)


def write_log_tiers(logs: DataFrame, base: str, mode: str = "append") -> None:
    """Three tiers under ``base``, by tier and date, in one pass over the logs (SNK4)."""
    with_tier(with_log_date(logs)).write.mode(mode).partitionBy("tier", "log_date").json(base)
