"""The narrow operators run on a stream as they run on a table (STR1).

Summaries per request or batch need to know when a group is complete, which only the caller knows;
they stay batch jobs, or run in ``foreachBatch`` over closed batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from docmill.functions.masking import mask_columns
from docmill.operators.dispatch import extract_mixed, extract_type
from docmill.operators.masking import mask_logs
from docmill.session import shared_root


def extract_stream(texts: DataFrame, slug: str | None = None) -> DataFrame:
    return extract_type(texts, slug) if slug else extract_mixed(texts)


def mask_stream(rows: DataFrame, *names: str) -> DataFrame:
    return mask_columns(rows, *names)


def mask_log_stream(logs: DataFrame) -> DataFrame:
    return mask_logs(logs)


def start(
    stream: DataFrame,
    name: str,
    path: str,
    fallback_checkpoints: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Append a stream to parquet with its own checkpoint folder."""
    root = shared_root(stream.sparkSession, fallback_checkpoints)
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{root}/{name}")
    return (writer.trigger(availableNow=True) if available_now else writer).queryName(name).start()


def start_per_batch(
    stream: DataFrame, name: str, job: Callable[[DataFrame, int], None], fallback_checkpoints: str | None = None
) -> StreamingQuery:
    """Run a batch job on each micro-batch, for summaries over closed groups."""
    root = shared_root(stream.sparkSession, fallback_checkpoints)
    return (
        stream.writeStream.foreachBatch(job)
        .option("checkpointLocation", f"{root}/{name}")
        .trigger(availableNow=True)
        .queryName(name)
        .start()
    )
