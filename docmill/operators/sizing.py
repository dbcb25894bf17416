"""Broadcast only what has been measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 100_000
#: A task of costly per-row work has about so many rows.
ROWS_PER_TASK = 250_000


def small_side(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Mark a lookup side for broadcast when its row count is within the bound.

    The count stops one row past the bound.  A larger side is returned as it is and joins by
    shuffle, where adaptive execution splits skewed keys.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def spread(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """A scan for costly per-row work: on all cores, and in tasks that stay as small however large the table is.

    A file is cut by bytes but read by row groups, so its number of partitions says little about the rows in them; they
    are counted per partition, which reads no column.  A scan that already has enough partitions, none of them too
    large, is left alone, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("__partition")).count().collect()]
    tasks = max(cores, -(-sum(held) // rows_per_task))
    if len(held) >= cores and max(held) <= rows_per_task:
        return df
    return df.repartition(tasks)


def key_tasks(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> int:
    """Into how many tasks rows that meet by key are dealt: the session's number, more where tasks would get too large.

    For tables that are cheap to count.  Streams keep the session's number.
    """
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return usual if df.isStreaming else max(usual, -(-df.count() // rows_per_task))


def dealt(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` over ``tasks`` tasks; joins and groups by just those keys keep to it.

    The session's own number is left to Spark, which may also merge small tasks.
    """
    if tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(tasks, *keys)
