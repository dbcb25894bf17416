"""Several tables written together, each micro-batch exactly once (SNK2-SNK4).

A micro-batch writes every table into a folder of its own, ``<table>/batch=<id>``, replacing what an attempt that
died there may have left, and then puts one small file into the ledger by a rename.  Only batches in the ledger are
read, so a batch that died between two tables is not there at all, and one that is run again after its entry was
written does nothing.  The rows of a batch may come out in another order in another attempt, never in two folders.

The input of a batch is read once: it is kept in the shared folder while its tables are written, since recognition or
extraction behind it is costly, and dropped afterwards.

Defined cases: a batch without rows leaves an entry and empty folders; ids may have gaps; two queries must not share
a folder (their ids would meet).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.logs import with_log_date, with_tier
from docmill.operators.results import envelope
from docmill.operators.trace import kept_traces

LEDGER, STAGED = "_ledger", "_staged"
BATCH = "batch"


class Table(NamedTuple):
    """What a table takes from a batch, and the columns its folders are named by."""

    rows: Callable[[DataFrame], DataFrame]
    by: tuple[str, ...] = ()


def result_tables(keep_trace: bool = False) -> dict[str, Table]:
    """Envelopes and traces of result rows, by request date."""
    cols = ["request_date", "request_id", "document_type", "filename", "data", "trace"]
    return {
        "results": Table(lambda df: df.select("request_date", "request_id", F.to_json(envelope()).alias("value")), ("request_date",)),
        "traces": Table(lambda df: kept_traces(df, keep_trace).select(*cols), ("request_date",)),
    }


def tier_table() -> dict[str, Table]:
    """Log lines by tier and day."""
    return {"logs": Table(lambda df: with_tier(with_log_date(df)), ("tier", "log_date"))}


class Ledger:
    """The tables under one folder and the ids of their finished batches."""

    def __init__(self, spark: SparkSession, root: str, tables: Mapping[str, Table]):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), dict(tables)
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _entry(self, batch_id: int):
        return self._path(f"{self.root}/{LEDGER}/{batch_id}.json")

    def finished(self) -> list[int]:
        """Ids in the ledger."""
        folder = self._path(f"{self.root}/{LEDGER}")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def commit(self, batch_id: int) -> bool:
        """Put a batch into the ledger; False if another attempt was first."""
        body = json.dumps({"batch": batch_id, "tables": sorted(self.tables)}).encode()
        aside = self._path(f"{self.root}/{LEDGER}/.{batch_id}.tmp")
        with_bytes = self._fs.create(aside, True)
        with_bytes.write(bytearray(body))
        with_bytes.close()
        return self._fs.rename(aside, self._entry(batch_id))

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Write all tables of a batch, then its entry: the function for ``foreachBatch``."""
        if self._fs.exists(self._entry(batch_id)):
            return
        staged = f"{self.root}/{STAGED}/{batch_id}"
        batch.write.mode("overwrite").parquet(staged)
        rows = batch.sparkSession.read.schema(batch.schema).parquet(staged)
        for name, table in self.tables.items():
            table.rows(rows).write.mode("overwrite").partitionBy(*table.by).parquet(f"{self.root}/{name}/{BATCH}={batch_id}")
        self.commit(batch_id)
        self._fs.delete(self._path(staged), True)

    def read(self, name: str) -> DataFrame:
        """The rows of a table from finished batches only, with the id of their batch."""
        paths = [f"{self.root}/{name}/{BATCH}={i}" for i in self.finished()]
        if not paths:
            raise ValueError("no batch has been finished")
        return self.spark.read.option("basePath", f"{self.root}/{name}").option("mergeSchema", True).parquet(*paths)

    def leftovers(self) -> dict[str, list[int]]:
        """Batch folders of attempts that died and were not run again, by table."""
        done, out = set(self.finished()), {}
        for name in self.tables:
            folder = self._path(f"{self.root}/{name}")
            found = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
            ids = (int(n.split("=")[1]) for n in found if n.startswith(f"{BATCH}="))
            out[name] = sorted(i for i in ids if i not in done)
        return out
