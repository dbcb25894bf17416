"""Manifest and file bytes as one source that opens only the files its filters let through (SRC1, SRC2).

The manifest is a parquet table with ``path`` and ``size_bytes`` and any other columns; the source adds ``content``.
Filters on the manifest's columns (size, type, status and the like) are taken over by the source, so a gated file is
never opened, whatever else the query does.  Tasks get files of about ``partition_mb`` in sum: the plan streams over
the sizes of the rows that pass, one row group at a time, and keeps only where each task begins and ends.

Paths are read through Arrow's file systems: local ones, S3, GCS and, where its library is installed, HDFS.

Defined cases: a null path or a file that is not there has null content; a null size counts as nothing in planning;
one file larger than a partition is a task of its own; filters the source cannot take over are left to Spark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import BinaryType, StructType

NAME = "gated_files"
PARTITION_MB, BATCH_MB = 128, 16


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _manifest(path: str) -> ds.Dataset:
    system, inside = _file_system(path)
    return ds.dataset(inside, filesystem=system, format="parquet", exclude_invalid_files=False)


def _expression(f: D.Filter, names: set[str]) -> pc.Expression | None:
    """A filter as an Arrow expression over the manifest, or None."""
    if isinstance(f, D.Not):
        inner = _expression(f.child, names)
        return None if inner is None else ~inner
    if len(f.attribute) != 1 or f.attribute[0] not in names:
        return None
    x = pc.field(f.attribute[0])
    match f:
        case D.EqualTo():
            return x == pa.scalar(f.value)
        case D.GreaterThan():
            return x > pa.scalar(f.value)
        case D.GreaterThanOrEqual():
            return x >= pa.scalar(f.value)
        case D.LessThan():
            return x < pa.scalar(f.value)
        case D.LessThanOrEqual():
            return x <= pa.scalar(f.value)
        case D.In() if None not in f.value:
            # unlike Arrow's membership test, SQL's is unknown for null, also when negated
            return reduce(lambda a, b: a | b, [x == pa.scalar(v) for v in f.value])
        case D.IsNull():
            return x.is_null()
        case D.IsNotNull():
            return x.is_valid()
        case D.StringStartsWith():
            return pc.starts_with(x, f.value)
        case D.StringEndsWith():
            return pc.ends_with(x, f.value)
        case D.StringContains():
            return pc.match_substring(x, f.value)
    return None


@dataclass
class Files(D.InputPartition):
    """Rows ``start`` to ``stop``, of those that pass, in a row group of a manifest file."""

    manifest: int
    group: int
    start: int
    stop: int


class GatedReader(D.DataSourceReader):
    def __init__(self, manifest: str, partition_mb: float, with_content: bool):
        self.manifest, self.limit, self.with_content = manifest, int(partition_mb * (1 << 20)), with_content
        self.taken: list[D.Filter] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        names = set(_manifest(self.manifest).schema.names)
        for f in filters:
            if _expression(f, names) is None:
                yield f
            else:
                self.taken.append(f)

    def _filter(self, names: set[str]) -> pc.Expression | None:
        found = [_expression(f, names) for f in self.taken]
        return reduce(and_, found) if found else None

    def partitions(self) -> list[Files]:
        table = _manifest(self.manifest)
        keep, out = self._filter(set(table.schema.names)), []
        for k, fragment in enumerate(table.get_fragments()):
            for g, group in enumerate(fragment.split_by_row_group()):
                start = total = n = 0
                for batch in group.to_batches(columns=["size_bytes"], schema=table.schema, filter=keep):
                    for size in batch.column(0).to_pylist():
                        if n > start and total + (size or 0) > self.limit:
                            out.append(Files(k, g, start, n))
                            start, total = n, 0
                        total += size or 0
                        n += 1
                if n > start:
                    out.append(Files(k, g, start, n))
        return out

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing passed
            return
        table = _manifest(self.manifest)
        fragment = next(f for k, f in enumerate(table.get_fragments()) if k == partition.manifest)
        group = fragment.split_by_row_group()[partition.group]
        rows = group.to_table(schema=table.schema, filter=self._filter(set(table.schema.names)))
        rows = rows.slice(partition.start, partition.stop - partition.start).combine_chunks()
        paths, systems = rows.column("path").to_pylist(), {}
        done, held, size = 0, [], 0
        for n, path in enumerate(paths, 1):
            held.append(self._content(path, systems) if self.with_content else None)
            size += len(held[-1] or b"")
            if size > BATCH_MB << 20 or n == len(paths):
                part = rows.slice(done, n - done).append_column("content", pa.array(held, pa.binary()))
                yield from part.to_batches()
                done, held, size = n, [], 0

    def _content(self, path: str | None, systems: dict) -> bytes | None:
        if path is None:
            return None
        scheme = path.split("://")[0] if "://" in path else ""
        if scheme not in systems:
            systems[scheme] = _file_system(path)[0]
        inside = path.split("://", 1)[1] if scheme else path.removeprefix("file:")
        try:
            with systems[scheme].open_input_stream(inside) as f:
                return f.read()
        except FileNotFoundError:
            return None


class GatedFiles(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        found = from_arrow_schema(_manifest(self.options["manifest"]).schema)
        return found.add("content", BinaryType())

    def reader(self, schema: StructType) -> GatedReader:
        return GatedReader(self.options["manifest"], float(self.options.get("partition_mb", PARTITION_MB)), self.options.get("with_content", "true") == "true")


def read_gated(spark: SparkSession, manifest: str, partition_mb: float = PARTITION_MB, with_content: bool = True) -> DataFrame:
    """The manifest's rows with the bytes of their files; filter it before anything else."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GatedFiles)
    return spark.read.format(NAME).option("manifest", manifest).option("partition_mb", partition_mb).option("with_content", str(with_content).lower()).load()
