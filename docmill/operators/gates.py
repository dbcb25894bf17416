"""Intake gates: file kinds, type, size and batch limits, status codes (FLT1-FLT9, JN1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default limits and the empty-file text.
MAX_FILE_MB = 15
MAX_BATCH_FILES = 5
EMPTY_FILE = "Empty file provided for extraction"
# Image media types and file endings.
IMAGE_TYPES = ("image/jpeg", "image/png", "image/webp", "image/bmp", "image/tiff")
IMAGE_ENDINGS = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tiff")


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return F.coalesce(out, F.lit(False))


def is_pdf(content_type: Column, filename: Column) -> Column:
    """Media type holds ``pdf`` or the name ends in ``.pdf``, any case (FLT5)."""
    return _any(
        [
            F.coalesce(F.contains(F.lower(content_type), F.lit("pdf")), F.lit(False)),
            F.coalesce(F.endswith(F.lower(filename), F.lit(".pdf")), F.lit(False)),
        ]
    )


def is_image(content_type: Column, filename: Column) -> Column:
    """One of five media types or six endings, any case (FLT6)."""
    media = [F.contains(F.lower(content_type), F.lit(t)) for t in IMAGE_TYPES]
    names = [F.endswith(F.lower(filename), F.lit(e)) for e in IMAGE_ENDINGS]
    return _any([F.coalesce(t, F.lit(False)) for t in media + names])


def gate_files(
    manifest: DataFrame,
    types: DataFrame,
    max_file_mb: int = MAX_FILE_MB,
    valid_pricing: bool = True,
) -> DataFrame:
    """Status and detail of each file before extraction (FLT1, FLT2, FLT4, FLT9).

    Order: unknown type 404, too large 413, invalid price list 500, unusable engine 400, empty file
    422; null means the file goes on.  ``types`` is the registry table, one row per document type.
    An optional boolean column ``valid_engine`` carries the engine check.
    """
    known = F.broadcast(types.select("document_type", F.lit(True).alias("__known")))
    engine_ok = F.col("valid_engine") if "valid_engine" in manifest.columns else F.lit(True)
    size = F.coalesce(F.col("size_bytes"), F.lit(0))
    cases = [
        (
            F.col("__known").isNull(),
            404,
            F.concat(F.lit("Unknown document_type: '"), F.coalesce("document_type", F.lit("")), F.lit("'")),
        ),
        (size > max_file_mb * 1024 * 1024, 413, F.lit(f"File exceeds maximum allowed size of {max_file_mb}MB")),
        (F.lit(not valid_pricing), 500, F.lit("Invalid pricing configuration")),
        (~engine_ok, 400, F.lit("Invalid engine override")),
        (size == 0, 422, F.lit(EMPTY_FILE)),
    ]
    status, detail = F.lit(None).cast("int"), F.lit(None).cast("string")
    for test, code, text in reversed(cases):
        status = F.when(test, F.lit(code)).otherwise(status)
        detail = F.when(test, text).otherwise(detail)
    return (
        manifest.join(known, "document_type", "left")
        .withColumns({"status_code": status, "detail": detail})
        .drop("__known")
    )


def batch_detail(max_files: int = MAX_BATCH_FILES) -> Column:
    return F.lit(f"Batch exceeds {max_files} files")


def oversized_batches(manifest: DataFrame, max_files: int = MAX_BATCH_FILES) -> DataFrame:
    """Batches over the file limit with their status (FLT3): counted with partial sums, no window."""
    return (
        manifest.groupBy("batch_id")
        .agg(F.count("*").alias("total_files"))
        .filter(F.col("total_files") > max_files)
        .select(
            "batch_id",
            "total_files",
            F.lit(413).alias("status_code"),
            batch_detail(max_files).alias("detail"),
        )
    )


def gate_batches(gated: DataFrame, max_files: int = MAX_BATCH_FILES) -> DataFrame:
    """Gated files, with the files of a batch over the limit stopped by it (FLT3): 413 comes before a file's own status."""
    over = oversized_batches(gated, max_files).select(
        "batch_id", F.col("status_code").alias("__status"), F.col("detail").alias("__detail")
    )
    joined = gated.join(over, "batch_id", "left")
    return joined.withColumns(
        {
            "status_code": F.coalesce("__status", "status_code"),
            "detail": F.when(F.col("__status").isNotNull(), F.col("__detail")).otherwise(F.col("detail")),
        }
    ).drop("__status", "__detail")
