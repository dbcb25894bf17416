"""Files and manifests (SRC1, SRC2), pages (SRC3, SRC5, SRC6) and logs (SRC9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Input schemas.
MANIFEST = (
    "batch_id string, ord int, file_id string, filename string, content_type string, size_bytes bigint, "
    "document_type string"
)
PAGES = "doc_id bigint, page int, text string"
OCR_LINES = "doc_id bigint, page int, line_no int, text string, score string"
OCR_WORDS = "doc_id bigint, page int, text array<string>, conf array<string>"
OCR_PAGES = "doc_id bigint, page int, text string, confidence double"
LOG_LINES = (
    "timestamp string, level string, service string, logger string, message string, request_id string, "
    "correlation_id string, trace_id string, span_id string, "
    "source struct<file:string,line:int,func:string,module:string>, "
    "extra struct<http:struct<method:string,path:string,query:string,status_code:int,duration_ms:double,"
    "client_ip:string,user_agent:string>>, "
    "exception struct<type:string,message:string,stacktrace:string>"
)


def read_files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Binary files with their name; sizes come from the listing, content is read only when used."""
    if stream:
        schema = "path string, modificationTime timestamp, length bigint, content binary"
        df = spark.readStream.format("binaryFile").schema(schema).load(path)
    else:
        df = spark.read.format("binaryFile").load(path)
    return df.withColumnsRenamed({"length": "size_bytes"}).withColumn(
        "filename", F.element_at(F.split("path", "/"), -1)
    )


def join_manifest(files: DataFrame, manifest: DataFrame, key: str | None = None) -> DataFrame:
    """Each manifest row with its file; a row without a file keeps null content (SRC1).

    Files are told apart by ``path`` or ``file_id``, whichever both tables have; base names repeat across
    folders.  For gates that need no content, join ``files.drop("content")`` and fetch the content by a
    second join of the rows that passed, so that rejected files are never read.
    """
    both = set(files.columns) & set(manifest.columns)
    key = key or next((k for k in ("path", "file_id") if k in both), None)
    if key is None:
        raise ValueError("files and manifest need a common path or file_id")
    own = [c for c in files.columns if c == key or c not in manifest.columns or c == "size_bytes"]
    return manifest.drop("size_bytes").join(files.select(*own), key, "left")


def zip_manifest(batches: DataFrame) -> DataFrame:
    """Positional zip of ``files`` and ``document_types`` (SRC2).

    Unequal lengths void the whole batch: one row with status 400 and no file.
    """
    fits = F.size("files") == F.size("document_types")
    pairs = F.when(fits, F.arrays_zip("files", "document_types"))
    return batches.select("batch_id", fits.alias("__fits"), F.posexplode_outer(pairs).alias("ord", "pair")).select(
        "batch_id",
        "ord",
        F.col("pair.files").alias("filename"),
        F.col("pair.document_types").alias("document_type"),
        F.when(~F.col("__fits"), F.lit(400)).alias("status_code"),
        F.when(~F.col("__fits"), F.lit("Each file needs one document_types value")).alias("detail"),
    )


def explode_words(ocr_words: DataFrame) -> DataFrame:
    """Parallel word and score arrays to rows (SRC6)."""
    return ocr_words.select(
        "doc_id", "page", F.posexplode(F.arrays_zip("text", "conf")).alias("word_no", "word")
    ).select("doc_id", "page", "word_no", F.col("word.text").alias("text"), F.col("word.conf").alias("conf"))


def read_logs(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON log lines with a declared schema, as a table or a stream (SRC9)."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(LOG_LINES).json(path)
