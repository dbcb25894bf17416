"""Stage traces as arrays of structs (TRC1-TRC4, SNK3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HYBRID, STRING = "hybrid_engine", "string_engine"


def _stage(n: int, name: str, ok: Column, details: Column) -> Column:
    """A stage with its details as JSON text."""
    return F.struct(
        F.lit(n).alias("stage"),
        F.lit(name).alias("name"),
        F.when(ok, F.lit("completed")).otherwise(F.lit("failed")).alias("status"),
        details.alias("details"),
    )


def _json(*members: Column | str) -> Column:
    return F.to_json(F.struct(*members))


def _one_object(*parts: Column) -> Column:
    """The members of several JSON objects as one object."""
    members = F.filter(F.array(*[F.substring(p, F.lit(2), F.length(p) - 2) for p in parts]), lambda m: m != "")
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


def _trace(engine: str, stages: list[Column]) -> Column:
    return F.struct(F.lit(engine).alias("engine"), F.array_compact(F.array(*stages)).alias("stages"))


def _empty_file(n: Column) -> Column:
    details = F.to_json(F.struct(F.lit("Empty file provided for extraction").alias("error")))
    return F.when(n == 0, _stage(1, "file_check", F.lit(False), details))


def hybrid_trace(df: DataFrame, pipeline: list[str], min_confidence: float, mode: str = "string") -> DataFrame:
    """Cascade stage and analysis stage of each document (TRC1).

    Expects the cascade columns (stage, confidence, text, attempts, error) and the analysis columns
    (document_type, data, analysis_error); ``size_bytes`` 0 gives the file check only.
    """
    size = F.col("size_bytes") if "size_bytes" in df.columns else F.lit(1)
    picked = F.col("stage").isNotNull()
    # the selected stage is printed even when there is none; other members that are null are left out
    details = _one_object(
        F.to_json(F.struct(F.array(*[F.lit(p) for p in pipeline]).alias("pipeline"), F.lit(min_confidence).alias("min_confidence_threshold"))),
        F.to_json(F.struct(F.col("stage").alias("selected_stage")), {"ignoreNullFields": "false"}),
        F.to_json(F.struct(F.col("confidence").alias("selected_confidence"), F.col("text").alias("extracted_text"), F.col("attempts"))),
    )
    cascade = _stage(1, "extraction_pipeline", picked, details)
    analysis = _analysis("text_analysis", F.lit(mode))
    stages = [_empty_file(size), F.when(size != 0, cascade), F.when((size != 0) & picked, analysis)]
    return df.withColumn("trace", _trace(HYBRID, stages))


def _analysis(name: str, mode: Column | None = None) -> Column:
    ok = F.col("analysis_error").isNull()
    return _stage(
        2, name, ok,
        _json(
            *([mode.alias("analysis_mode")] if mode is not None else []),
            F.when(ok, F.col("document_type")).alias("document_slug"),
            F.when(ok, F.json_object_keys("data")).alias("extracted_fields"),
            F.when(ok, F.col("data")).alias("final_output"),
            F.col("analysis_error").alias("error"),
        ),
    )


def string_trace(df: DataFrame) -> DataFrame:
    """Two-stage engine: text extraction or failed fallback, then analysis (TRC2)."""
    size = F.col("size_bytes") if "size_bytes" in df.columns else F.lit(1)
    fallback_failed = F.col("stage").isNull()
    fallback = _stage(
        1, "ocr_fallback", F.lit(False), _json(F.col("error").alias("error"), F.col("fallback_reason"))
    )
    found = _stage(
        1, "text_extraction", F.col("text") != "",
        _json(
            F.col("stage").alias("stage_used"), "confidence", F.length("text").alias("text_length"),
            F.col("text").alias("extracted_text"),
        ),
    )
    stages = [
        _empty_file(size),
        F.when((size != 0) & fallback_failed, fallback),
        F.when((size != 0) & ~fallback_failed, found),
        F.when((size != 0) & F.col("error").isNull(), _analysis("string_analysis")),
    ]
    return df.withColumn("trace", _trace(STRING, stages))


def without_binary(c: Column, t: T.DataType) -> Column:
    """Binary values of any depth replaced by their size (TRC4)."""
    if isinstance(t, T.BinaryType):
        return F.when(c.isNotNull(), F.format_string("<%d bytes binary data>", F.length(c)))
    if isinstance(t, T.StructType):
        fields = [without_binary(c[f.name], f.dataType).alias(f.name) for f in t.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: without_binary(x, t.elementType))
    if isinstance(t, T.MapType):
        return F.transform_values(c, lambda _, v: without_binary(v, t.valueType))
    return c


def printable(df: DataFrame, *names: str) -> DataFrame:
    """Columns made JSON-safe before they are written."""
    return df.withColumns({n: without_binary(F.col(n), df.schema[n].dataType) for n in names})


def explode_stages(df: DataFrame, *keys: str) -> DataFrame:
    """One row per trace stage, for analysis."""
    return df.select(*keys, F.col("trace.engine").alias("engine"), F.explode("trace.stages").alias("s")).select(
        *keys, "engine", "s.stage", "s.name", "s.status", "s.details"
    )


def kept_traces(results: DataFrame, keep_trace: bool = False) -> DataFrame:
    """Failures that carry a trace always, successes only on request (SNK3)."""
    failed = ~F.col("success") & F.col("trace").isNotNull()
    return results.filter(failed | F.lit(keep_trace))
