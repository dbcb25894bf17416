"""End-to-end jobs: a manifest with text attempts and usage events to result rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.cascade import DIGITAL, MIN_CONFIDENCE, PIPELINE, choose_text, unresolved
from docmill.operators.cost import price_events, summarize_requests
from docmill.operators.dispatch import extract_mixed, extract_routed, payloads_mixed
from docmill.operators.gates import MAX_BATCH_FILES, gate_batches, gate_files
from docmill.operators.results import with_status
from docmill.operators.sizing import key_tasks
from docmill.plans.registry import document_types
from docmill.session import shared_root
from docmill.sources.pricing import rate_violations, unit_violations

Extractor = Callable[[DataFrame], DataFrame]
Analyzer = Callable[..., DataFrame]

ATTEMPT = "doc_id bigint, is_pdf boolean, stage string, text string, confidence double, error string"

# Analysis modes by name (EXT3): chosen texts to the same rows with ``data`` and ``error``.
ANALYZERS: dict[str, Analyzer] = {
    "string": extract_mixed,
    "text_llm": lambda df, as_of=None: payloads_mixed(df),
}
# Text sources by stage name (EXT2): documents to attempt rows.
EXTRACTORS: dict[str, Extractor] = {}


def register_analyzer(mode: str, analyzer: Analyzer) -> None:
    ANALYZERS[mode] = analyzer


def register_extractor(stage: str, extractor: Extractor) -> None:
    EXTRACTORS[stage] = extractor


def batch_extractor(fn, schema: str = ATTEMPT, prepare: Callable[[Column], Column] | None = None) -> Extractor:
    """A text source from a function over batches of (doc_id, is_pdf, content), for ``mapInPandas``.

    ``fn`` gets an iterator of pandas batches and may set up its model before the first one.
    ``prepare`` is an optional Column function on the content, such as a ``pandas_udf`` (EXT4).
    """

    def run(documents: DataFrame) -> DataFrame:
        content = prepare(F.col("content")) if prepare else F.col("content")
        return documents.select("doc_id", "is_pdf", content.alias("content")).mapInPandas(fn, schema)

    return run


def stage_tables(spark: SparkSession, run: str, fallback_root: str | None = None) -> Callable[[DataFrame, str], DataFrame]:
    """A ``save`` for ``run_stages``: one parquet table per stage of a run in the shared folder."""
    base = f"{shared_root(spark, fallback_root)}/{run}"

    def save(attempts: DataFrame, stage: str) -> DataFrame:
        attempts.write.mode("overwrite").parquet(f"{base}/{stage}")
        return spark.read.schema(attempts.schema).parquet(f"{base}/{stage}")

    return save


def typed_tables(spark: SparkSession, run: str, fallback_root: str | None = None) -> Callable[[DataFrame, str], DataFrame]:
    """A ``save`` for ``extract_corpus``: a parquet table by document type in the shared folder."""
    base = f"{shared_root(spark, fallback_root)}/{run}"

    def save(rows: DataFrame, stage: str) -> DataFrame:
        rows.write.mode("overwrite").partitionBy("document_type").parquet(f"{base}/{stage}")
        back = spark.read.schema(rows.schema).parquet(f"{base}/{stage}")
        return back.select(*rows.columns)

    return save


def run_stages(
    documents: DataFrame, stages: Sequence[str], save: Callable[[DataFrame, str], DataFrame],
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """Run registered text sources in order, each only on documents that none before has settled.

    ``documents`` carries doc_id and is_pdf; digital text is read from PDFs only.
    ``save`` writes the attempts of a stage to a table and reads them back, so a costly source runs
    once and a lost executor does not make it run again.
    """
    done: DataFrame | None = None
    tasks = key_tasks(documents)
    for stage in stages:
        todo = documents if done is None else unresolved(documents, done, min_confidence, tasks)
        todo = todo.filter("is_pdf") if stage == DIGITAL else todo
        attempts = save(EXTRACTORS[stage](todo), stage)
        done = attempts if done is None else done.unionByName(attempts)
    return done


def extract_corpus(
    manifest: DataFrame,
    attempts: DataFrame,
    events: DataFrame,
    model_rates: DataFrame,
    unit_rates: DataFrame,
    price_date: str | None = None,
    pipeline: Sequence[str] = PIPELINE,
    min_confidence: float = MIN_CONFIDENCE,
    mode: str = "string",
    as_of: Column | None = None,
    max_files: int = MAX_BATCH_FILES,
    save: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """Gates, choice of text, extraction, cost: one result row per manifest row.

    ``manifest`` carries doc_id and request_id, and batch_id where files come in batches.  Rows stopped
    by a gate, by the batch limit or by an invalid price list skip the costly part: their attempts are left out before
    texts are chosen.  Costs meet the narrow manifest, and texts end with extraction.

    With ``save`` (see ``typed_tables``) the chosen texts are kept as a table by document type, and only the rules of the
    types that are there are planned, each on its own part; without it all rules run in one pass over the rows.
    """
    valid = rate_violations(model_rates).isEmpty() and unit_violations(unit_rates).isEmpty()
    gated = gate_files(manifest, document_types(manifest.sparkSession), valid_pricing=valid)
    if "batch_id" in manifest.columns:
        gated = gate_batches(gated, max_files)
    cost = summarize_requests(price_events(events, model_rates, unit_rates), manifest.select("request_id").distinct(), price_date)
    gated = gated.join(cost, "request_id", "left")
    passed = gated.filter(F.col("status_code").isNull())
    tasks = key_tasks(attempts)  # before the join, which is not to run for a count
    chosen = choose_text(attempts.join(passed.select("doc_id"), "doc_id", "left_semi"), pipeline, min_confidence, tasks)
    passed = passed.join(chosen.withColumnRenamed("error", "text_error"), "doc_id", "left")
    if save and mode == "string":
        passed = save(passed, "chosen")
        present = {r[0] for r in passed.select("document_type").distinct().collect()}  # the gates let registered types through only
        analysed = extract_routed(passed, as_of=as_of, present=present)
    else:
        analysed = ANALYZERS[mode](passed, as_of=as_of)
    analysed = analysed.withColumnRenamed("error", "analysis_error").drop("text")
    done = analysed.withColumn(
        "error", F.coalesce("text_error", "analysis_error", F.when(F.col("attempts").isNull(), F.lit("No attempts")))
    )
    stopped = gated.filter(F.col("status_code").isNotNull()).withColumn("error", F.col("detail"))
    return with_status(done.unionByName(stopped, allowMissingColumns=True))
