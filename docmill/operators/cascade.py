"""Choice of one text per document from the attempts of several sources (AGG9-AGG11, JN8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import is_blank
from docmill.operators.sizing import dealt, key_tasks

# Stage names, acceptance threshold and failure texts.
DIGITAL, OCR, VISION = "digital_pdf", "ocr", "visual_llm"
PIPELINE = (DIGITAL, OCR, VISION)
MIN_CONFIDENCE = 0.5
NO_TEXT = "No readable text could be extracted by any extractor in the pipeline"
NO_TEXT_TWO_STAGE = "No readable text could be extracted from the document"


def is_accepted(min_confidence: float = MIN_CONFIDENCE) -> Column:
    """Non-blank text with enough confidence (FLT8)."""
    return F.coalesce(
        F.col("error").isNull() & ~is_blank(F.col("text")) & (F.col("confidence") >= min_confidence), F.lit(False)
    )


def is_skipped() -> Column:
    """Digital text is read from PDFs only; for other files that stage is no attempt."""
    return (F.col("stage") == DIGITAL) & ~F.coalesce(F.col("is_pdf"), F.lit(False))


def choose_text(
    attempts: DataFrame, stages: Sequence[str] = PIPELINE, min_confidence: float = MIN_CONFIDENCE, tasks: int | None = None
) -> DataFrame:
    """First accepted attempt in stage order, else the best non-blank one, earliest on ties (AGG9).

    Two phases.  Attempts without their texts meet by ``doc_id`` and are ordered; then the one text that won is
    fetched, so each text is shuffled once, only if it may win, and never sorted or held in an aggregate.  The attempts
    list holds the stages tried up to the accepted one (AGG11).  Of repeated attempts of a stage the accepted one,
    then the one with the highest confidence, stands for it.

    ``tasks`` is the number of tasks the attempts are dealt over; without it they are counted, so that a task's share does
    not grow with the table.
    """
    tasks = tasks or key_tasks(attempts)
    order = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("stage")).cast("int")
    # a stage that is not in the list, or digital text of a non-PDF, keeps its document but is no attempt
    place = F.when((order > 0) & ~is_skipped(), order)
    usable = F.col("error").isNull() & ~is_blank(F.col("text"))
    tried = attempts.select(
        "doc_id", place.alias("__ord"), is_accepted(min_confidence).alias("__ok"), F.coalesce(usable, F.lit(False)).alias("__usable"),
        "stage", "confidence", "error", F.length("text").alias("__length"), F.xxhash64("text").alias("__text"),
    )
    failed = F.col("error").isNotNull()
    attempt = F.struct(
        F.col("__ord").alias("ord"), (~F.col("__ok")).alias("refused"), (-F.col("confidence")).alias("falling"), F.col("__text").alias("text"),
        F.col("__usable").alias("usable"), "stage", F.when(~failed, F.col("confidence")).alias("confidence"),
        F.when(~failed, F.col("__length")).alias("text_length"), F.when(~failed, F.col("__ok")).alias("accepted"), "error",
    )
    listed = dealt(tried, tasks, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.when(F.col("__ord").isNotNull(), attempt))).alias("__all"))
    one = F.filter("__all", lambda x, i: (i == 0) | (x["ord"] != F.get(F.col("__all"), i - 1)["ord"]))
    listed = listed.withColumn("__all", one)
    first = F.get(F.filter("__all", lambda x: ~x["refused"]), 0)
    usable_ones = F.filter("__all", lambda x: x["usable"])
    by_confidence = F.transform(usable_ones, lambda x: F.struct(x["falling"].alias("falling"), x["ord"].alias("ord"), x.alias("it")))
    best = F.get(F.array_sort(by_confidence), 0)["it"]
    picked = listed.withColumns({"__first": first, "__win": F.coalesce(first, best)})
    upto = F.filter("__all", lambda x: F.coalesce(x["ord"] <= F.col("__first")["ord"], F.lit(True)))
    shown = F.transform(upto, lambda x: F.struct(*[x[c].alias(c) for c in ("stage", "confidence", "text_length", "accepted", "error")]))
    picked = picked.select(
        "doc_id", F.col("__win.ord").alias("__o"), F.col("__win.text").alias("__t"), F.col("__win.stage").alias("stage"),
        F.col("__win.confidence").alias("confidence"), F.col("__first").isNotNull().alias("accepted"), shown.alias("attempts"),
    )
    return _with_text(picked, attempts.where(usable).select("doc_id", place.alias("__ord"), "text"), tasks).select(
        "doc_id", "stage", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "text", "accepted", "attempts",
        F.when(F.col("stage").isNull(), F.lit(NO_TEXT)).alias("error"),
    )


def _with_text(picked: DataFrame, texts: DataFrame, tasks: int) -> DataFrame:
    """The text of each document's winner ``__o`` with the hash ``__t``; empty where there is none.

    The narrow side is hashed, so texts are not sorted; a winner that is repeated word for word counts once.
    """
    texts = texts.select(F.col("doc_id").alias("__d"), F.col("__ord").alias("__p"), F.xxhash64("text").alias("__h"), "text")
    same = (F.col("doc_id") == F.col("__d")) & (F.col("__o") == F.col("__p")) & (F.col("__t") == F.col("__h"))
    winners = dealt(picked, tasks, "doc_id", "__o", "__t").hint("shuffle_hash")
    found = dealt(texts, tasks, "__d", "__p", "__h").join(winners, same, "right").drop("__d", "__p", "__h")
    return found.withColumn("text", F.coalesce("text", F.lit(""))).distinct().drop("__o", "__t")


def choose_two_stage(attempts: DataFrame, min_confidence: float = MIN_CONFIDENCE, tasks: int | None = None) -> DataFrame:
    """Digital text of a PDF when good enough, else whatever OCR returned, even if worse (AGG10).

    The choice is made without the texts and in as many ``tasks``, as in ``choose_text``; of repeated attempts of a source the accepted one,
    then the one with the highest confidence, stands for it.
    """
    tasks = tasks or key_tasks(attempts)
    source = F.when((F.col("stage") == DIGITAL) & F.coalesce(F.col("is_pdf"), F.lit(False)), 1).when(F.col("stage") == OCR, 2)
    part = F.struct(
        source.alias("ord"), (~is_accepted(min_confidence)).alias("refused"), (-F.col("confidence")).alias("falling"), "confidence", "error",
        F.xxhash64("text").alias("text"), is_blank(F.col("text")).alias("blank"),
    )
    tried = attempts.select("doc_id", F.coalesce("is_pdf", F.lit(False)).alias("is_pdf"), F.when(source.isNotNull(), part).alias("part"))
    listed = dealt(tried, tasks, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_set("part")).alias("parts"), F.bool_or("is_pdf").alias("is_pdf"))
    of = lambda k: F.get(F.filter("parts", lambda x: x["ord"] == k), 0)
    sides = listed.withColumns({"d": of(1), "o": of(2)})
    use_digital = F.coalesce(~F.col("d.refused"), F.lit(False))
    failed = ~use_digital & (F.col("o.error").isNotNull() | F.col("o").isNull())
    seen = F.coalesce(F.when(F.col("d.error").isNull(), F.col("d.confidence")), F.lit(0.0))
    too_low = F.format_string(
        "confidence (%s) < threshold (%s)", seen.cast("string"), F.lit(min_confidence).cast("string")
    )
    it = F.when(use_digital, F.col("d")).when(~failed, F.col("o"))
    picked = sides.select(
        "doc_id",
        it["ord"].alias("__o"),
        it["text"].alias("__t"),
        F.when(use_digital, F.lit(DIGITAL)).when(~failed, F.lit(OCR)).alias("stage"),
        it["confidence"].alias("confidence"),
        F.when(
            ~use_digital,
            F.when(F.col("is_pdf"), too_low).otherwise(F.lit("file is not digital pdf")),
        ).alias("fallback_reason"),
        F.when(failed, F.concat(F.lit("OCR extraction failed: "), F.coalesce("o.error", F.lit("no result"))))
        .when(F.coalesce(it["blank"], F.lit(True)), F.lit(NO_TEXT_TWO_STAGE))
        .alias("error"),
    )
    texts = attempts.select("doc_id", source.alias("__ord"), "text").where("__ord is not null and text is not null")
    return _with_text(picked, texts, tasks).select("doc_id", "stage", "confidence", "text", "fallback_reason", "error")


def unresolved(documents: DataFrame, attempts: DataFrame, min_confidence: float = MIN_CONFIDENCE, tasks: int | None = None) -> DataFrame:
    """Documents no earlier stage has settled: the only input of the next, costlier stage (JN8).

    ``tasks`` is as in ``choose_text``.
    """
    tasks = tasks or key_tasks(documents)
    settled = attempts.filter(is_accepted(min_confidence) & ~is_skipped()).select("doc_id")
    return dealt(documents, tasks, "doc_id").join(dealt(settled, tasks, "doc_id"), "doc_id", "left_anti")
