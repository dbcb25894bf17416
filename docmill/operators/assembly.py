"""Pages and recognised lines to one text and one confidence per document (AGG1-AGG8).

Scores and sizes are plain sums, so they are combined before the shuffle and one huge document does
no harm.  Texts are joined in two levels: runs of neighbouring pages first, then the runs, so that
no task holds the single rows of a whole document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import confidence as conf
from docmill.functions.rounding import round3
from docmill.functions.text import blank_to_null, is_blank, strip

RUN = 256
# Page heading of each text source, before and after the number.
HEADINGS = {"digital": ("--- Page ", " ---\n"), "ocr": ("--- Page ", " (OCR) ---\n"), "vision": ("--- Page ", " (Vision) ---\n")}
SCORE = "decimal(28,20)"


def _joined(order: str, text: str, separator: str) -> Column:
    """Non-null texts of a group in order."""
    pieces = F.array_sort(
        F.collect_list(F.when(F.col(text).isNotNull(), F.struct(F.col(order), F.col(text))))
    )
    return F.array_join(F.transform(pieces, lambda p: p[text]), separator)


def text_runs(
    df: DataFrame, keys: list[str], order: str, text: str, separator: str, sums: dict[str, Column] | None = None
) -> DataFrame:
    """Neighbouring pieces joined to runs: one row per key and run of ``RUN`` order numbers.

    This is the form to keep for documents too large for one text cell.
    """
    return (
        df.withColumn("run", F.floor(F.col(order) / RUN))
        .groupBy(*keys, "run")
        .agg(
            _joined(order, text, separator).alias("__part"),
            F.count(text).alias("__filled"),
            *[F.sum(c).alias(n) for n, c in (sums or {}).items()],
        )
        .withColumn(text, F.when(F.col("__filled") > 0, F.col("__part")))
        .drop("__part", "__filled")
    )


def join_in_order(
    df: DataFrame, keys: list[str], order: str, text: str, separator: str, sums: dict[str, Column] | None = None
) -> DataFrame:
    """One row per key: non-null ``text`` joined in ``order``, and the given sums."""
    runs = text_runs(df, keys, order, text, separator, sums)
    return runs.groupBy(*keys).agg(
        _joined("run", text, separator).alias(text), *[F.sum(n).alias(n) for n in (sums or {})]
    )


def with_heading(text: Column, page: Column, kind: str) -> Column:
    """``--- Page N ---`` and the stripped page text; null for a blank page."""
    before, after = HEADINGS[kind]
    body = blank_to_null(strip(text))
    return F.when(body.isNotNull(), F.concat(F.lit(before), page.cast("string"), F.lit(after), body))


def route_pages(pages: DataFrame, min_chars: int = 30) -> DataFrame:
    """Page details and the route of each page (SRC3, SRC4)."""
    trimmed = F.coalesce(strip(F.col("text")), F.lit(""))
    chars = F.length(trimmed)
    return pages.withColumns(
        {
            "character_count": chars,
            "has_text": chars > 0,
            "route": F.when(chars >= min_chars, F.lit("digital")).otherwise(F.lit("scanned")),
        }
    )


def _size_sums(text: str) -> dict[str, Column]:
    return {
        "characters": F.coalesce(F.length(text), F.lit(0)),
        "alnum": F.coalesce(conf.alnum_count(F.col(text)), F.lit(0)),
        "filled": F.when(F.col(text).isNotNull(), 1).otherwise(0),
        "page_count": F.lit(1),
    }


def _digital_columns() -> dict[str, Column]:
    # the pieces are joined by a blank line: two characters between neighbours
    total = F.col("characters") + F.greatest(F.col("filled") - 1, F.lit(0)) * 2
    return {
        "character_count": total,
        "confidence": conf.digital_confidence(total, F.col("alnum"), F.col("page_count")),
    }


def assemble_digital(pages: DataFrame) -> DataFrame:
    """Embedded text of a document with its confidence (AGG1, AGG3)."""
    headed = pages.withColumn("text", with_heading(F.col("text"), F.col("page"), "digital"))
    joined = join_in_order(headed, ["doc_id"], "page", "text", "\n\n", _size_sums("text"))
    return joined.withColumns(_digital_columns()).select(
        "doc_id", "text", "page_count", "character_count", "confidence"
    )


def score_digital(pages: DataFrame) -> DataFrame:
    """AGG3 alone: sums only, no text is moved."""
    headed = pages.select("doc_id", with_heading(F.col("text"), F.col("page"), "digital").alias("text"))
    sums = headed.select("doc_id", *[c.alias(n) for n, c in _size_sums("text").items()])
    totals = sums.groupBy("doc_id").agg(*[F.sum(n).alias(n) for n in _size_sums("text")])
    return totals.withColumns(_digital_columns()).select("doc_id", "page_count", "character_count", "confidence")


def _finish(df: DataFrame, default: float) -> DataFrame:
    text = strip(F.col("text"))
    score = conf.mean_or_default(F.col("score_sum"), F.col("score_count"), text != "", default)
    return df.withColumns({"text": text, "confidence": score})


def score_ocr_lines(ocr_lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Recognised lines to page text and mean score (AGG4).

    ``pages`` (doc_id, page) keeps pages without any recognised line, as empty text with score 0.
    """
    kept = ocr_lines.filter(F.length("text") > 0).select(
        "doc_id", "page", "line_no", strip(F.col("text")).alias("text"), F.col("score").try_cast(SCORE).alias("score")
    )
    joined = join_in_order(
        kept, ["doc_id", "page"], "line_no", "text", "\n",
        {"score_sum": F.col("score"), "score_count": F.when(F.col("score").isNotNull(), 1).otherwise(0), "line_count": F.lit(1)},
    )
    scored = _finish(joined, conf.NO_SCORE_LINES).select("doc_id", "page", "text", "confidence", "line_count")
    if pages is None:
        return scored
    return pages.join(scored, ["doc_id", "page"], "left").fillna(
        {"text": "", "confidence": 0.0, "line_count": 0}
    )


def score_ocr_words(ocr_words: DataFrame) -> DataFrame:
    """Recognised words (parallel arrays) to page text and mean score (SRC6, AGG5): narrow."""
    pairs = F.filter(
        F.arrays_zip(F.col("text").alias("t"), F.col("conf").alias("c")), lambda p: ~is_blank(p["t"])
    )
    scores = F.filter(
        F.transform(F.col("__pairs"), lambda p: p["c"].try_cast(SCORE)), lambda s: s >= F.lit(0).cast(SCORE)
    )
    return (
        ocr_words.withColumn("__pairs", pairs)
        .withColumn("__scores", scores)
        .select(
            "doc_id",
            "page",
            F.array_join(F.transform("__pairs", lambda p: strip(p["t"])), " ").alias("text"),
            F.size("__pairs").alias("word_count"),
            F.aggregate(
                "__scores", F.lit(0).cast("decimal(38,20)"), lambda acc, s: (acc + s / 100).cast("decimal(38,20)")
            ).alias("score_sum"),
            F.size("__scores").alias("score_count"),
        )
        .transform(_finish, conf.NO_SCORE_WORDS)
        .select("doc_id", "page", "text", "confidence", "word_count")
    )


def score_ocr_pages(ocr_pages: DataFrame) -> DataFrame:
    """Page confidences of a cloud response to one text score (AGG6): positive scores only."""
    score = F.when(F.col("confidence") > 0, F.col("confidence").cast(SCORE))
    kept = ocr_pages.select("doc_id", "page", blank_to_null(strip(F.col("text"))).alias("text"), score.alias("score"))
    joined = join_in_order(
        kept, ["doc_id"], "page", "text", "\n",
        {"score_sum": F.col("score"), "score_count": F.when(F.col("score").isNotNull(), 1).otherwise(0)},
    )
    return _finish(joined, conf.NO_SCORE_CLOUD).select("doc_id", "text", "confidence")


def assemble_ocr(ocr_pages: DataFrame) -> DataFrame:
    """Recognised pages of a document: headed text and mean of all page confidences (AGG2, AGG7)."""
    headed = ocr_pages.withColumn("text", with_heading(F.col("text"), F.col("page"), "ocr"))
    joined = join_in_order(
        headed, ["doc_id"], "page", "text", "\n\n",
        {"score_sum": F.coalesce(F.col("confidence"), F.lit(0.0)).cast(SCORE), "page_count": F.lit(1)},
    )
    mean = F.col("score_sum").cast("double") / F.col("page_count")
    return joined.select("doc_id", "text", "page_count", round3(mean).alias("confidence"))


def assemble_vision(pages: DataFrame) -> DataFrame:
    """Transcribed pages of a document with the constant vision score (AGG2, AGG8)."""
    headed = pages.withColumn("text", with_heading(F.col("text"), F.col("page"), "vision"))
    joined = join_in_order(headed, ["doc_id"], "page", "text", "\n\n", {"page_count": F.lit(1)})
    return joined.withColumn("confidence", conf.vision_confidence(F.col("text")))
