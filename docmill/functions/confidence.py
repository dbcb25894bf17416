"""Confidence rules of the text sources (AGG3-AGG8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions.rounding import round3, unit_interval

# Thresholds and weights of the scores.
MIN_DIGITAL_CHARS = 25
PAGE_CHARS = 200.0
BASE, SPAN = 0.85, 0.15
MIN_ALNUM_RATIO = 0.4
NO_SCORE_LINES, NO_SCORE_WORDS, NO_SCORE_CLOUD = 0.8, 0.75, 0.95
VISION = 0.90


def alnum_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def digital_confidence(chars: Column, alnum: Column, pages: Column) -> Column:
    """Score of embedded text from its size, its pages and its share of letters and digits (AGG3)."""
    pages = F.greatest(pages, F.lit(1)).cast("double")
    n = chars.cast("double")
    full = F.lit(BASE) + F.least(F.lit(SPAN), n / (pages * F.lit(PAGE_CHARS)) * F.lit(SPAN))
    scaled = F.when(alnum / n < F.lit(MIN_ALNUM_RATIO), full * F.lit(0.5)).otherwise(full)
    return (
        F.when(chars == 0, F.lit(0.0))
        .when(chars < MIN_DIGITAL_CHARS, round3(n / F.lit(MIN_DIGITAL_CHARS * 2.0)))
        .otherwise(unit_interval(round3(scaled)))
    )


def mean_or_default(total: Column, count: Column, has_text: Column, default: float) -> Column:
    """Mean of the scores; without scores a default when there is text, else 0 (AGG4-AGG6)."""
    mean = total.cast("double") / count
    fallback = F.when(has_text, F.lit(default)).otherwise(F.lit(0.0))
    return unit_interval(round3(F.when(count > 0, mean).otherwise(fallback)))


def vision_confidence(text: Column) -> Column:
    return F.when(F.length(F.coalesce(text, F.lit(""))) > 0, F.lit(VISION)).otherwise(F.lit(0.0))
