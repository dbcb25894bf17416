"""Field cleaning shared by the record normalisers (FN7-FN14, FN17)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions.dates import IsoDate, month_first_in_place, month_first_only
from docmill.functions.text import blank_to_null, drop, has, rx, strip

_SEP = r"\s*[:\.]?\s*"
_WIDE_SEP = r"\s*[:：.]?\s*"


def _unlabelled(c: Column, label: str, replacement: str, sep: str) -> Column:
    return strip(drop(strip(c), rf"^(?:{label}){sep}", replacement))


def clean_prefix(c: Column, label: str, replacement: str = "", sep: str = _SEP) -> Column:
    """Strip, remove a leading label, strip; blank is null (FN8)."""
    return blank_to_null(_unlabelled(c, label, replacement, sep))


def clean(c: Column, label: str | None = None, sep: str = _SEP) -> Column:
    """As FN8, and a lone dash is null too (FN7)."""
    value = _unlabelled(c, label, "", sep) if label else strip(c)
    return blank_to_null(F.regexp_replace(value, r"^[-–—]\z", ""))


def wide(c: Column, label: str) -> Column:
    """FN7 with a full-width colon allowed after the label."""
    return clean(c, label, _WIDE_SEP)


def clean_date(c: Column, label: str) -> IsoDate:
    """ISO date or null (FN6)."""
    return IsoDate(clean(c, label))


def wide_date(c: Column, label: str) -> IsoDate:
    """FN6 where a ``Month d, yyyy`` value is cut down to its date first."""
    return IsoDate(month_first_only(wide(c, label)))


def swapped_date(c: Column, label: str) -> IsoDate:
    """FN6 where ``Month d, yyyy`` is swapped in place first."""
    return IsoDate(month_first_in_place(clean(c, label)))


def number(c: Column, label: str, sep: str = _WIDE_SEP) -> Column:
    """``digits[.,digits]`` with an optional ``(...)`` suffix as a finite double (FN9)."""
    digits = rx(clean(c, label, sep), r"^(\d+(?:[.,]\d+)?)(?:\s*\([^)]*\))?\z")
    return F.nullif(F.replace(digits, F.lit(","), F.lit(".")).try_cast("double"), F.lit(float("inf")))


def percent(c: Column, label: str) -> Column:
    """``96,72%`` to 96.72; any other text is null (FN10)."""
    digits = rx(clean(c, label), r"^(\d+(?:[.,]\d+)?)\s*%?\z")
    return F.replace(digits, F.lit(","), F.lit(".")).try_cast("double")


def years(c: Column, label: str) -> Column:
    """Whole digits, a whole number, or ``N tahun`` somewhere in the text (FN11)."""
    value = clean(c, label)
    whole = rx(value, r"^(\d+)(?:\.0+)?\z")
    return F.coalesce(whole, rx(value, r"\b(\d+)\s*tahun\b")).try_cast("int")


def small_number_text(c: Column) -> Column:
    """First group of one to three digits, kept as text (FN12)."""
    return rx(c, r"\b\d{1,3}\b", 0)


def repair_digits(c: Column) -> Column:
    """Letters that a reader confuses with digits become digits, the rest is dropped (FN13)."""
    # Look-alike characters and their digits.
    return drop(F.translate(c, "OoDIl!|bBSs", "00011116855"), r"\D")


def id_digits(c: Column) -> Column:
    """Digits with O read as zero (FN14)."""
    return F.translate(drop(c, r"[^\dOo]", flags=""), "Oo", "00")


def tax_id(c: Column, label: str) -> Column:
    """Keep the tax id as printed; the label only goes when 15 or 16 digits remain (FN14)."""
    cleaned = strip(drop(strip(c), rf"^(?:{label}){_SEP}"))
    kept = F.when(F.length(id_digits(cleaned)).isin(15, 16), cleaned).otherwise(strip(c))
    return F.when(c != "", kept)


def gender(c: Column) -> Column:
    """Canonical gender words, otherwise the upper-cased text (FN17)."""
    return (
        F.when(has(c, "LAKI|PRIA"), F.lit("LAKI-LAKI"))
        .when(has(c, "PEREMPUAN|WANITA"), F.lit("PEREMPUAN"))
        .otherwise(F.upper(blank_to_null(strip(c))))
    )
