"""Date normalisation to ISO strings (FN3-FN6, FN16)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions.text import blank_to_null, drop, rx, strip

# Month names, Indonesian first, then English.
_MONTHS = [
    ("januari", "01"), ("februari", "02"), ("maret", "03"), ("april", "04"), ("mei", "05"),
    ("juni", "06"), ("juli", "07"), ("agustus", "08"), ("september", "09"), ("oktober", "10"),
    ("november", "11"), ("desember", "12"),
    ("jan", "01"), ("january", "01"), ("feb", "02"), ("february", "02"), ("mar", "03"),
    ("march", "03"), ("apr", "04"), ("may", "05"), ("jun", "06"), ("june", "06"), ("jul", "07"),
    ("july", "07"), ("aug", "08"), ("august", "08"), ("sep", "09"), ("sept", "09"), ("oct", "10"),
    ("october", "10"), ("nov", "11"), ("dec", "12"), ("december", "12"),
]

_NUMERIC = r"\b\d{1,2}[-/.]\d{1,2}[-/.]\d{4}\b"
_TEXTUAL = r"\b\d{1,2}\s+(?:\S*/)?[A-Za-z]{3,9}\.?\s+\d{4}\b"
MONTH_FIRST = r"\b([A-Za-z]{3,9})\s+(\d{1,2}),?\s+(\d{4})\b"


_MONTH_MAP = "map(" + ", ".join(f"'{name}', '{number}'" for name, number in _MONTHS) + ")"


def _two(c: Column) -> Column:
    return F.lpad(c, 2, "0")


@dataclass(frozen=True)
class IsoDate:
    """A date to be normalised from ``source``.

    The three candidate matches are used several times each, so they are columns of their own step
    (``candidates``) and the ISO text is put together from them (``combine``).
    """

    KINDS = ("iso", "numeric", "textual")

    source: Column
    keep_text: bool = False

    def candidates(self, text: Column) -> dict[str, Column]:
        return {
            "iso": rx(text, r"\b\d{4}-\d{2}-\d{2}\b", 0),
            "numeric": rx(text, _NUMERIC, 0),
            "textual": rx(text, _TEXTUAL, 0),
        }

    def combine(self, text: Column, found: dict[str, Column]) -> Column:
        """First ISO, then first numeric day-first, then first textual date anywhere (FN3)."""
        numeric = F.split(found["numeric"], "[-/.]")
        day_first = F.concat(
            F.get(numeric, 2), F.lit("-"), _two(F.get(numeric, 1)), F.lit("-"), _two(F.get(numeric, 0))
        )
        month_name = F.lower(rx(found["textual"], r"([A-Za-z]{3,9})\.?\s+\d{4}$"))
        named = F.concat(
            F.right(found["textual"], F.lit(4)), F.lit("-"), F.try_element_at(F.expr(_MONTH_MAP), month_name), F.lit("-"),
            _two(rx(found["textual"], r"^\d{1,2}", 0)),
        )
        return F.coalesce(found["iso"], day_first, named, *([text] if self.keep_text else []))


def iso_date(c: Column) -> Column:
    """FN3 as one expression, for a column that is cheap to read more than once."""
    date = IsoDate(c)
    return date.combine(c, date.candidates(c))


def iso_or_text(c: Column) -> IsoDate:
    """ISO date, else the stripped text itself (FN5)."""
    return IsoDate(blank_to_null(strip(c)), keep_text=True)


def month_first_only(c: Column) -> Column:
    """Replace the whole value by its first ``Month d, yyyy`` date written day first (FN4)."""
    return drop(c, rf"^.*?{MONTH_FIRST}.*$", "$2 $1 $3", flags="s")


def month_first_in_place(c: Column) -> Column:
    """Write every ``Month d, yyyy`` day first and keep the text around it (FN4)."""
    return drop(c, MONTH_FIRST, "$2 $1 $3", flags="")


def mrz_date(raw: Column, as_of: Column | None = None) -> Column:
    """``yymmdd`` to ISO (FN16).

    With ``as_of`` a date after it is moved to the previous century (birth dates); without it the
    date stays in the 2000s (expiry dates).
    """
    digits = F.when(F.rlike(raw, F.lit(r"^\d{6}$")), raw)
    recent = F.try_to_date(F.concat(F.lit("20"), digits), "yyyyMMdd")
    if as_of is None:
        return F.date_format(recent, "yyyy-MM-dd")
    past = F.when(recent.isNotNull(), F.try_to_date(F.concat(F.lit("19"), digits), "yyyyMMdd"))
    return F.date_format(F.when(recent > as_of, past).otherwise(recent), "yyyy-MM-dd")
