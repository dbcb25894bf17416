"""Label/value lookup over a document body, in the six flavours the document types need.

They differ in what an empty value means and in how the label is removed, so they are six
functions rather than one with switches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions.text import has, line_rx

_COLON = "[:：]"


def find_nonempty(body: Column, label: str) -> Column:
    """LBL1: first line ``label : value`` with a value; empty values are passed over."""
    return line_rx(body, rf"^{label}\s*:\s*(.+?)\s*$")


def value_first(body: Column, label: str) -> Column:
    """LBL2: the first line with the label decides, an empty value is null."""
    return line_rx(body, rf"^{label}\s*:\s*(.*?)\s*$")


def find_or_next(body: Column, label: str) -> Column:
    """LBL3: optional ``(...)`` after the label; the value may follow on a line led by a colon."""
    return line_rx(
        body,
        rf"^(?:{label})(?:\s*\([^)\n]*\))?\s*(?:{_COLON}\s*|{_COLON}?\s*\n{_COLON}\s*)(\S.*)$",
    )


def find_wide_colon(body: Column, label: str) -> Column:
    """LBL4: as LBL1 with an optional full-width colon."""
    return line_rx(body, rf"^(?:{label})\s*{_COLON}\s*(.+)$")


# Lines that repeat a marker in English, and lines that end the search.
_ECHO = r"(?:This\s+is\s+to\s+certify|With\s+Qualification|In\s+the\s+area|Is\s+competent)\b"
_STOP = r"^(?:No\.?\s|Sertifikat\b|Telah\b|Dengan\b|Pada\b|\d+\.)"


def after_marker(body: Column, marker: str) -> Column:
    """LBL5: value on one of the two lines after a marker line, English echo lines skipped."""
    candidate = line_rx(body, rf"^(?:{marker})$\n(?:{_ECHO}.*\n)?(?!{_ECHO})(.*)$")
    return F.when(~has(candidate, _STOP), candidate)


def strip_label(body: Column, label: str, guard: str = "") -> Column:
    """LBL6: colon or dot optional; first line with something left after the label.

    The prefix is atomic: a label is never given back to make an empty value look full.
    """
    return line_rx(body, rf"^{guard}(?>{label}\s*[:.]?\s*)(\S.*)$")
