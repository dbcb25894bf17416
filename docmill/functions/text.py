"""Text primitives shared by every extraction plan.

A document is handled as one multi-line string, not as an array of lines: ``body`` is the
text with every line stripped and blank lines gone, lines joined by ``\\n``.  A field is then one
line-anchored ``regexp_extract`` over the body, which stays inside generated code, and head or
tail windows are ``substring_index`` calls.

All patterns run with ``(?U)`` and ``(?d)``: ``\\s \\d \\w \\b`` are Unicode aware and only ``\\n``
ends a line, which is the dialect the source rules are written in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white space characters that a strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The characters that end a line.
LINE_BREAKS = r"\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029"

# One white-space run that holds a line break.  It can only start where a run starts and both
# repeats are possessive, so the scan stays linear even on long runs of blanks.
_BREAK_RUN = (
    rf"(?U)(?<![\s\x1C-\x1F])[\s\x1F&&[^{LINE_BREAKS}]]*+[{LINE_BREAKS}][\s\x1C-\x1F]*+"
)

INLINE_SPACE = r"[^\S\n]"


def text_pattern(pattern: str, flags: str = "i") -> str:
    """A pattern for whole texts: white space may run over line ends."""
    return f"(?{flags}Ud){pattern}"


def line_pattern(pattern: str, flags: str = "i") -> str:
    """A pattern for the body: ``^``/``$`` are line ends and ``\\s`` stays inside its line."""
    return f"(?{flags}mUd)" + pattern.replace(r"\s", INLINE_SPACE)


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends (FN2)."""
    return F.btrim(c, F.lit(WHITESPACE))


def let(c: Column, use) -> Column:
    """``use`` of a value that it reads more than once; computed once, also where a filter takes the expression in."""
    return F.get(F.transform(F.array(c), use), 0)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def is_blank(c: Column) -> Column:
    """Blank-text predicate, null counts as blank (FLT7)."""
    return F.coalesce(strip(c) == "", F.lit(True))


def body(text: Column) -> Column:
    """Stripped non-blank lines joined by a newline (FN1 in one string)."""
    return strip(F.regexp_replace(text, _BREAK_RUN, "\n"))


def lines(text: Column) -> Column:
    """Stripped non-blank lines as an array (FN1)."""
    joined = body(text)
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, "\n"))


def head(body_col: Column, n: int) -> Column:
    """The first ``n`` lines (WIN2)."""
    return F.substring_index(body_col, "\n", n)


def tail(body_col: Column, n: int) -> Column:
    """The last ``n`` lines (WIN3)."""
    return F.substring_index(body_col, "\n", -n)


def rx(c: Column, pattern: str, group: int = 1, flags: str = "i") -> Column:
    """First match over a text; null when there is none or the group is empty."""
    return blank_to_null(F.regexp_extract(c, text_pattern(pattern, flags), group))


def after_first(marker: str, rest: str) -> str:
    """A whole-text pattern for ``rest`` behind the first ``marker``.

    When ``rest`` is found by scanning on, a later marker cannot succeed where the first one failed;
    the atomic prefix rules the later ones out, so a text full of markers is still scanned only once.
    Use with the flags ``is``.
    """
    return rf"\A(?>.*?{marker}){rest}"


def has(c: Column, pattern: str, flags: str = "i") -> Column:
    return F.rlike(c, F.lit(text_pattern(pattern, flags)))


def line_rx(c: Column, pattern: str, group: int = 1, flags: str = "i") -> Column:
    """First match over a body, line by line (WIN1)."""
    return blank_to_null(F.regexp_extract(c, line_pattern(pattern, flags), group))


def line_last(c: Column, pattern: str, group: int = 1, flags: str = "i") -> Column:
    """Last match over a body."""
    hits = F.regexp_extract_all(c, F.lit(line_pattern(pattern, flags)), F.lit(group))
    return F.try_element_at(hits, F.lit(-1))


def next_line(c: Column, pattern: str, flags: str = "i") -> Column:
    """The line after the first line that starts with ``pattern`` (WIN4)."""
    return line_rx(c, rf"^(?:{pattern}).*\n(.*)$", 1, flags)


def drop(c: Column, pattern: str, replacement: str = "", flags: str = "i") -> Column:
    return F.regexp_replace(c, text_pattern(pattern, flags), replacement)


def first_hit(c: Column, choices: list[tuple[str, str]], flags: str = "i") -> Column:
    """The value of the first pattern, in list order, found in ``c`` (FN18)."""
    return F.coalesce(*[F.when(has(c, pattern, flags), F.lit(value)) for pattern, value in choices])


def first_contained(c: Column, words: list[str], rename: dict[str, str] | None = None) -> Column:
    """The first word, in list order, contained in ``c`` (FN18)."""
    rename = rename or {}
    return F.coalesce(*[F.when(F.contains(c, F.lit(w)), F.lit(rename.get(w, w))) for w in words])


def is_upper_text(c: Column) -> Column:
    """At least one upper-case and no lower-case letter (FN21)."""
    return F.rlike(c, F.lit(r"[\p{Lu}\p{Lt}]")) & ~F.rlike(c, F.lit(r"\p{Ll}"))


def replace_matches(c: Column, pattern: str, rewrite) -> Column:
    """Rewrite every match of ``pattern`` with a Column function of the matched text.

    The text between matches and the matches themselves are cut with the same pattern and
    zipped back together, so the work is linear and no marker character is needed.
    """
    between = F.split(c, pattern, -1)
    matches = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    parts = F.zip_with(
        between, matches, lambda gap, hit: F.concat(gap, F.when(hit.isNull(), F.lit("")).otherwise(rewrite(hit)))
    )
    return F.array_join(parts, "")
