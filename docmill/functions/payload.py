"""Repair of model responses to one JSON object (LLM7) and typed access to it (LLM8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.text import blank_to_null, let, strip

_FENCE_LINE = r"(?m)^[^\S\n]*```[^\n]*(?:\n|\z)"


def json_object(c: Column) -> Column:
    """The text as a VARIANT when all of it is one JSON object, else null.

    Parsing inside brackets makes trailing content visible as a second element.  Text that closes the
    added bracket itself would hide what follows, so it must parse inside braces as well: one that ends the
    bracket breaks the braces, and the other way round.
    """
    braced = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    wrapped = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))

    def sole(w):
        alone = F.try_variant_get(w, "$[1]", "variant").isNull()
        return F.when(alone & braced.isNotNull(), F.try_variant_get(w, "$[0]", "variant"))

    return F.when(F.rlike(c, F.lit(r"^[ \t\n\r]*\{")), let(wrapped, sole))


def fenced_text(c: Column) -> Column:
    """Contents of all code fences: every second piece between fence lines."""
    pieces = F.split(c, _FENCE_LINE, -1)
    inside = F.filter(pieces, lambda _, i: i % 2 == 1)
    return F.when(F.contains(c, F.lit("```")), blank_to_null(strip(F.array_join(inside, ""))))


def braced_text(c: Column) -> Column:
    """From the first opening to the last closing brace."""
    return blank_to_null(F.regexp_extract(c, r"(?s)\{.*\}", 0))


def repair_object(c: Column) -> Column:
    """Direct parse, then fenced text, then braced text; null when none is an object."""

    def first(text):
        return F.coalesce(json_object(text), let(fenced_text(text), json_object), let(braced_text(text), json_object))

    return let(blank_to_null(strip(c)), first)


def as_text(v: Column, name: str) -> Column:
    """A member that is a JSON string; other kinds are null."""
    member = F.try_variant_get(v, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(member) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def as_number_text(v: Column, name: str) -> Column:
    """A member that is a JSON string or number, as text for the number rules; booleans are null."""
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    return F.when(~kind.isin("BOOLEAN", "VOID"), F.try_variant_get(v, f"$.{name}", "string"))


def wrong_kind(v: Column, name: str) -> Column:
    """Present, not null and not a string."""
    member = F.try_variant_get(v, f"$.{name}", "variant")
    return member.isNotNull() & ~F.schema_of_variant(member).isin("STRING", "VOID")


def is_absent(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant").isNull()


def text_only(t: T.DataType) -> T.DataType:
    """The same shape with every leaf as text, so numbers can be cleaned before they are cast."""
    if isinstance(t, T.ArrayType):
        return T.ArrayType(text_only(t.elementType))
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, text_only(f.dataType)) for f in t.fields])
    return T.StringType()


def member(v: Column, f: T.StructField) -> Column:
    """Raw value of a record field, ready for its normaliser."""
    if isinstance(f.dataType, T.ArrayType):
        return F.try_variant_get(v, f"$.{f.name}", text_only(f.dataType).simpleString())
    if isinstance(f.dataType, T.StringType):
        return as_text(v, f.name)
    return as_number_text(v, f.name)
