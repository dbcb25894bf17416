"""What a document type is, and how its plan is applied to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.dates import IsoDate
from docmill.functions.text import body, head, strip, tail

Fields = dict[str, Column]

# Place and date line above a signature.
SIGNATURE = (
    r"^([A-Za-z][A-Za-z .'-]{2,30}),\s*(\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}"
    r"|[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})\b"
)

# Working columns of an extraction; they are dropped before the record is returned.
_TEXT = "__text"
_BODY = "__body"
_PREFIX = "__f_"
_CLEAN = "__c_"


class TextView:
    """The columns a parse rule may use: the stripped text, its body, and head/tail windows."""

    def __init__(self, as_of: Column | None = None) -> None:
        self.text = F.col(_TEXT)
        self.body = F.col(_BODY)
        self.as_of = as_of if as_of is not None else F.current_date()

    def head(self, n: int) -> Column:
        return head(self.body, n)

    def tail(self, n: int) -> Column:
        return tail(self.body, n)

    def __getitem__(self, name: str) -> Column:
        """A value computed in an earlier step."""
        return F.col(_PREFIX + name)


@dataclass(frozen=True)
class DocSpec:
    """A document type (EXT1).

    ``parse`` yields steps; each step is a dict of named columns that later steps can read back
    through the view.  A name that is a schema field is that field's raw value.  ``normalize``
    cleans raw values, whether they come from ``parse`` or from a model payload.
    """

    slug: str
    name: str
    description: str
    schema: T.StructType
    normalize: Callable[[Fields], dict[str, Column | IsoDate]]
    parse: Callable[[TextView], list[Fields]] | None = None
    defaults: dict[str, str] = field(default_factory=dict)
    prompt_subject: str = ""
    field_rules: dict[str, str] = field(default_factory=dict)
    # Fields no cleaning rule looks at: a payload value of the wrong type makes the row invalid.
    unchecked: tuple[str, ...] = ()


def strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


def with_record(df: DataFrame, spec: DocSpec, raw: Fields, out: str) -> DataFrame:
    """Normalise raw values and shape them into the type's struct column.

    Three narrow steps (clean text, date candidates, record) keep each generated method small and
    each cleaned text computed once.
    """
    cleaned = spec.normalize(raw)
    dates = {n: c for n, c in cleaned.items() if isinstance(c, IsoDate)}
    values = {f.name: cleaned.get(f.name, raw[f.name]) for f in spec.schema.fields}
    df = df.withColumns({_CLEAN + n: dates[n].source if n in dates else c for n, c in values.items()})
    if dates:
        df = df.withColumns(
            {
                f"{_CLEAN}{n}.{kind}": c
                for n, date in dates.items()
                for kind, c in date.candidates(F.col(_CLEAN + n)).items()
            }
        )

    def value(name):
        text = F.col(_CLEAN + name)
        if name not in dates:
            return text
        return dates[name].combine(text, {k: F.col(f"`{_CLEAN}{name}.{k}`") for k in IsoDate.KINDS})

    record = F.struct(*[value(f.name).cast(f.dataType).alias(f.name) for f in spec.schema.fields])
    extra = [f"{_CLEAN}{n}.{k}" for n in dates for k in IsoDate.KINDS]
    return df.withColumn(out, record).drop(*[_CLEAN + n for n in values], *extra)


def extract(
    df: DataFrame,
    spec: DocSpec,
    text_col: str = "text",
    out: str = "record",
    as_of: Column | None = None,
) -> DataFrame:
    """Add the typed record of one document type (EX1-EX11): narrow, no shuffle, no Python rows."""
    if spec.parse is None:
        raise ValueError(f"document type {spec.slug} has no text rules")
    view = TextView(as_of)
    names: list[str] = []
    df = df.withColumn(_TEXT, strip(F.col(text_col))).withColumn(_BODY, body(F.col(_TEXT)))
    for step in spec.parse(view):
        df = df.withColumns({_PREFIX + n: c for n, c in step.items()})
        names += list(step)
    raw = {
        f.name: view[f.name] if f.name in names else F.lit(None).cast(f.dataType) for f in spec.schema.fields
    }
    for name, default in spec.defaults.items():
        raw[name] = F.coalesce(raw[name], F.lit(default))
    return with_record(df, spec, raw, out).drop(_TEXT, _BODY, *[_PREFIX + n for n in names])
