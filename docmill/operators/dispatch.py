"""Extraction by document type (EX12, EX13) and typing of model payloads (LLM7-LLM9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import payload as P
from docmill.functions.text import is_blank
from docmill.plans import registry
from docmill.plans.base import DocSpec, extract, with_record

_KEEP_NULLS = {"ignoreNullFields": "false"}
EMPTY_TEXT = "Empty text provided for analysis"
BAD_PAYLOAD = "Response is not a valid JSON object"
EMPTY_PAYLOAD = "Empty response"


def extract_type(df: DataFrame, slug: str, text_col: str = "text", as_of: Column | None = None) -> DataFrame:
    """Typed records of the documents of one type."""
    return extract(df.filter(F.col("document_type") == slug), registry.get(slug), text_col, as_of=as_of)


def _only_if(test: Column):
    return lambda _: test


def _one_pass(df: DataFrame, value_col: str, specs: list[DocSpec], build) -> DataFrame:
    """Run ``build`` of every type over one scan and keep the record of the row's own type as JSON.

    A value is handed to the rules of its own type only; for every other type it is null, and a null
    costs no matching.  No shuffle, and the input is read once however many types there are.
    """
    out = df
    for spec in specs:
        # An array function ends a generated method, so the rules of each type compile on their own.
        mine = F.col("document_type") == spec.slug
        own = F.get(F.filter(F.array(F.col(value_col)), _only_if(mine)), 0)
        out = build(out.withColumn("__own", own), spec)
        data = F.when(F.col("__own").isNotNull(), F.to_json("__record", _KEEP_NULLS))
        out = out.withColumn(f"__d_{spec.slug}", data).drop("__own", "__record")
    return out


def _unknown_type() -> Column:
    names = [s.slug for s in registry.specs()]
    return ~F.coalesce(F.col("document_type").isin(*names), F.lit(False))


def extract_mixed(df: DataFrame, text_col: str = "text", as_of: Column | None = None) -> DataFrame:
    """Records of all types as JSON in one pass over the input (EX12)."""
    kept = df.columns
    parsed = [s for s in registry.specs() if s.parse is not None]
    blank = is_blank(F.col(text_col))
    work = df.withColumn("__filled", F.when(~blank, F.col(text_col)))
    out = _one_pass(work, "__filled", parsed, lambda d, spec: extract(d, spec, "__own", "__record", as_of))
    error = (
        F.when(_unknown_type(), F.lit("Unknown document type"))
        .when(blank, F.lit(EMPTY_TEXT))
        .when(
            ~F.col("document_type").isin(*[s.slug for s in parsed]),
            F.concat(F.lit("String parsing is not implemented for document type "), F.col("document_type")),
        )
    )
    return out.select(
        *kept, F.coalesce(*[F.col(f"__d_{s.slug}") for s in parsed]).alias("data"), error.alias("error")
    )


def extract_routed(
    df: DataFrame, text_col: str = "text", as_of: Column | None = None, present: set[str] | None = None
) -> DataFrame:
    """The rows of ``extract_mixed``, each type on its own rows and rules only (EX12).

    For tables partitioned by ``document_type``: each branch reads its own partitions, so all of them read the table
    once, and its plan holds the rules of one type.  A table that is not partitioned so is read once for each type
    and once for the rows of no type.  ``present`` names the types that the table holds, where that is known; rules of
    others are not planned.  Use ``extract_mixed`` for streams and for inputs that are costly to compute again.
    """
    kept = df.columns
    blank = is_blank(F.col(text_col))
    parsed = [s for s in registry.specs() if s.parse is not None]
    no_record = F.lit(None).cast("string")
    error = F.when(_unknown_type(), F.lit("Unknown document type")).when(blank, F.lit(EMPTY_TEXT)).otherwise(
        F.concat(F.lit("String parsing is not implemented for document type "), F.col("document_type"))
    )
    mine = F.coalesce(F.col("document_type").isin(*[s.slug for s in parsed]), F.lit(False)) & ~blank
    out = df.filter(~mine).select(*kept, no_record.alias("data"), error.alias("error"))
    for spec in parsed:
        if present is not None and spec.slug not in present:
            continue
        rows = df.filter((F.col("document_type") == spec.slug) & ~blank)
        found = extract(rows, spec, text_col, "__record", as_of)
        out = out.unionByName(found.select(*kept, F.to_json("__record", _KEEP_NULLS).alias("data"), no_record.alias("error")))
    return out


def payloads_mixed(df: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Model responses of all types to records as JSON, in one pass (LLM8)."""
    kept = df.columns
    specs = registry.specs()

    def build(d, spec):
        typed = type_payloads(d, spec, "__own", "__record", "__error")
        return typed.withColumnRenamed("__error", f"__e_{spec.slug}")

    out = _one_pass(df, payload_col, specs, build)
    own_error = F.coalesce(*[F.when(F.col("document_type") == s.slug, F.col(f"__e_{s.slug}")) for s in specs])
    error = F.when(_unknown_type(), F.lit("Unknown document type")).otherwise(own_error)
    data = F.coalesce(*[F.col(f"__d_{s.slug}") for s in specs])
    return out.select(*kept, F.when(error.isNull(), data).alias("data"), error.alias("error"))


def type_payloads(
    df: DataFrame, spec: DocSpec, payload_col: str = "payload", out: str = "record", error_col: str = "error"
) -> DataFrame:
    """Model responses of one type to typed records, with the reason when a row has none (LLM8).

    A missing member takes the declared default, an explicit null stays null.  A field that no rule
    cleans must be text or null; otherwise the row is invalid and names the field.
    """
    names = spec.schema.fieldNames()
    df = df.withColumn("__v", P.repair_object(F.col(payload_col)))
    v = F.col("__v")
    raw_cols = {f"__p_{f.name}": P.member(v, f) for f in spec.schema.fields}
    for name, default in spec.defaults.items():
        raw_cols[f"__p_{name}"] = F.when(P.is_absent(v, name), F.lit(default)).otherwise(raw_cols[f"__p_{name}"])
    wrong = F.array_compact(
        F.array(*[F.when(P.wrong_kind(v, n), F.lit(n)) for n in spec.unchecked], F.lit(None).cast("string"))
    )
    df = df.withColumns(raw_cols | {"__wrong": wrong})
    df = with_record(df, spec, {n: F.col(f"__p_{n}") for n in names}, out)
    error = (
        F.when(is_blank(F.col(payload_col)), F.lit(EMPTY_PAYLOAD))
        .when(v.isNull(), F.lit(BAD_PAYLOAD))
        .when(F.size("__wrong") > 0, F.concat(F.lit("Invalid fields: "), F.array_join("__wrong", ", ")))
    )
    return (
        df.withColumn(error_col, error)
        .withColumn(out, F.when(F.col(error_col).isNull(), F.col(out)))
        .drop("__v", "__wrong", *raw_cols)
    )


def fill_rate(df: DataFrame, record: str = "record", type_col: str | None = "document_type") -> DataFrame:
    """Share of non-null values per field (FLT13): one long row per type and field."""
    fields = df.schema[record].dataType.fieldNames()
    keys = [type_col] if type_col else []
    counts = df.groupBy(*keys).agg(
        F.count("*").alias("documents"), *[F.count(F.col(f"{record}.{n}")).alias(f"__n_{n}") for n in fields]
    )
    pairs = F.explode(
        F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"__n_{n}").alias("filled")) for n in fields])
    )
    return counts.select(*keys, "documents", pairs.alias("p")).select(
        *keys, "p.field", "documents", "p.filled", (F.col("p.filled") / F.col("documents")).alias("fill_rate")
    )
