"""Masking of nested rows by field name (PI13) and of log rows (PI14).

The schema is walked once when the plan is built; the work itself is one narrow projection.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.masking import (
    REDACTED,
    bound,
    mask_account,
    mask_columns,
    mask_expression,
    mask_permit,
)

# Name parts that mark credentials and identifiers.
CREDENTIALS = (
    "password", "secret", "token", "access_token", "api_key", "auth_token", "authorization",
    "client_secret", "private_key", "cvv",
)
IDENTIFIERS = (
    "nik", "nomor_ktp", "document_number", "npwp", "nomor_npwp", "tax_number", "kk", "no_kk", "nomor_kk",
    "credit_card", "card_number", "bank_account", "account_number", "nomor_rekening", "niora",
    "permit_number", "passport_number",
)
PERMIT_NAMES = ("niora", "permit_number", "passport_number")
ACCOUNT_NAMES = ("bank_account", "account_number")


def _names(key: str, parts: tuple[str, ...], strict: bool) -> bool:
    """Whether a name holds one of the parts; with ``strict`` only as whole words of the name."""
    key = key.lower()
    if not strict:
        return any(p in key for p in parts)
    return any(re.search(rf"(?:^|_){re.escape(p)}(?:$|_)", key) for p in parts)


def _generic(c: Column) -> Column:
    """First six, stars, last four; lengths 7 to 10 keep all their characters."""
    stars = F.repeat(F.lit("*"), F.greatest(F.length(c) - 10, F.lit(0)))
    return F.concat(F.left(c, F.lit(6)), stars, F.right(c, F.lit(4)))


def _own_mask(c: Column, permit: Column, account: Column) -> Column:
    """The full chain once; a value that it leaves alone gets the mask of its kind."""

    def chosen(masked: Column) -> Column:
        own = F.when(permit, mask_permit(c)).when(account, mask_account(c)).otherwise(_generic(c))
        return F.when((masked == c) & (F.length(c) > 6), own).otherwise(masked)

    return F.when(c.isNull(), F.lit(REDACTED)).otherwise(bound(mask_expression(c), chosen))


def _number_mask(c: Column) -> Column:
    """First six and last four of a number with 16 digits, else nothing of it."""
    text = c.cast("string")
    edges = F.concat(F.left(text, F.lit(6)), F.lit("******"), F.right(text, F.lit(4)))
    return F.when(F.length(text) == 16, edges).otherwise(F.lit(REDACTED))


def _identifier(c: Column, key: str, t: T.DataType, strict: bool) -> Column:
    if isinstance(t, T.StringType):
        return _own_mask(c, F.lit(_names(key, PERMIT_NAMES, strict)), F.lit(_names(key, ACCOUNT_NAMES, strict)))
    return _number_mask(c) if isinstance(t, T.NumericType) else F.lit(REDACTED)


def mask_value(c: Column, t: T.DataType, strict: bool = False) -> Column:
    """Mask a value of any shape: structs by field name, maps by key, arrays by element."""
    if isinstance(t, T.StringType):
        return mask_expression(c)
    if isinstance(t, T.StructType):
        fields = [_member(c[f.name], f.name, f.dataType, strict).alias(f.name) for f in t.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: mask_value(x, t.elementType, strict))
    if isinstance(t, T.MapType):
        return F.transform_values(c, lambda k, v: _by_key(k.cast("string"), v, t.valueType, strict))
    return c


def _as_text(c: Column, t: T.DataType) -> Column:
    """A masked value as text: JSON for nested ones."""
    return F.to_json(c) if isinstance(t, T.StructType | T.ArrayType | T.MapType) else c.cast("string")


def _by_key(k: Column, v: Column, t: T.DataType, strict: bool) -> Column:
    """Map entries: the key is only known at run time, so all values become text, nested ones JSON."""

    def holds(parts):
        names = "|".join(map(re.escape, parts))
        return F.rlike(F.lower(k), F.lit(rf"(?:^|_)(?:{names})(?:$|_)" if strict else names))

    if isinstance(t, T.StringType):
        own = _own_mask(v, holds(PERMIT_NAMES), holds(ACCOUNT_NAMES))
    else:
        own = _number_mask(v) if isinstance(t, T.NumericType) else F.lit(REDACTED)
    masked = _as_text(mask_value(v, t, strict), t)
    return F.when(holds(CREDENTIALS), F.lit(REDACTED)).when(holds(IDENTIFIERS), own).otherwise(masked)


def _member(c: Column, key: str, t: T.DataType, strict: bool) -> Column:
    if _names(key, CREDENTIALS, strict):
        return F.lit(REDACTED)
    if _names(key, IDENTIFIERS, strict):
        return _identifier(c, key, t, strict)
    return mask_value(c, t, strict)


def mask_frame(df: DataFrame, strict_keys: bool = False) -> DataFrame:
    """Mask every column of a table by its name and type (PI13)."""
    return df.select(
        *[_member(F.col(f"`{f.name}`"), f.name, f.dataType, strict_keys).alias(f.name) for f in df.schema.fields]
    )


def mask_logs(logs: DataFrame) -> DataFrame:
    """Mask messages and stack traces of log rows, batch or stream (PI14)."""
    work = logs.withColumn("__trace", F.col("exception.stacktrace"))
    masked = mask_columns(work, "message", "__trace")
    exception = F.when(
        F.col("exception").isNotNull(), F.col("exception").withField("stacktrace", F.col("__trace"))
    )
    return masked.withColumn("exception", exception).drop("__trace")
