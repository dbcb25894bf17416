"""Masks on exact strings, against plain patterns, and over nested rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docmill.functions import masking as M
from docmill.operators.masking import mask_frame

WHOLE = [
    ("id 3578010101850002.", "id 357801******0002."),
    ("tax 02.468.135.7-503.111", "tax 02.***.***.*-***.111"),
    ("raw 024681357503111", "raw 02*******111"),
    ("card 4111 2222 3333 4444", "card 4111-****-****-4444"),
    ("call 081234567890 or +6281234567890", "call 0812****890 or +62812****890"),
    ("mail user.name@site.co.id", "mail u***e@site.co.id"),
    ("Authorization: bearer abc.def-1", "Authorization: Bearer [REDACTED]"),
    ("AIza" + "x" * 31, "AIza" + "*" * 31),
    ("api_key: 'Hidden12345'", "api_key: '[REDACTED]'"),
    ("password=abc", "password=abc"),
    ("NIORA : AB12345678 Permit Number : 2C21AB1234YZ", "NIORA : AB******78 Permit Number : 2C********YZ"),
    ("No. Rekening : 148-00-1234567-8", "No. Rekening : 14*-**-******7-8"),
    ("ACC. No. : 1-2-3-4-", "ACC. No. : *-*-*-*-"),
    ("é123456789012345 and é3578010101850002", "é123456789012345 and é3578010101850002"),
    ("nothing here", "nothing here"),
    ("", ""),
]


@pytest.mark.parametrize("as_columns", [True, False])
def test_whole_chain(spark, as_columns):
    df = spark.createDataFrame([(a, b) for a, b in WHOLE], "text string, want string")
    out = M.mask_columns(df, "text") if as_columns else df.withColumn("text", M.mask_expression(F.col("text")))
    assert [(r.text, r.want) for r in out.collect() if r.text != r.want] == []


def test_null_stays_null(spark):
    df = spark.createDataFrame([(None,)], "text string")
    assert M.mask_columns(df, "text").first().text is None


def test_single_masks(spark):
    df = spark.createDataFrame([("AB12345678", "4101234", "01.234.567.8-123.456", "012345678123456")], "p string, a string, t string, r string")
    row = df.select(
        M.mask_permit(F.col("p")), M.mask_permit(F.lit("abcd")), M.mask_account(F.col("a")), M.mask_account(F.lit("12-34")),
        M.mask_tax_id(F.col("t")), M.mask_tax_id(F.col("r")),
    ).first()
    assert tuple(row) == ("AB******78", "****", "41***34", "**-**", "01.***.***.*-***.456", "01*******456")


def test_email_rule_equals_the_plain_pattern(spark):
    plain = re.compile(r"\b([a-zA-Z0-9_.+-])[a-zA-Z0-9_.+-]*([a-zA-Z0-9_.+-])@([a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+)\b")
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab1.+-_@é ") for _ in range(rng.randint(1, 30))) for _ in range(20000)]
    texts += [t.replace(" ", "@a.b ") for t in texts[:5000]]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.m for r in df.select(M.mask_email(F.col("text")).alias("m")).collect()]
    want = [plain.sub(r"\1***\2@\3", t) for t in texts]
    assert [(t, g, w) for t, g, w in zip(texts, got, want) if g != w] == []


def test_long_runs_stay_fast(spark):
    text = "a." * 200_000 + " NIORA : " + "A1" * 100_000
    df = spark.createDataFrame([(text + " @",)], "text string")
    assert M.mask_columns(df, "text").select(F.length("text")).first()[0] == len(text) + 2


def test_nested_rows(spark):
    df = spark.sql(
        "select '3201011205900001' as nik, named_struct('contact_email', 'budi@mail.com', 'token', 'abc', 'input_tokens', 5) as metadata, "
        "array(named_struct('account_number', '4101234', 'n', 1)) as items, map('npwp', 'A123456', 'x', 'y') as extra, "
        "1234567890123456L as document_number, cast(null as string) as niora"
    )
    row = mask_frame(df).first()
    assert row.nik == "320101******0001"
    assert tuple(row.metadata) == ("b***i@mail.com", "[REDACTED]", "[REDACTED]")
    assert tuple(row["items"][0]) == ("41***34", 1)
    assert row.extra == {"npwp": "A123453456", "x": "y"}
    assert row.document_number == "123456******3456"
    assert row.niora == "[REDACTED]"
    assert mask_frame(df, strict_keys=True).first().metadata.input_tokens == 5
