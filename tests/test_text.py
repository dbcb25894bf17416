"""Text primitives against plain Python on random texts."""

import random
import re

from pyspark.sql import functions as F

from docmill.functions import labels as L
from docmill.functions import text as X
from docmill.plans.tax_entity import _ISSUED

ALPHABET = "ab:1 \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　é"


def _texts(n=4000, alphabet=ALPHABET, size=25, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, size))) for _ in range(n)]


def test_body_and_lines(spark):
    texts = _texts()
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(X.body(F.col("t")).alias("b"), X.lines(F.col("t")).alias("l"), X.strip(F.col("t")).alias("s")).collect()
    for t, r in zip(texts, rows):
        want = [x.strip() for x in t.splitlines() if x.strip()]
        assert (r.b, r.l, r.s) == ("\n".join(want), want, t.strip())


def test_blank_runs_are_linear(spark):
    df = spark.range(1).select(F.concat(F.lit("a"), F.repeat(F.lit(" "), 2_000_000), F.lit("b\n")).alias("t"))
    assert df.select(F.length(X.body(F.col("t")))).first()[0] == 2_000_002


def test_windows(spark):
    df = spark.createDataFrame([("a\nb\nc",)], "t string")
    row = df.select(X.head(F.col("t"), 2), X.tail(F.col("t"), 2), X.tail(F.col("t"), 9)).first()
    assert tuple(row) == ("a\nb", "b\nc", "a\nb\nc")


def test_place_and_date_rule_equals_the_plain_pattern(spark):
    plain = re.compile(r"\b([A-Za-z\s]+?),\s*(\d{1,2}\s+\w+\s+\d{4})")
    rng = random.Random(2)
    texts = ["".join(rng.choice(["ab", " ", "5", ".", "_", "é", ", 1 Mei 2020", ",", "\n", "x"]) for _ in range(rng.randint(1, 12))) for _ in range(8000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(X.strip(X.rx(F.col("t"), _ISSUED, 1, "")).alias("p"), X.rx(F.col("t"), _ISSUED, 2, "").alias("d")).collect()
    for t, r in zip(texts, rows):
        m = plain.search(t)
        assert (r.p or None, r.d) == ((m.group(1).strip() or None, m.group(2)) if m else (None, None)), t


def test_label_flavours_differ(spark):
    text = "Name :\nName : A\nTitle B\nAlso (x)：\n: C\nMark,\nWith Qualification x\nD"
    row = spark.createDataFrame([(text,)], "b string").select(
        L.find_nonempty(F.col("b"), "Name"), L.value_first(F.col("b"), "Name"), L.find_or_next(F.col("b"), "Also"),
        L.find_wide_colon(F.col("b"), "Name"), L.strip_label(F.col("b"), "Title"), L.after_marker(F.col("b"), "Mark,"),
        L.strip_label(F.col("b"), "Name"), L.find_or_next(F.col("b"), "Name"),
    ).first()
    assert tuple(row) == ("A", None, "C", "A", "B", "D", "A", "A")


def test_marker_with_stop_line_is_null(spark):
    texts = ["Mark,\nSertifikat x\nD", "Mark,\nIs competent\nIn the area\nX\nMark,\nD", "Mark,"]
    df = spark.createDataFrame([(t,) for t in texts], "b string")
    assert [r[0] for r in df.select(L.after_marker(F.col("b"), "Mark,")).collect()] == [None, "D", None]
