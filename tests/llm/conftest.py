from pathlib import Path

import pytest

SF_DIR = "/root/testdata/sf0.001"
#: Columns that operators use inside, here as the user's own.
CLASHES = "'x' as key, 'x' as kind, 'x' as bucket, 'x' as n, 'x' as sign, 'x' as rep, 'x' as recipe, 'x' as positions, 'x' as kept, 'x' as rejected, 'x' as score, 'x' as chosen, 'x' as toxic, 'x' as sequence_id, 'x' as component".split(", ")


@pytest.fixture(scope="session")
def sf_dir():
    if not Path(SF_DIR).exists():
        pytest.skip("test tables are not here")
    return SF_DIR


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    """The given documents as a list of (doc_id, text), and as a table with clashing columns."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text", "lang", *CLASHES).cache()
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], df


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, tied, repeated and very long texts."""
    long = " ".join(f"w{i * 7919 % 5000}" for i in range(30_000))
    poem = " ".join(f"line{i}" for i in range(70))
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, long), (5, poem), (6, poem), (6, poem), (7, "x " + poem + " y"), (8, "Ab ab"), (9, "Ab ab"),
        (10, "..."), (11, "a" * 20_000), (12, "日本語 テキスト"), (None, "no id"), (13, long + " end"), (14, "rep " * 300),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "case when doc_id % 2 = 0 then 'en' end as lang", *CLASHES)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
