"""Streams give the rows of the batch jobs; sinks write what they should."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from docmill.operators.trace import printable
from docmill.sinks.writers import write_log_tiers, write_results, write_traces
from docmill.sources.files import read_logs
from docmill.session import shared_root
from docmill.streaming import jobs as ST

TEXTS = [
    (1, "identity_card", "NIK : 3171010101900001\nNama : A B"), (2, "bank_account", "mandiri\nAccount No : 123456-7"),
    (3, "recipe", "x"), (4, "identity_card", " "), (5, "bank_account", "mail a.b@c.id"),
]


@pytest.fixture()
def texts(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame(TEXTS, "doc_id bigint, document_type string, text string").repartition(2).write.parquet(path)
    return path


def _rows(df):
    return sorted(str(r) for r in df.collect())


@pytest.mark.parametrize("job", [lambda d: ST.extract_stream(d, "bank_account").select("doc_id", "record.*"), ST.extract_stream, lambda d: ST.mask_stream(d, "text")])
def test_stream_equals_batch(spark, tmp_path, texts, job):
    batch = job(spark.read.parquet(texts))
    stream = job(spark.readStream.schema("doc_id bigint, document_type string, text string").parquet(texts))
    query = ST.start(stream, f"s_{uuid.uuid4().hex}", str(tmp_path / "out"), str(tmp_path / "chk"))
    query.awaitTermination()
    assert _rows(spark.read.parquet(str(tmp_path / "out")).select(*batch.columns)) == _rows(batch)


def test_per_batch_jobs(spark, tmp_path, texts):
    seen = []
    stream = spark.readStream.schema("doc_id bigint, document_type string, text string").parquet(texts)
    ST.start_per_batch(stream, f"b_{uuid.uuid4().hex}", lambda df, i: seen.append(df.count()), str(tmp_path / "chk")).awaitTermination()
    assert sum(seen) == 5


def test_checkpoint_folder_comes_from_the_session_first(spark):
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        assert shared_root(spark, "/elsewhere") == own.rstrip("/")
    else:
        assert shared_root(spark, "/elsewhere/") == "/elsewhere"
        with pytest.raises(ValueError):
            shared_root(spark)


def test_log_tiers(spark, tmp_path):
    src = tmp_path / "logs"
    src.mkdir()
    rows = [
        {"timestamp": "2026-01-02T03:04:05", "level": lvl, "logger": lg, "message": "id 3171010101900001", "request_id": "r"}
        for lvl, lg in [("INFO", "x"), ("ERROR", "x"), ("WARNING", "docmill.access"), ("INFO", "docmill.access")]
    ]
    (src / "a.json").write_text("\n".join(json.dumps(r) for r in rows))
    logs = read_logs(spark, str(src))
    write_log_tiers(logs, str(tmp_path / "tiers"))
    counts = {n: spark.read.json(str(tmp_path / "tiers" / f"tier={n}")).count() for n in ("app", "error", "access")}
    assert counts == {"app": 2, "error": 1, "access": 2}
    masked = ST.mask_log_stream(logs).select("message").distinct().collect()
    assert [r.message for r in masked] == ["id 317101******0001"]


def test_results_and_traces(spark, tmp_path):
    df = spark.createDataFrame(
        [("2026-01-01", True, "a", "t", "f", '{"x":1}', None, "tr"), ("2026-01-01", False, "b", "t", "f", None, "bad", "tr"), ("2026-01-02", False, "c", "t", "f", None, "bad", None)],
        "request_date string, success boolean, request_id string, document_type string, filename string, data string, error string, trace string",
    ).selectExpr("*", "case when success then 200 else 422 end as status_code", "cast(null as string) as detail", "'USD' as currency", "null as price_date", "'0' as estimate_cost", "'0' as known_cost", "true as complete")
    write_results(df, str(tmp_path / "res"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "res")).collect()]
    assert {d["request_id"]: d.get("detail") for d in lines} == {"a": None, "b": "Extraction failed: bad", "c": "Extraction failed: bad"}
    write_traces(df, str(tmp_path / "tr"))
    assert [r.request_id for r in spark.read.json(str(tmp_path / "tr")).collect()] == ["b"]
    write_traces(df, str(tmp_path / "tr2"), keep_trace=True)
    assert spark.read.json(str(tmp_path / "tr2")).count() == 3


def test_binary_values_are_named_by_size(spark):
    df = spark.createDataFrame([(b"abc",)], "b binary").select(F.struct("b").alias("s"))
    assert printable(df, "s").first().s.b == "<3 bytes binary data>"
