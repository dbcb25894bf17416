"""Streamed cost summaries equal the batch job on shuffled, late and repeated events, over restarts."""

import random
import uuid
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docmill.operators.cost import price_events, summarize_requests
from docmill.queries.costs import prices
from docmill.sources.pricing import model_rates, unit_rates
from docmill.streaming import costs as SC
from docmill.streaming.jobs import start

EVENT = (
    "event_id long, request_id long, event_time timestamp, kind string, service string, model string, feature string, input_tokens long, "
    "output_tokens long, cached_input_tokens long, units long"
)
DAY = datetime(2026, 1, 2)


@pytest.fixture(autouse=True)
def store(spark):
    names = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")
    before = {n: spark.conf.get(n) for n in names}
    SC.use_state_store(spark)
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def events(rng, n=300):
    out = []
    for i in range(n):
        request = 0 if rng.random() < 0.3 else rng.randrange(1, 40)  # one hot request
        at = DAY + timedelta(seconds=rng.randrange(3600))
        if i % 5 == 0:
            out.append((i, request, at, "ocr", "scan", None, "page_text", None, None, None, None if i % 25 == 0 else i % 7))
        else:
            out.append((i, request, at, "llm", "alpha", rng.choice(["small", "plain", "none"]), None, rng.randrange(9000), rng.randrange(2000), 0, None))
    return out


def in_order(spark, rows, path, files):
    """Files of the stream, one micro-batch each, in the order of their names."""
    size = -(-len(rows) // files)
    for k in range(files):
        part = spark.createDataFrame(rows[k * size : (k + 1) * size], EVENT)
        part.coalesce(1).write.mode("append").parquet(path)


def run(spark, path, out, check, split=1):
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(path)
    book = prices(spark)
    parts = SC.request_cost_parts(stream, model_rates(book), unit_rates(book), timedelta(minutes=70), timedelta(minutes=5), split)
    query = start(parts, check.replace("/", "_"), out, check)
    query.awaitTermination()
    return query


def summary(df):
    return {r.request_id: (r.known_cost, r.complete, r.estimate_cost) for r in df.collect()}


@pytest.mark.parametrize("split", [1, 3])
def test_stream_equals_batch(spark, tmp_path, split):
    rng = random.Random(split)
    rows = events(rng)
    book = prices(spark)
    table = spark.createDataFrame(rows, EVENT)
    batch = summarize_requests(price_events(table, model_rates(book), unit_rates(book)))
    copies = rng.sample(rows, 60)
    sent = rows + copies
    rng.shuffle(sent)  # up to an hour late, inside the lateness
    src, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", f"check-{uuid.uuid4().hex}"))
    in_order(spark, sent[:200], src, 2)
    run(spark, src, out, check, split)
    in_order(spark, sent[200:], src, 2)  # more events after a stop
    run(spark, src, out, check, split)
    # a later event moves the watermark past everything
    in_order(spark, [(10_000, 999, DAY + timedelta(days=1), "ocr", "scan", None, "page_text", None, None, None, 1)], src, 1)
    run(spark, src, out, check, split)
    parts = spark.read.parquet(out)
    merged = SC.merge_parts(parts)
    assert summary(merged) == summary(batch)
    assert merged.agg(F.sum("events")).first()[0] == len(rows)
    if split > 1:
        assert merged.where("request_id = 0").first().parts == split


def test_event_after_closing_leaves_a_part(spark, tmp_path):
    src, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", f"check-{uuid.uuid4().hex}"))
    unit = lambda i, request, minutes: (i, request, DAY + timedelta(minutes=minutes), "ocr", "scan", None, "page_text", None, None, None, 4)
    for rows in ([unit(1, 7, 0)], [unit(2, 8, 120)], [unit(3, 7, 100)], [unit(4, 9, 400)], [unit(1, 7, 0), unit(5, 9, 900)]):  # the copy comes behind the watermark
        in_order(spark, rows, src, 1)
        run(spark, src, out, check, 1)
    parts = spark.read.parquet(out)
    assert Counter(r.request_id for r in parts.collect())[7] == 2
    seven = SC.merge_parts(parts).where("request_id = 7").first()
    assert (float(seven.known_cost), seven.parts, seven.events) == (0.01, 2, 2)


def test_batches_close_by_files_or_time(spark, tmp_path):
    src, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", f"check-{uuid.uuid4().hex}"))
    schema = "batch_id string, file_id int, expected_files int, success boolean, known_cost decimal(38,18), complete boolean, event_time timestamp"
    rows = [("full", k, 3, k != 1, "0.5", True, DAY + timedelta(minutes=k)) for k in (0, 1, 1, 2)] + [("short", 0, 2, True, "0.25", False, DAY), ("end", 0, 9, True, "0", True, DAY + timedelta(days=1))]
    for r in rows:
        spark.createDataFrame([r], "batch_id string, file_id int, expected_files int, success boolean, known_cost string, complete boolean, event_time timestamp").withColumn(
            "known_cost", F.col("known_cost").cast("decimal(38,18)")
        ).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    start(SC.batch_cost_stream(stream), check.replace("/", "_"), out, check).awaitTermination()
    found = {r.batch_id: (r.total_files, r.succeeded, float(r.known_cost), r.complete, r.closed_by) for r in spark.read.parquet(out).collect()}
    assert found == {"full": (3, 2, 1.5, True, "files"), "short": (1, 1, 0.25, False, "time")}
