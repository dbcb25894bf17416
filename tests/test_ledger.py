"""Tables written together by micro-batches that die in the middle and are run again."""

import uuid

import pytest
from pyspark.sql import functions as F

from docmill.sinks.ledger import Ledger, Table, result_tables, tier_table
from docmill.streaming.jobs import start_per_batch

ROW = "id long, request_date string, success boolean, request_id string, document_type string, filename string, data string, error string, trace string"
COST = ["case when success then 200 else 422 end as status_code", "cast(null as string) as detail", "'USD' as currency", "null as price_date", "'0' as estimate_cost", "'0' as known_cost", "true as complete"]


@pytest.fixture()
def stream(spark, tmp_path):
    path = f"{tmp_path}/in"
    for k in range(4):
        rows = [(i, f"2026-01-0{i % 3 + 1}", i % 2 == 0, f"r{i}", "t", "f", '{"x":1}', None if i % 2 == 0 else "bad", "tr") for i in range(10 * k, 10 * k + 10)]
        spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(path).selectExpr("*", *COST)


class Dies(Exception):
    pass


def test_each_row_once_over_failures(spark, tmp_path, stream):
    root, name = f"{tmp_path}/out", f"l{uuid.uuid4().hex}"
    deaths = {("traces", 1), ("after", 2), ("results", 3)}

    class Fragile(Ledger):
        now = None

        def write(self, batch, batch_id):
            self.now = batch_id
            super().write(batch, batch_id)
            if ("after", batch_id) in deaths:  # the entry is written, the stream's own commit is not
                deaths.discard(("after", batch_id))
                raise Dies("after")

    def dying(table, build):
        def rows(df):
            if (table, ledger.now) in deaths:
                deaths.discard((table, ledger.now))
                if table == "results":  # half of a folder is there
                    build(df).limit(3).write.mode("overwrite").parquet(f"{root}/{table}/batch={ledger.now}")
                raise Dies(table)
            return build(df)

        return rows

    ledger = Fragile(spark, root, {n: Table(dying(n, t.rows), t.by) for n, t in result_tables().items()})
    for _ in range(4):
        query = start_per_batch(stream, name, ledger.write, f"{tmp_path}/check")
        try:
            query.awaitTermination()
        except Exception:
            if ledger.finished() == [0]:  # died between the two tables
                assert ledger.leftovers() == {"results": [1], "traces": []}
                assert ledger.read("results").count() == 10
    assert not deaths and ledger.finished() == [0, 1, 2, 3] and ledger.leftovers() == {"results": [], "traces": []}
    results = ledger.read("results")
    assert sorted(r.request_id for r in results.collect()) == sorted(f"r{i}" for i in range(40))
    assert sorted(r.request_id for r in ledger.read("traces").collect()) == sorted(f"r{i}" for i in range(1, 40, 2))
    assert results.where("request_date = '2026-01-01' and batch = 0").count() == 4


def test_replay_and_empty_batches(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/out", tier_table())
    with pytest.raises(ValueError):
        ledger.read("logs")
    logs = spark.createDataFrame([("2026-01-02T03:04:05", "INFO", "x", "m"), ("2026-01-02T03:04:05", "ERROR", "x", "m")], "timestamp string, level string, logger string, message string")
    ledger.write(logs, 0)
    ledger.write(logs, 0)
    ledger.write(logs.limit(0), 5)
    assert ledger.finished() == [0, 5]
    found = {r["tier"]: r["n"] for r in ledger.read("logs").groupBy("tier").agg(F.count("*").alias("n")).collect()}
    assert found == {"app": 2, "error": 1}  # an error stands in both
