"""Tasks that stay as small however large a table is."""

from pyspark.sql import functions as F

from docmill.functions.payload import repair_object
from docmill.operators import cascade
from docmill.operators.sizing import dealt, key_tasks, spread
from docmill.plans.retries import ask
from docmill.queries import common, tries  # noqa: F401

SF_DIR = "/root/testdata/sf0.001"


def sizes(df):
    return [len(p) for p in df.rdd.glom().collect()]


def test_spread(spark):
    """Rows count, not partitions: many partitions of which one holds all rows are no spread."""
    cores = spark.sparkContext.defaultParallelism
    lopsided = spark.range(4000, numPartitions=3 * cores).filter("id >= 0").repartition(3 * cores, F.lit(1))
    assert max(sizes(lopsided)) == 4000
    assert max(sizes(spread(lopsided))) < 4000
    assert max(sizes(spread(spark.range(4000, numPartitions=cores), 100))) <= 150
    even = spark.range(4000, numPartitions=cores)
    assert spread(even) is even


def test_keys_are_dealt_by_rows(spark):
    df = spark.range(4000)
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert key_tasks(df) == usual and key_tasks(df, 100) == 40
    assert dealt(df, usual, "id") is df
    assert dealt(df, 40, "id").groupBy("id").count().rdd.getNumPartitions() == 40


def test_choice_in_many_tasks_is_the_same(spark):
    rows = [(i, i % 3 > 0, s, f"{s} {i}", (i * 7 + n) % 10 / 10.0, None) for i in range(300) for n, s in enumerate(cascade.PIPELINE)]
    df = spark.createDataFrame(rows, "doc_id long, is_pdf boolean, stage string, text string, confidence double, error string")
    for choose in (cascade.choose_text, cascade.choose_two_stage):
        few, many = choose(df), choose(df, tasks=31)
        assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) and few.columns == many.columns
        assert many.rdd.getNumPartitions() == 31
    assert cascade.unresolved(df, df, tasks=31).count() == cascade.unresolved(df, df).count()


def test_replies_are_parsed_before_they_are_kept(spark):
    saved = []

    def save(df, name):
        saved.append(df.columns)
        return df.cache()

    prompts = spark.createDataFrame([(1, "s", "u", "{}")], "request_id long, system_prompt string, user_prompt string, response_schema string")
    call = lambda df: df.selectExpr("*", "'{}' as payload", "false as failed", "0 as status_code", "'{}' as usage", "'openai' as provider_style", "'x' as service", "'y' as model")
    answers, _ = ask(prompts, call, save)
    assert all("error" in c for c in saved) and [r.error for r in answers.collect()] == [None]


def test_records_are_not_computed_again_by_a_filter(spark):
    plan = common.QUERIES["licence_payloads"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") < 20 and len(plan) < 100_000


def test_repair_reads_its_text_once(spark):
    texts = [None, "", "  ", "{}", " {\"a\": 1} ", "[{}]", "{} {}", "{}]", "{}],[{}", "```json\n{\"a\":2}\n```", "see {\"a\":3} there", "1", "\"x\"", "null", "{\"a\":", "}{"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string").select("i", repair_object(F.col("c")).alias("v"))
    got = {r.i: r.s for r in df.select("i", F.to_json("v").alias("s")).collect()}
    assert got == dict.fromkeys(range(len(texts))) | {3: "{}", 4: '{"a":1}', 5: "{}", 7: "{}", 9: '{"a":2}', 10: '{"a":3}'}
