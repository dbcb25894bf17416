"""Two-phase choice of texts, prices by date over edge cases, and second tries."""

from datetime import datetime

from pyspark.sql import functions as F

from docmill.operators.cascade import NO_TEXT, choose_text, choose_two_stage
from docmill.operators.rate_history import price_by_date, with_list
from docmill.plans.retries import ask
from docmill.queries.tries import price_lists
from docmill.sources.pricing import model_rates, unit_rates

ATTEMPT = "doc_id long, is_pdf boolean, stage string, text string, confidence double, error string"
ATTEMPTS = [
    (1, True, "digital_pdf", "a", 0.9, None), (1, True, "ocr", "b", 0.95, None),
    (2, True, "digital_pdf", "low", 0.2, None), (2, True, "ocr", "better", 0.4, None), (2, True, "visual_llm", " ", 0.9, None),
    (3, False, "digital_pdf", "not read", 0.9, None), (3, False, "ocr", None, None, "broken"),
    (4, True, "ocr", "same", 0.8, None), (4, True, "ocr", "same", 0.8, None), (4, True, "ocr", "worse", 0.6, None),
    (5, True, "other", "x", 0.9, None), (6, True, "digital_pdf", "tie", 0.3, None), (6, True, "ocr", "later", 0.3, None),
    (7, True, "ocr", "no score", None, None),
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_choice(spark):
    df = spark.createDataFrame(ATTEMPTS, ATTEMPT)
    chosen = choose_text(df)
    assert "SortAggregate" not in plan(chosen)
    rows = {r.doc_id: r for r in chosen.collect()}
    assert chosen.count() == len(rows) == 7
    assert {i: (r.stage, r.text, r.accepted) for i, r in rows.items()} == {
        1: ("digital_pdf", "a", True), 2: ("ocr", "better", False), 3: (None, "", False), 4: ("ocr", "same", True), 5: (None, "", False),
        6: ("digital_pdf", "tie", False), 7: ("ocr", "no score", False),
    }
    assert rows[3].error == rows[5].error == NO_TEXT and rows[1].error is None
    assert [a.stage for a in rows[1].attempts] == ["digital_pdf"] and [a.stage for a in rows[2].attempts] == ["digital_pdf", "ocr", "visual_llm"]
    assert [(a.stage, a.error, a.accepted) for a in rows[3].attempts] == [("ocr", "broken", None)]
    assert [(a.confidence, a.text_length) for a in rows[4].attempts] == [(0.8, 4)]


def test_two_stage_choice(spark):
    df = spark.createDataFrame(ATTEMPTS, ATTEMPT)
    chosen = choose_two_stage(df)
    assert "SortAggregate" not in plan(chosen)
    rows = {r.doc_id: r for r in chosen.collect()}
    assert {i: (r.stage, r.text) for i, r in rows.items()} == {
        1: ("digital_pdf", "a"), 2: ("ocr", "better"), 3: (None, ""), 4: ("ocr", "same"), 5: (None, ""), 6: ("ocr", "later"), 7: ("ocr", "no score")
    }
    assert rows[2].fallback_reason == "confidence (0.2) < threshold (0.5)" and rows[3].error == "OCR extraction failed: broken"
    assert rows[3].fallback_reason == "file is not digital pdf" and rows[5].error == "OCR extraction failed: no result"


def test_prices_by_date(spark):
    lists = price_lists(spark)
    times = ["2024-01-01 23:59:59", "2024-01-02 00:00:00", "2024-01-05 05:59:59", "2024-01-05 06:00:00", "2024-01-05 18:30:00", "2024-01-19 23:59:59", "2024-06-01 00:00:00", None]
    rows = [(i, t and datetime.fromisoformat(t), "llm", "beta", "dated", None, 1_000_000, 0, 0, None) for i, t in enumerate(times)]
    events = spark.createDataFrame(rows, "id int, event_time timestamp, kind string, service string, model string, feature string, input_tokens long, output_tokens long, cached_input_tokens long, units long")
    for bound in (1 << 20, 0):  # by broadcast, and by shuffle
        priced = price_by_date(events, lists, model_rates(lists, dated=True), unit_rates(lists, dated=True), max_broadcast_rows=bound)
        got = [(r.estimate_cost and float(r.estimate_cost), r.unpriced_reason) for r in priced.orderBy("id").collect()]
        none = (None, "rate_unavailable")
        assert got == [none, (1.5, None), (1.5, None), (2.25, None), (3.0, None), (3.0, None), none, none]
    assert with_list(events, lists.limit(0)).where("price_list is not null").count() == 0


def test_second_tries(spark):
    """A failed call is not asked again; a reply that never parses is asked for ``tries`` times and keeps its error."""
    prompts = spark.createDataFrame([(i, "s", "u", "{}") for i in range(3)], "request_id long, system_prompt string, user_prompt string, response_schema string")
    asked = []

    def call(df):
        asked.append(sorted(r.request_id for r in df.collect()))
        return df.selectExpr(
            "*", "case request_id when 0 then '{\"a\":1}' when 1 then '[]' end as payload", "request_id = 2 as failed", "if(request_id = 2, 500, null) as status_code",
            "'{\"prompt_tokens\":3,\"completion_tokens\":1}' as usage", "'openai' as provider_style", "'x' as service", "'y' as model",
        )

    answers, usage = ask(prompts, call, lambda df, name: df.cache(), tries=3)
    assert asked == [[0, 1, 2], [1], [1]]
    assert {r.request_id: (r.tries, r.error) for r in answers.collect()} == {
        0: (1, None), 1: (3, "Response is not a valid JSON object"), 2: (1, "Model call failed")
    }
    assert {r.request_id: r.n for r in usage.groupBy("request_id").agg(F.count("*").alias("n")).collect()} == {0: 1, 1: 3, 2: 1}
