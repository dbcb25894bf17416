"""Operators on small tables with known answers."""

import random
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from docmill.functions.payload import repair_object
from docmill.functions.rounding import round_exact
from docmill.operators import assembly as A
from docmill.operators import gates as G
from docmill.operators.cascade import choose_text, choose_two_stage
from docmill.operators.cost import plain_decimal, price_events, summarize_requests
from docmill.operators.dispatch import extract_mixed, payloads_mixed, type_payloads
from docmill.operators.prompts import prompt_templates, render_prompts, request_rows, retry_prompts, visual_requests
from docmill.plans import jobs, registry
from docmill.plans.base import DocSpec, strings
from docmill.queries.costs import prices
from docmill.sources import files as S
from docmill.sources.pricing import model_rates, price_date, rate_violations, read_price_file, unit_rates
from docmill.functions import dates as D
from pyspark.sql import types as T


def test_rounding_equals_exact_rounding(spark):
    rng = random.Random(3)
    values = [k / 2000 for k in range(0, 4000)] + [rng.random() for _ in range(4000)] + [0.8125, 2.675, 2.0005, 0.0005]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (2, 3):
        got = [r.r for r in df.select(round_exact(F.col("v"), digits).alias("r")).collect()]
        assert got == [round(v, digits) for v in values]


DATES = [
    ("2020-02-31", "2020-02-31"), ("31-02-2020", "2020-02-31"), ("1/2/2020", "2020-02-01"), ("05.11.1999 x", "1999-11-05"),
    ("22 Oktober 2021", "2021-10-22"), ("10 MAA/MAR 1965", "1965-03-10"), ("3 Sept. 2001", "2001-09-03"),
    ("7 Xyz 2001", None), ("SEUMUR HIDUP", None), ("1/1/2001 then 2002-03-04", "2002-03-04"), (None, None), ("", None),
]


def test_iso_dates(spark):
    df = spark.createDataFrame(DATES, "raw string, want string")
    rows = df.select("raw", "want", D.iso_date(F.col("raw")).alias("got")).collect()
    assert [(r.raw, r.got) for r in rows] == DATES


def test_payload_repair(spark):
    cases = [
        ('{"a":1}', "1"), ('{"a":1} {"a":2}', None), ('x {"a":3} y', "3"), ('```json\n{"a":4}\n```', "4"),
        ('```\n{"a":\n```\ntext\n```\n5}\n```', "5"), ("[1]", None), ("", None), (None, None), ('"text"', None), ("{", None),
    ]
    df = spark.createDataFrame(cases, "t string, want string")
    rows = df.select("want", F.try_variant_get(repair_object(F.col("t")), "$.a", "string").alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_payload_defaults_and_wrong_kinds(spark):
    spec = registry.get("identity_card")
    rows = ['{"holder_name":"A"}', '{"holder_nationality":null,"document_expiry_date":null}', '{"holder_name":5}', "no"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(rows)], "id int, payload string")
    out = {r.id: r for r in type_payloads(df, spec).collect()}
    assert (out[0].record.holder_nationality, out[0].record.document_expiry_date) == ("WNI", "SEUMUR HIDUP")
    assert (out[1].record.holder_nationality, out[1].record.document_expiry_date) == (None, None)
    assert out[2].record is None and out[2].error == "Invalid fields: holder_name"
    assert out[3].error == "Response is not a valid JSON object"


def test_nested_licences(spark):
    payload = (
        '{"business_number":"NIB: 1234567890123","business_fields":[{"field_code":"46206","field_licenses":'
        '[{"license_type":"- Izin","license_status":"• Terbit","license_remarks":"-"}]},{"field_code":"1"}]}'
    )
    df = spark.createDataFrame([(payload,)], "payload string")
    rec = type_payloads(df, registry.get("business_identification_number")).first().record
    assert rec.business_number == "1234567890123"
    assert tuple(rec.business_fields[0].field_licenses[0]) == ("Izin", "Terbit", None)
    assert rec.business_fields[1].field_licenses is None


def test_mixed_payloads(spark):
    df = spark.createDataFrame(
        [(1, "bank_account", '{"account_number":"No. Rekening : 1-2"}'), (2, "recipe", "{}"), (3, "tax_number", "")],
        "id int, document_type string, payload string",
    )
    out = {r.id: r for r in payloads_mixed(df).collect()}
    assert '"account_number":"1-2"' in out[1].data and out[1].error is None
    assert out[2].error == "Unknown document type" and out[3].error == "Empty response"


def test_prices_and_summaries(spark, tmp_path):
    path = tmp_path / "prices.json"
    path.write_text(
        '{"effective_date":"2026-01-01","llm_rates":{"a":{"m":{"tiers":['
        '{"max_input_tokens":32000,"input_usd_per_million_tokens":"0.030","output_usd_per_million_tokens":"0.130","cached_input_usd_per_million_tokens":"0.006"},'
        '{"max_input_tokens":256000,"input_usd_per_million_tokens":"0.100","output_usd_per_million_tokens":"0.400","cached_input_usd_per_million_tokens":"0.020"}]}}},'
        '"ocr_rates":{"v":{"f":{"usd_per_thousand_units":"1.50"}}}}'
    )
    book = read_price_file(spark, str(path))
    rates, units = model_rates(book), unit_rates(book)
    assert rate_violations(rates).count() == 0
    events = spark.createDataFrame(
        [
            (1, "llm", "a", "m", None, 40000, 1000, 10000, None), (1, "ocr", "v", None, "f", None, None, None, 2),
            (2, "llm", "a", "m", None, 0, 0, 0, None), (2, "llm", "a", "m", None, 256001, 0, 0, None),
            (3, "llm", "a", "m", None, 5, 1, 9, None), (4, "llm", "a", "m", None, None, 1, 0, None),
        ],
        "request_id int, kind string, service string, model string, feature string, input_tokens bigint, output_tokens bigint, cached_input_tokens bigint, units bigint",
    )
    for bound in (100, 0):  # with and without broadcast
        priced = price_events(events, rates, units, max_broadcast_rows=bound)
        got = [(r.request_id, r.c, r.unpriced_reason) for r in priced.select("request_id", plain_decimal(F.col("estimate_cost")).alias("c"), "unpriced_reason").collect()]
        assert sorted(got, key=str) == sorted(
            [(1, "0.0036", None), (1, "0.003", None), (2, "0", None), (2, None, "rate_unavailable"), (3, None, "invalid_usage"), (4, None, "usage_unavailable")],
            key=str,
        )
    free = price_events(events, model_rates(read_price_file(spark, "")), unit_rates(read_price_file(spark, "")))
    assert {r.unpriced_reason for r in free.collect()} == {"usage_unavailable", "rate_unavailable"}
    assert (price_date(book), price_date(read_price_file(spark, ""))) == ("2026-01-01", None)
    requests = spark.createDataFrame([(1,), (2,), (9,)], "request_id int")
    out = {r.request_id: r for r in summarize_requests(priced, requests).collect()}
    assert (out[1].estimate_cost, out[1].complete) == (Decimal("0.006600000000"), True)
    assert (out[2].estimate_cost, out[2].complete) == (None, False)
    assert (out[9].known_cost, out[9].complete) == (0, True)


def test_plain_decimal(spark):
    values = ["0", "0.000000000001", "12.500000000000", "100", "3"]
    df = spark.createDataFrame([(Decimal(v),) for v in values], "d decimal(38,12)")
    assert [r[0] for r in df.select(plain_decimal(F.col("d"))).collect()] == ["0", "0.000000000001", "12.5", "100", "3"]


def test_assembly_against_python(spark):
    rng = random.Random(5)
    docs = {d: [rng.choice(["", "  ", "x" * rng.randint(1, 60), "?!", "ab é 1"]) for _ in range(rng.randint(1, 700))] for d in range(12)}
    rows = [(d, i + 1, t) for d, pages in docs.items() for i, t in enumerate(pages)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, S.PAGES)
    got = {r.doc_id: r for r in A.assemble_digital(df).collect()}
    scores = {r.doc_id: r.confidence for r in A.score_digital(df).collect()}
    for d, pages in docs.items():
        text = "\n\n".join(f"--- Page {i} ---\n{t.strip()}" for i, t in enumerate(pages, 1) if t.strip())
        n = len(text)
        if n < 25:
            want = round(n / 50, 3)
        else:
            want = 0.85 + min(0.15, n / (len(pages) * 200.0) * 0.15)
            if sum(c.isalnum() for c in text) / n < 0.4:
                want *= 0.5
            want = round(want, 3)
        assert (got[d].text, got[d].character_count, got[d].page_count) == (text, n, len(pages))
        assert got[d].confidence == scores[d] == want


def test_recognised_lines_and_words(spark):
    lines = [(1, 1, 2, "b", "0.5"), (1, 1, 1, " a ", "0.7"), (1, 1, 3, "c", "bad"), (1, 1, 4, "", "0.1"), (1, 2, 1, "z", None)]
    df = spark.createDataFrame(lines, S.OCR_LINES)
    pages = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "doc_id bigint, page int")
    got = {r.page: (r.text, r.confidence) for r in A.score_ocr_lines(df, pages).collect()}
    assert got == {1: ("a\nb\nc", 0.6), 2: ("z", 0.8), 3: ("", 0.0)}
    words = [(1, 1, ["a", " ", "b"], ["90", "95", "-1"]), (2, 1, ["x"], ["-1"]), (3, 1, [" "], ["50"])]
    got = {r.doc_id: (r.text, r.confidence) for r in A.score_ocr_words(spark.createDataFrame(words, S.OCR_WORDS)).collect()}
    assert got == {1: ("a b", 0.9), 2: ("x", 0.75), 3: ("", 0.0)}
    assert S.explode_words(spark.createDataFrame(words, S.OCR_WORDS)).count() == 5


def test_cascade(spark):
    rows = [
        (1, True, "digital_pdf", "", 0.0, None), (1, True, "ocr", "o", 0.25, None), (1, True, "visual_llm", "v", 0.9, None),
        (2, True, "digital_pdf", "d", 0.9, None), (2, True, "ocr", "o", 0.99, None),
        (3, False, "digital_pdf", "d", 0.9, None), (3, False, "ocr", "o", 0.3, None), (3, False, "visual_llm", "v", 0.3, None),
        (4, True, "ocr", None, None, "boom"),
    ]
    df = spark.createDataFrame(rows, "doc_id int, is_pdf boolean, stage string, text string, confidence double, error string")
    got = {r.doc_id: r for r in choose_text(df).collect()}
    assert [got[i].stage for i in (1, 2, 3, 4)] == ["visual_llm", "digital_pdf", "ocr", None]
    assert len(got[2].attempts) == 1 and got[4].attempts[0].error == "boom" and got[4].error
    two = {r.doc_id: r for r in choose_two_stage(df).collect()}
    assert (two[1].stage, two[1].confidence, two[2].stage) == ("ocr", 0.25, "digital_pdf")
    assert two[4].error == "OCR extraction failed: boom"


def test_stages_run_on_unsettled_documents_only(spark, tmp_path):
    def source(stage, confidence):
        def fn(batches):
            for b in batches:
                yield b.assign(stage=stage, text=b["content"].str.decode("utf8"), confidence=confidence(b["doc_id"]), error=None)[
                    ["doc_id", "is_pdf", "stage", "text", "confidence", "error"]
                ]

        return fn

    jobs.register_extractor("ocr", jobs.batch_extractor(source("ocr", lambda d: (d % 2) * 0.9)))
    jobs.register_extractor("visual_llm", jobs.batch_extractor(source("visual_llm", lambda d: d * 0 + 0.9), prepare=lambda c: c))
    docs = spark.createDataFrame([(i, False, f"t{i}".encode()) for i in range(6)], "doc_id bigint, is_pdf boolean, content binary")

    save = jobs.stage_tables(spark, f"run_{uuid.uuid4().hex}", str(tmp_path))
    done = jobs.run_stages(docs, ["ocr", "visual_llm"], save)
    assert {(r.doc_id, r.stage) for r in done.filter("stage = 'visual_llm'").collect()} == {(i, "visual_llm") for i in (0, 2, 4)}
    jobs.EXTRACTORS.clear()


def test_gates(spark):
    m = spark.createDataFrame(
        [(1, "b", 1, "x.pdf", "identity_card", 10), (2, "b", 2, "x.pdf", "nope", 10), (3, "b", 3, "y", "bank_account", 16 * 2**20), (4, "c", 1, "z", "bank_account", 0)],
        "doc_id int, batch_id string, ord int, filename string, document_type string, size_bytes bigint",
    )
    types = registry.document_types(spark)
    got = {r.doc_id: r.status_code for r in G.gate_files(m, types).collect()}
    assert got == {1: None, 2: 404, 3: 413, 4: 422}
    assert {r.status_code for r in G.gate_files(m, types, valid_pricing=False).filter("doc_id = 1").collect()} == {500}
    assert [r.batch_id for r in G.oversized_batches(m, 2).collect()] == ["b"]
    gated = {r.doc_id: r.status_code for r in G.gate_batches(G.gate_files(m, types), 2).collect()}
    assert gated == {1: 413, 2: 413, 3: 413, 4: 422}


def test_files_join_manifest(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"hello")
    files = S.read_files(spark, str(tmp_path))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_bytes(b"other")
    files = files.union(S.read_files(spark, str(tmp_path / "sub")))
    paths = [f"file:{tmp_path}/{n}" for n in ("a.txt", "sub/a.txt", "b.txt")]
    manifest = spark.createDataFrame([(p, "bank_account") for p in paths], "path string, document_type string")
    got = {r.path: (r.size_bytes, r.content and bytes(r.content)) for r in S.join_manifest(files, manifest).collect()}
    assert got == {paths[0]: (5, b"hello"), paths[1]: (5, b"other"), paths[2]: (None, None)}
    with pytest.raises(ValueError):
        S.join_manifest(files.drop("path"), manifest)


def test_registry_extension(spark):
    spec = DocSpec(
        slug="memo", name="Memo", description="d", schema=T.StructType(strings("subject")),
        parse=lambda t: [{"subject": F.regexp_extract(t.body, "(?m)^Re: (.*)$", 1)}], normalize=lambda raw: {},
    )
    silent = DocSpec(slug="photo", name="Photo", description="d", schema=T.StructType(strings("a")), normalize=lambda raw: {})
    registry.register(spec)
    registry.register(silent)
    try:
        df = spark.createDataFrame([("memo", "Re: hi\nx"), ("photo", "x"), ("memo", " ")], "document_type string, text string")
        got = {(r.document_type, r.text): (r.data, r.error) for r in extract_mixed(df).collect()}
    finally:
        registry.unregister("memo")
        registry.unregister("photo")
    assert got == {
        ("memo", "Re: hi\nx"): ('{"subject":"hi"}', None),
        ("photo", "x"): (None, "String parsing is not implemented for document type photo"),
        ("memo", " "): (None, "Empty text provided for analysis"),
    }
    assert registry.document_types(spark).count() == 11
    assert registry.document_fields(spark).filter("description is null").count() == 0


def test_prompts(spark):
    df = spark.createDataFrame([("identity_card", " Nama : X \n", [b"img"])], "document_type string, text string, pages array<binary>")
    row = request_rows(render_prompts(df), "pages").first()
    assert row.user_prompt.endswith("```text\nNama : X\n```")
    assert '"images":["aW1n"]' in row.request
    retry = retry_prompts(render_prompts(df).withColumn("parsed", F.lit(None).cast("string")), "parsed").first()
    assert "JSON Schema" in retry.user_prompt and "holder_name" in retry.user_prompt
    seen = visual_requests(df.unionByName(df.withColumn("pages", F.array().cast("array<binary>"))), "pages")
    assert sorted(str(r.error) for r in seen.collect()) == ["No valid image data provided", "None"]
    for t in prompt_templates(spark).collect():
        assert all(f in t.system_prompt for f in registry.get(t.document_type).schema.fieldNames())


@pytest.mark.parametrize("bound", [0, 10])
def test_price_list_size_check(spark, bound):
    from docmill.operators.sizing import small_side

    hinted = "broadcast" in small_side(model_rates(prices(spark)), bound)._jdf.queryExecution().logical().toString().lower()
    assert hinted == (bound == 10)
