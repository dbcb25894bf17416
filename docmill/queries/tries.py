"""Second tries of model calls, prices by date, and operators that plug in: repairs, nested payloads, new types and sources."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.cleaning import id_digits, repair_digits, tax_id
from docmill.operators.cost import plain_decimal, price_events, summarize_requests
from docmill.operators.dispatch import extract_mixed, extract_type, type_payloads
from docmill.operators.prompts import render_prompts
from docmill.operators.rate_history import price_by_date
from docmill.plans import jobs, registry
from docmill.plans.base import DocSpec, strings
from docmill.plans.retries import ask
from docmill.queries.common import code, lines, padded, query, spread_table, table
from docmill.queries.costs import decimal_sql, prices
from docmill.sources.pricing import PRICE_FILE, model_rates, unit_rates

_K = "c_custkey"


def _tables(spark, name: str, kind=jobs.stage_tables):
    return kind(spark, f"{name}-{uuid.uuid4().hex}", tempfile.gettempdir())


# --- second tries --------------------------------------------------------------------------------

# One in four replies is broken at first and good when asked again, one in four never parses, one in 24 calls fails.
_BROKEN, _NEVER, _FAILED, _LOCAL = f"{_K} % 4 = 0", f"{_K} % 4 = 2", f"{_K} % 24 = 3", f"{_K} % 10 = 9"


def model_call(requests):
    """A stand-in for a model: its replies and token counts depend on the key and on whether the schema was written out."""
    again = F.contains("user_prompt", F.lit("JSON Schema")) & F.get_json_object("request", "$.schema").isNotNull()
    key = F.col("request_id")
    on = {c: F.expr(c.replace(_K, "request_id")) for c in (_BROKEN, _NEVER, _FAILED, _LOCAL)}
    good = F.concat(F.lit('```json\n{"account_holder":"'), F.expr(code("request_id")), F.lit('"}\n```'))
    bad = F.concat(F.lit('{"account_holder":"'), F.expr(code("request_id")))
    usage = F.format_string('{"prompt_tokens":%d,"completion_tokens":%d}', key % 1000 + F.when(again, 500).otherwise(0), key % 300)
    return requests.select(
        *requests.columns,
        F.when(~on[_FAILED], F.when(on[_NEVER] | (on[_BROKEN] & ~again), bad).otherwise(good)).alias("payload"),
        on[_FAILED].alias("failed"),
        F.when(on[_FAILED], F.when(key % 48 == 3, 503).otherwise(404)).alias("status_code"),
        usage.alias("usage"),
        F.when(on[_LOCAL], F.lit("ollama")).otherwise(F.lit("openai")).alias("provider_style"),
        F.lit("alpha").alias("service"),
        F.lit("small").alias("model"),
    )


@query(
    "second_tries",
    f"""
with k as (
  select {_K} as request_id, {_FAILED} as failed, {_NEVER} as never, {_BROKEN} or {_NEVER} as twice, {_LOCAL} as is_local, {code(_K)} as holder,
    {_K} % 1000 as i, {_K} % 300 as o from customer),
c as (
  select *, case when is_local or (failed and request_id % 48 <> 3) then 0 when twice then 2 else 1 end as calls,
    not failed or is_local or request_id % 48 <> 3 as complete,
    case when is_local or failed then 0 else cast(i * 250000 + o * 1750000 as hugeint) * case when twice then 2 else 1 end + case when twice then 125000000 else 0 end end as known
  from k)
select request_id, cast(case when twice then 2 else 1 end as int) as tries,
  case when failed then 'Model call failed' when never then 'Response is not a valid JSON object' end as error,
  case when not failed and not never then holder end as holder, calls, {decimal_sql('known')} as known_cost, complete
from c
""",
)
def second_tries(spark, sf_dir):
    texts = spread_table(spark, sf_dir, "customer", _K, "c_name").selectExpr(f"{_K} as request_id", "'bank_account' as document_type", "concat('Name : ', c_name) as text")
    prompts = render_prompts(texts).select("request_id", "document_type", "system_prompt", "user_prompt", "response_schema")
    answers, usage = ask(prompts, model_call, _tables(spark, "second-tries"))
    book = prices(spark)
    cost = summarize_requests(price_events(usage, model_rates(book), unit_rates(book)), texts)
    calls = usage.groupBy("request_id").agg(F.count("*").alias("calls"))
    typed = type_payloads(answers.withColumnRenamed("error", "call_error"), registry.get("bank_account"))
    rows = typed.join(cost, "request_id").join(calls, "request_id", "left")
    return rows.select(
        "request_id", "tries", F.col("call_error").alias("error"), F.when(F.col("call_error").isNull(), F.col("record.account_holder")).alias("holder"),
        F.coalesce("calls", F.lit(0)).cast("int").alias("calls"), plain_decimal(F.col("known_cost")).alias("known_cost"), "complete",
    )


# --- prices by date ------------------------------------------------------------------------------

# Price lists of one model and one unit: when they take effect, price per million tokens (input = output) and per thousand units.
LISTS = (
    ("2024-01-02 00:00:00", "1.5", "10"), ("2024-01-05 06:00:00", "2.25", None), ("2024-01-05 18:30:00", "3", "12"), ("2024-01-20 00:00:00", None, "7"),
)


def price_lists(spark):
    def listed(at, tokens, units):
        rate = f'{{"input_usd_per_million_tokens": "{tokens}", "output_usd_per_million_tokens": "{tokens}"}}'
        models = f'"beta": {{"dated": {rate}}}' if tokens else ""
        scans = f'"scan": {{"page_text": {{"usd_per_thousand_units": "{units}"}}}}' if units else ""
        return (f'{{"effective_date": "{at}", "llm_rates": {{{models}}}, "ocr_rates": {{{scans}}}}}',)

    rows = spark.createDataFrame([listed(*x) for x in LISTS], "value string")
    return rows.select(F.from_json("value", PRICE_FILE).alias("p")).select("p.*")


_LISTS_SQL = ", ".join(
    f"(timestamp '{at}', {'null' if t is None else int(float(t) * 1_000_000)}, {'null' if u is None else int(float(u) * 1_000_000_000)})" for at, t, u in LISTS
)


@query(
    "prices_by_date",
    f"""
with l(starts, per_token, per_unit) as (values {_LISTS_SQL}),
e as (select event_id, ts, event_id % 4 = 0 as ocr, event_id * 31 % 9000 as i, event_id * 7 % 2000 as o, event_id % 40 as u from events),
j as (select e.*, l.starts, l.per_token, l.per_unit from e asof left join l on e.ts >= l.starts),
p as (select *, case when ocr then cast(u as hugeint) * per_unit else cast(i + o as hugeint) * per_token end as pico from j)
select event_id, strftime(starts, '%Y-%m-%d %H:%M:%S') as price_list, {decimal_sql('pico')} as estimate_cost,
  case when pico is null then 'rate_unavailable' end as unpriced_reason
from p
""",
)
def prices_by_date(spark, sf_dir):
    events = table(spark, sf_dir, "events").selectExpr(
        "event_id", "ts as event_time", "case when event_id % 4 = 0 then 'ocr' else 'llm' end as kind", "case when event_id % 4 = 0 then 'scan' else 'beta' end as service",
        "case when event_id % 4 <> 0 then 'dated' end as model", "case when event_id % 4 = 0 then 'page_text' end as feature",
        "case when event_id % 4 <> 0 then event_id * 31 % 9000 end as input_tokens", "case when event_id % 4 <> 0 then event_id * 7 % 2000 end as output_tokens",
        "0L as cached_input_tokens", "case when event_id % 4 = 0 then event_id % 40 end as units",
    )
    lists = price_lists(spark)
    priced = price_by_date(events, lists, model_rates(lists, dated=True), unit_rates(lists, dated=True))
    return priced.select(
        "event_id", F.date_format("price_list", "yyyy-MM-dd HH:mm:ss").alias("price_list"), plain_decimal(F.col("estimate_cost")).alias("estimate_cost"), "unpriced_reason"
    )


# --- repairs and nested payloads -----------------------------------------------------------------


@query(
    "repaired_numbers",
    f"""
select o_orderkey, {padded('o_orderkey', 16)} as repaired, {padded('o_orderkey', 16)} as digits,
  case when o_orderkey % 3 = 0 then 'NPWP ' || left({padded('o_orderkey', 16)}, 12) else {padded('o_orderkey', 15 + 1)} end as tax_number
from orders
""",
)
def repaired_numbers(spark, sf_dir):
    """Numbers that a reader has spoiled with look-alike letters and signs come back as they were."""
    number = padded("o_orderkey", 16)
    orders = spread_table(spark, sf_dir, "orders", "o_orderkey").selectExpr(
        "o_orderkey",
        f"concat('no. ', translate(translate({number}, '0158', case when o_orderkey % 2 = 0 then 'OlSB' else 'DIsB' end), '6', 'b'), ' .') as spoiled",
        f"concat(' ', translate({number}, '0', case when o_orderkey % 2 = 0 then 'O' else 'o' end), '-/') as printed",
        f"concat('NPWP ', case when o_orderkey % 3 = 0 then left({number}, 12) else {number} end) as labelled",
    )
    # the lead holds an o, which a reader of digits takes for a zero
    repaired = F.substring(repair_digits(F.col("spoiled")), 2, 16)
    return orders.select("o_orderkey", repaired.alias("repaired"), id_digits(F.col("printed")).alias("digits"), tax_id(F.col("labelled"), "NPWP").alias("tax_number"))


@query(
    "licence_payloads",
    f"""
select c_custkey as doc_id, case when c_custkey % 4 = 1 then null else 'Izin ' || {code(_K)} end as license_type,
  case when c_custkey % 4 = 2 then null else 'Terbit' end as license_status, case when c_custkey % 4 = 3 then 'R' || c_custkey end as license_remarks, 'f' || c_custkey as field_code
from customer where c_custkey % 7 <> 0
""",
)
def licence_payloads(spark, sf_dir):
    """Licences two levels deep in model responses: bullets go, a dash for remarks is null; payloads without a list have no rows."""
    licence = (
        f"concat('{{\"license_type\":\"', case {_K} % 4 when 0 then '- Izin ' when 1 then '- ' else '• Izin ' end, case {_K} % 4 when 1 then '' else {code(_K)} end, "
        f"'\",\"license_status\":\"', case {_K} % 4 when 2 then '-' else '•  Terbit ' end, '\",\"license_remarks\":\"', case {_K} % 4 when 3 then concat(' R', {_K}, ' ') when 0 then '-' else '' end, '\"}}')"
    )
    payload = (
        f"case when {_K} % 7 = 0 then '{{\"business_number\":\"1\"}}' else concat('{{\"business_fields\":[{{\"field_code\":\"f', {_K}, '\",\"field_licenses\":[', {licence}, ']}}]}}') end as payload"
    )
    rows = type_payloads(spread_table(spark, sf_dir, "customer", _K).selectExpr(f"{_K} as doc_id", payload), registry.get("business_identification_number"))
    # an inner explode would be planned with a filter on the list, which computes the record a second time
    listed = rows.select("doc_id", F.posexplode_outer("record.business_fields").alias("n", "f")).where("n is not null")
    fields = listed.select("doc_id", "f.field_code", F.posexplode_outer("f.field_licenses").alias("n", "l")).where("n is not null")
    return fields.select("doc_id", "l.license_type", "l.license_status", "l.license_remarks", "field_code")


@query(
    "card_fallbacks",
    f"""
select {_K} as doc_id, case {_K} % 3 when 0 then 'LAKI-LAKI' when 1 then 'PEREMPUAN' end as gender,
  case {_K} % 2 when 0 then 'ISLAM' else 'KATHOLIK' end as religion, 'WNI' as nationality, 'SEUMUR HIDUP' as expiry
from customer
""",
)
def card_fallbacks(spark, sf_dir):
    """Values of cards whose labels were not read come from anywhere in the text, or are the usual ones."""
    text = lines(
        f"concat('NIK : ', {padded(f'3000000000000000 + {_K}', 16)})", f"case {_K} % 3 when 0 then 'Laki-Laki' when 1 then 'Perempuan' end",
        f"case {_K} % 2 when 0 then 'x ISLAM' else 'KATOLIK' end", f"case when {_K} % 5 = 0 then 'SEUMUR HIDUP' end",
    )
    rows = spread_table(spark, sf_dir, "customer", _K).selectExpr(f"{_K} as doc_id", "'identity_card' as document_type", f"{text} as text")
    found = extract_type(rows, "identity_card").select("doc_id", "record.*")
    return found.select("doc_id", *(F.col(f"holder_{c}").alias(c) for c in ("gender", "religion", "nationality")), F.col("document_expiry_date").alias("expiry"))


# --- new types and sources -----------------------------------------------------------------------


@query(
    "new_types",
    f"""
select {_K} as doc_id, case when {_K} % 5 = 0 then null when {_K} % 2 = 0 then {code(_K)} end as subject,
  case when {_K} % 5 = 0 then 'Empty text provided for analysis' when {_K} % 2 = 1 then 'String parsing is not implemented for document type photo' end as error
from customer
""",
)
def new_types(spark, sf_dir):
    """A type registered for this query is extracted like the others; one without rules is an error row."""
    memo = DocSpec(
        slug="memo", name="Memo", description="a memo", schema=T.StructType(strings("subject")), normalize=lambda raw: {},
        parse=lambda t: [{"subject": F.regexp_extract(t.body, "(?m)^Re: (.*)$", 1)}],
    )
    photo = DocSpec(slug="photo", name="Photo", description="a photo", schema=T.StructType(strings("subject")), normalize=lambda raw: {})
    rows = spread_table(spark, sf_dir, "customer", _K).selectExpr(
        f"{_K} as doc_id", f"case when {_K} % 2 = 0 then 'memo' else 'photo' end as document_type", f"case when {_K} % 5 = 0 then ' ' else concat('Dear all\\nRe: ', {code(_K)}) end as text"
    )
    for spec in (memo, photo):
        registry.register(spec)
    try:
        return extract_mixed(rows).select("doc_id", F.get_json_object("data", "$.subject").alias("subject"), "error")
    finally:
        for spec in (memo, photo):
            registry.unregister(spec.slug)


@query(
    "new_sources",
    f"""
with d as (select {_K} as doc_id, {_K} % 2 = 0 as is_pdf, {_K} % 4 = 0 as digital_ok, {_K} % 3 = 0 as scan_ok from customer)
select doc_id, 'digital_pdf' as stage, case when digital_ok then 0.9::double else 0.25::double end as confidence, 'UPPER ' || doc_id as text from d where is_pdf
union all select doc_id, 'ocr', case when scan_ok then 0.75::double else 0.25::double end, 'UPPER ' || doc_id from d where not (is_pdf and digital_ok)
union all select doc_id, 'visual_llm', 0.5::double, 'UPPER ' || doc_id from d where not (is_pdf and digital_ok) and not scan_ok
""",
)
def new_sources(spark, sf_dir):
    """Text sources plugged in over batches of bytes, with a preprocessor; each runs on what no source before it has settled."""

    def source(stage, confidence):
        def read(batches):
            for b in batches:
                b = b.assign(stage=stage, text=[c.decode() for c in b["content"]], confidence=confidence(b["doc_id"]), error=None)
                yield b[["doc_id", "is_pdf", "stage", "text", "confidence", "error"]]

        return jobs.batch_extractor(read, prepare=lambda content: F.upper(content.cast("string")).cast("binary"))

    before = dict(jobs.EXTRACTORS)
    jobs.register_extractor("digital_pdf", source("digital_pdf", lambda i: (i % 4 == 0) * 0.65 + 0.25))
    jobs.register_extractor("ocr", source("ocr", lambda i: (i % 3 == 0) * 0.5 + 0.25))
    jobs.register_extractor("visual_llm", source("visual_llm", lambda i: i * 0 + 0.5))
    try:
        docs = table(spark, sf_dir, "customer").selectExpr(f"{_K} as doc_id", f"{_K} % 2 = 0 as is_pdf", f"cast(concat('upper ', {_K}) as binary) as content")
        found = jobs.run_stages(docs, ("digital_pdf", "ocr", "visual_llm"), _tables(spark, "new-sources"))
    finally:
        jobs.EXTRACTORS.clear()
        jobs.EXTRACTORS.update(before)
    return found.select("doc_id", "stage", "confidence", "text")
