"""The whole path: gates, choice of text, extraction, cost, status."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from docmill.operators.cost import plain_decimal
from docmill.plans.jobs import extract_corpus, typed_tables
from docmill.queries.common import code, query
from docmill.queries.costs import _EVENTS_SQL, PRICE_DATE, decimal_sql, prices, usage_events
from docmill.queries.records import AS_OF, mixed_texts
from docmill.sources.pricing import model_rates, unit_rates

_K = "c_custkey"


@query(
    "corpus_results",
    f"""
with {_EVENTS_SQL},
t as (select request_id, sum(pico) as known, bool_and(pico is not null) as complete from x group by request_id),
s as (
  select *, case when {_K} % 31 = 0 then 404 when {_K} % 17 = 16 then 413 when {_K} % 17 = 0 or {_K} % 29 = 0 then 422 else 200 end as code
  from customer left join t on t.request_id = {_K})
select {_K} as doc_id, cast(code as int) as status_code, code = 200 as success,
  case when code = 404 then 'Unknown document_type: ''recipe''' when code = 413 then 'File exceeds maximum allowed size of 15MB'
    when code = 422 then case when {_K} % 17 = 0 then 'Empty file provided for extraction'
      else 'No readable text could be extracted by any extractor in the pipeline' end end as error,
  case when code = 200 then case when {_K} % 6 = 0 then 'digital_pdf' when {_K} % 5 = 0 then 'visual_llm' else 'ocr' end end as stage,
  case when code = 200 then
    case {_K} % 4
      when 0 then case when {_K} % 10 not in (2, 7) then {code(_K)} end
      when 1 then 'PT ' || {code(_K)}
      when 2 then case when {_K} % 5 = 0 then 'PT ' || {code(_K)} else {code(_K)} end
      else {code(_K)} end end as party,
  coalesce({decimal_sql('known')}, '0') as known_cost, coalesce(complete, true) as complete
from s
""",
)
def corpus_results(spark, sf_dir):
    texts = mixed_texts(spark, sf_dir)
    manifest = texts.selectExpr(
        "doc_id", "doc_id as request_id", "document_type", "doc_id % 17 * 1000000 as size_bytes"
    )
    # digital text of every third file, a PDF, is good enough if the key is even; that of other files is no attempt
    stages = [F.lit(x) for x in ("digital_pdf", "ocr", "visual_llm")]
    found = F.explode(F.when(F.col("doc_id") % 5 == 0, F.array(*stages)).otherwise(F.array(*stages[:2])))
    attempts = texts.select("doc_id", "text", found.alias("stage")).selectExpr(
        "doc_id",
        "doc_id % 3 = 0 as is_pdf",
        "stage",
        "text",
        "case when stage = 'digital_pdf' then case when doc_id % 2 = 0 then 0.95D else 0.2D end when stage = 'visual_llm' then 0.9D when doc_id % 5 = 0 then 0.4D else 0.8D end as confidence",
        "cast(null as string) as error",
    )
    book = prices(spark)
    rows = extract_corpus(
        manifest, attempts, usage_events(spark, sf_dir), model_rates(book), unit_rates(book), PRICE_DATE,
        as_of=F.lit(AS_OF), save=typed_tables(spark, f"corpus-results-{uuid.uuid4().hex}", tempfile.gettempdir()),
    )
    names = ["holder_name", "business_name", "account_holder", "holder_full_name"]
    ok = F.col("success")
    return rows.select(
        "doc_id",
        "status_code",
        "success",
        "error",
        F.when(ok, F.col("stage")).alias("stage"),
        F.when(ok, F.coalesce(*[F.get_json_object("data", f"$.{n}") for n in names])).alias("party"),
        plain_decimal(F.col("known_cost")).alias("known_cost"),
        "complete",
    )
