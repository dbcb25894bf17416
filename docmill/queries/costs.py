"""Usage events, prices and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.cost import plain_decimal, price_events, summarize_batches, summarize_requests
from docmill.operators.usage import model_usage, unit_usage
from docmill.queries.common import query, table
from docmill.sources.pricing import PRICE_FILE, model_rates, rate_violations, unit_rates, unit_violations

PRICE_DATE = "2026-01-15"
# A small price list of our own: one flat rate, one without cached price, one in three tiers.
PRICES = """
{"effective_date": "2026-01-15",
 "llm_rates": {
   "alpha": {"small": {"input_usd_per_million_tokens": "0.25", "output_usd_per_million_tokens": "1.75",
                       "cached_input_usd_per_million_tokens": "0.025"},
             "plain": {"input_usd_per_million_tokens": "1.10", "output_usd_per_million_tokens": "4.40"}},
   "beta": {"stepped": {"tiers": [
       {"max_input_tokens": 3000, "input_usd_per_million_tokens": "0.040", "output_usd_per_million_tokens": "0.150", "cached_input_usd_per_million_tokens": "0.004"},
       {"max_input_tokens": 6000, "input_usd_per_million_tokens": "0.110", "output_usd_per_million_tokens": "0.420", "cached_input_usd_per_million_tokens": "0.011"},
       {"max_input_tokens": 9000, "input_usd_per_million_tokens": "0.210", "output_usd_per_million_tokens": "0.830", "cached_input_usd_per_million_tokens": "0.021"}]}}},
 "ocr_rates": {"scan": {"page_text": {"usd_per_thousand_units": "1.25"}}}}
"""


def prices(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(PRICES,)], "value string")
    return rows.select(F.from_json("value", PRICE_FILE).alias("p")).select("p.*")


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a call: model calls and, on each fifth, a recognition call."""
    ocr = "event_id % 5 = 0"
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "user_id as request_id",
        "user_id % 200 as batch_id",
        f"case when {ocr} then 'ocr' else 'llm' end as kind",
        f"case when {ocr} then 'scan' when event_id % 3 = 0 then 'beta' else 'alpha' end as service",
        f"case when {ocr} then null when event_id % 19 = 0 then 'unknown' when event_id % 3 = 0 then 'stepped' "
        "when event_id % 3 = 1 then 'small' else 'plain' end as model",
        f"case when {ocr} then case when event_id % 35 = 0 then 'other' else 'page_text' end end as feature",
        f"case when not {ocr} and event_id % 17 <> 0 then event_id * 31 % 10000 end as input_tokens",
        f"case when not {ocr} then event_id * 7 % 2000 end as output_tokens",
        f"case when not {ocr} then case when event_id % 23 = 0 then 20000 when event_id % 4 = 0 then 100 else 0 end end as cached_input_tokens",
        f"case when {ocr} and event_id % 25 <> 0 then event_id % 40 end as units",
    )


# Costs as whole numbers of 1e-12 USD.
_EVENTS_SQL = """
e as (
  select event_id, user_id as request_id, user_id % 200 as batch_id, event_id % 5 = 0 as ocr,
    case when event_id % 17 <> 0 then event_id * 31 % 10000 end as i, event_id * 7 % 2000 as o,
    case when event_id % 23 = 0 then 20000 when event_id % 4 = 0 then 100 else 0 end as c,
    case when event_id % 25 <> 0 then event_id % 40 end as u, event_id % 3 as m, event_id % 19 = 0 as odd,
    event_id % 35 = 0 as other from events),
r as (
  select *, case when odd then null when m = 1 then 250000 when m = 2 then 1100000
      when i <= 3000 then 40000 when i <= 6000 then 110000 when i <= 9000 then 210000 end as ri,
    case when m = 1 then 1750000 when m = 2 then 4400000
      when i <= 3000 then 150000 when i <= 6000 then 420000 when i <= 9000 then 830000 end as ro,
    case when m = 1 then 25000 when m = 2 then null
      when i <= 3000 then 4000 when i <= 6000 then 11000 when i <= 9000 then 21000 end as rc from e),
w as (
  select *, case when ocr then case when u is null then 'usage_unavailable' when other then 'rate_unavailable' end
      when i is null then 'usage_unavailable' when ri is null then 'rate_unavailable'
      when c <> 0 and rc is null then 'cached_rate_unavailable' when i < c then 'invalid_usage' end as reason from r),
x as (
  select *, case when reason is null then case when ocr then cast(u as hugeint) * 1250000000
      else cast(i - c as hugeint) * ri + cast(c as hugeint) * coalesce(rc, 0) + cast(o as hugeint) * ro end end as pico from w)
"""


def decimal_sql(x: str) -> str:
    """Plain decimal text of a count of 1e-12."""
    return (
        f"(case when {x} is null then null else cast({x} // 1000000000000 as varchar) || "
        f"rtrim(rtrim('.' || lpad(cast({x} % 1000000000000 as varchar), 12, '0'), '0'), '.') end)"
    )


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = prices(spark)
    return price_events(usage_events(spark, sf_dir), model_rates(book), unit_rates(book))


@query(
    "model_cost_items",
    f"with {_EVENTS_SQL} select event_id, case when ocr then 'ocr' else 'llm' end as kind, {decimal_sql('pico')} as estimate_cost, reason as unpriced_reason from x",
)
def model_cost_items(spark, sf_dir):
    return _priced(spark, sf_dir).select(
        "event_id", "kind", plain_decimal(F.col("estimate_cost")).alias("estimate_cost"), "unpriced_reason"
    )


@query(
    "unpriced_reasons",
    f"with {_EVENTS_SQL} select case when ocr then 'scan' when m = 0 then 'beta' else 'alpha' end as service, reason as unpriced_reason, count(*) as n from x group by 1, 2",
)
def unpriced_reasons(spark, sf_dir):
    return _priced(spark, sf_dir).groupBy("service", "unpriced_reason").agg(F.count("*").alias("n"))


_REQUESTS_SQL = f"""
{_EVENTS_SQL},
q as (
  select s.request_id, s.batch_id, coalesce(sum(pico), 0) as known, coalesce(bool_and(pico is not null) filter (where x.event_id is not null), true) as complete
  from (select c_custkey as request_id, case when c_custkey % 3 = 0 then c_custkey // 21 else 1000000 + c_custkey // 4 end as batch_id from customer) s
  left join x on x.request_id = s.request_id group by 1, 2)
"""


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "estimate_cost": plain_decimal(F.col("estimate_cost")),
            "known_cost": plain_decimal(F.col("known_cost")),
            "price_date": F.col("price_date").cast("string"),
        }
    )


def _request_costs(spark, sf_dir):
    requests = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"))
    return summarize_requests(_priced(spark, sf_dir), requests, PRICE_DATE)


@query(
    "request_costs",
    f"""
with {_REQUESTS_SQL}
select request_id, 'USD' as currency, '{PRICE_DATE}' as price_date, case when complete then {decimal_sql('known')} end as estimate_cost,
  {decimal_sql('known')} as known_cost, complete from q
""",
)
def request_costs(spark, sf_dir):
    return _shown(_request_costs(spark, sf_dir))


@query(
    "batch_cost",
    f"""
with {_REQUESTS_SQL},
b as (
  select batch_id, count(*) > 5 as over, count(*) as total_files, count(*) filter (where request_id % 9 <> 0) as good, sum(known) as sum_known, bool_and(complete) as all_complete
  from q group by batch_id),
c as (
  select *, case when over then 0 else good end as succeeded, case when over then 0 else total_files - good end as failed,
    case when over then 0 else sum_known end as known, over or all_complete as complete from b)
select batch_id, cast(case when over then 413 else 200 end as int) as status_code, case when over then 'Batch exceeds 5 files' end as detail,
  not over and succeeded = total_files as success, total_files, succeeded, failed,
  'USD' as currency, '{PRICE_DATE}' as price_date, case when complete then {decimal_sql('known')} end as estimate_cost,
  {decimal_sql('known')} as known_cost, complete from c
""",
)
def batch_cost(spark, sf_dir):
    results = _request_costs(spark, sf_dir).selectExpr(
        "*",
        "case when request_id % 3 = 0 then request_id div 21 else 1000000 + request_id div 4 end as batch_id",
        "request_id % 9 <> 0 as success",
    )
    return _shown(summarize_batches(results, PRICE_DATE))


@query(
    "tier_lookup",
    """
select event_id, event_id * 31 % 12000 as input_tokens, case when event_id * 31 % 12000 <= 3000 then '0.04'
  when event_id * 31 % 12000 <= 6000 then '0.11' when event_id * 31 % 12000 <= 9000 then '0.21' end as input_rate
from events
""",
)
def tier_lookup(spark, sf_dir):
    events = table(spark, sf_dir, "events").selectExpr(
        "event_id", "'llm' as kind", "'beta' as service", "'stepped' as model", "cast(null as string) as feature",
        "event_id * 31 % 12000 as input_tokens", "1000000L as output_tokens", "0L as cached_input_tokens",
        "cast(null as bigint) as units",
    )
    # a rate list with output price 0 and input price per token shows the chosen tier as the cost
    rates = model_rates(prices(spark)).withColumns(
        {"output_rate": F.col("input_rate"), "input_rate": F.lit(0).cast("decimal(20,12)")}
    )
    priced = price_events(events, rates, unit_rates(prices(spark)))
    return priced.select("event_id", "input_tokens", plain_decimal(F.col("estimate_cost")).alias("input_rate"))


_LIST = "p_partkey div 5"  # five neighbouring parts stand for the tiers of one model


@query(
    "rate_list_check",
    """
with t as (
  select 's' || p_partkey // 5 % 7 as service, 'm' || p_partkey // 5 as model, p_partkey % 5 as tier,
    (p_size - 3) * 1000 as max_input_tokens, p_partkey % 50 - 2 as rate,
    case p_partkey % 17 when 3 then 'rate_invalid' when 4 then 'rate_invalid' when 5 then 'rate_missing' when 6 then 'rate_invalid' end as odd from part),
l as (select *, lag(max_input_tokens) over (partition by service, model order by tier) as low from t)
select service, model, tier, case when max_input_tokens <= 0 then 'limit_not_positive'
    when low is not null and not (max_input_tokens > low) then 'limits_not_increasing'
    when odd is not null then odd when rate < 0 then 'rate_negative' end as problem
from l where max_input_tokens <= 0 or (low is not null and not (max_input_tokens > low)) or odd is not null or rate < 0
""",
)
def rate_list_check(spark, sf_dir):
    tier = (
        "named_struct('max_input_tokens', cast((p_size - 3) * 1000 as bigint), 'input_usd_per_million_tokens', "
        "case p_partkey % 17 when 3 then 'NaN' when 4 then 'abc' when 5 then null when 6 then '0.0000000000001' else cast(p_partkey % 50 - 2 as string) end, "
        "'output_usd_per_million_tokens', '1', 'cached_input_usd_per_million_tokens', cast(null as string))"
    )
    listed = (
        table(spark, sf_dir, "part")
        .groupBy(F.expr(_LIST).alias("n"))
        .agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.expr(tier).alias("tier")))).alias("tiers"))
        .selectExpr(
            "'2026-01-15' as effective_date",
            "map(concat('s', n % 7), map(concat('m', n), named_struct('input_usd_per_million_tokens', cast(null as string), "
            "'output_usd_per_million_tokens', cast(null as string), 'cached_input_usd_per_million_tokens', cast(null as string), "
            "'tiers', transform(tiers, t -> t.tier)))) as llm_rates",
        )
    )
    return rate_violations(model_rates(listed)).selectExpr("service", "model", "cast(tier as bigint) as tier", "problem")


@query(
    "unit_rate_check",
    """
select s, f, case when p_partkey % 13 = 1 then 'rate_invalid' when p_partkey % 13 = 2 then 'rate_missing' when p_partkey % 13 = 3 then 'rate_negative' end as problem
from (select p_partkey, 's' || p_partkey % 7 as s, 'f' || p_partkey as f from part) where p_partkey % 13 in (1, 2, 3)
""",
)
def unit_rate_check(spark, sf_dir):
    listed = table(spark, sf_dir, "part").selectExpr(
        "'2026-01-15' as effective_date",
        "map(concat('s', p_partkey % 7), map(concat('f', p_partkey), named_struct('usd_per_thousand_units', "
        "case p_partkey % 13 when 1 then 'free' when 2 then null when 3 then '-1' else '0.0000001' end))) as ocr_rates",
    )
    return unit_violations(unit_rates(listed)).selectExpr("service as s", "feature as f", "problem")


@query(
    "small_rates",
    f"select event_id, {decimal_sql('cast(event_id * 31 % 12000 as hugeint)')} as estimate_cost from events",
)
def small_rates(spark, sf_dir):
    """A price of 0.000001 per million tokens is kept to the last digit."""
    rate = '{"input_usd_per_million_tokens": "0.000001", "output_usd_per_million_tokens": "0.0000001"}'
    listed = F.from_json(F.lit(f'{{"llm_rates": {{"beta": {{"tiny": {rate}}}}}, "ocr_rates": {{}}}}'), PRICE_FILE)
    book = spark.range(1).select(listed.alias("p")).select("p.*")
    events = table(spark, sf_dir, "events").selectExpr(
        "event_id", "'llm' as kind", "concat('bet', 'a') as service", "'tiny' as model", "cast(null as string) as feature",
        "event_id * 31 % 12000 as input_tokens", "0L as output_tokens", "0L as cached_input_tokens", "cast(null as bigint) as units",
    )
    priced = price_events(events, model_rates(book), unit_rates(book))
    return priced.select("event_id", plain_decimal(F.col("estimate_cost")).alias("estimate_cost"))


# --- provider responses --------------------------------------------------------------------------


@query(
    "usage_normalise",
    """
with k as (
  select event_id, event_id % 2 = 0 as google, event_id % 10 = 3 or event_id % 10 = 4 as failed,
    case when event_id % 30 in (3, 4) then null when event_id % 30 < 15 then 404 else 503 end as status from events where event_id % 4 <> 3),
s as (select * from k where not failed or google or status is null or status >= 500)
select event_id as request_id, 'llm' as kind, case when google then 'g' else 'o' end as service,
  case when failed or event_id % 9 = 0 then null when google then event_id % 1000 + 5 else event_id % 1000 end as input_tokens,
  case when failed or event_id % 9 = 0 then null when google then event_id % 300 + 2 else event_id % 300 end as output_tokens,
  cast(case when failed or event_id % 9 = 0 then 0 when event_id % 6 in (0, 1) then 7 else 0 end as bigint) as cached_input_tokens,
  cast(null as bigint) as units from s
union all
select event_id, 'ocr', 'google_vision', null, null, null, case when event_id % 5 <> 0 then 1 end from events where event_id % 4 = 3
""",
)
def usage_normalise(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    openai = (
        "concat('{\"prompt_tokens\":', event_id % 1000, ',\"completion_tokens\":', event_id % 300, "
        "case when event_id % 6 = 1 then ',\"prompt_tokens_details\":{\"cached_tokens\":7}' else '' end, '}')"
    )
    google = (
        "concat('{\"prompt_token_count\":', event_id % 1000, ',\"tool_use_prompt_token_count\":5,\"candidates_token_count\":', "
        "event_id % 300, ',\"thoughts_token_count\":2', case when event_id % 6 = 0 then ',\"cached_content_token_count\":7' else '' end, '}')"
    )
    calls = events.filter("event_id % 4 <> 3").selectExpr(
        "event_id as request_id",
        "case when event_id % 2 = 0 then 'google' else 'openai' end as provider_style",
        "case when event_id % 2 = 0 then 'g' else 'o' end as service",
        "'m' as model",
        "event_id % 10 in (3, 4) as failed",
        "case when event_id % 30 in (3, 4) then null when event_id % 30 < 15 then 404 else 503 end as status_code",
        f"case when event_id % 9 = 0 then null when event_id % 2 = 0 then {google} else {openai} end as usage",
    )
    scans = events.filter("event_id % 4 = 3").selectExpr("event_id as request_id", "event_id % 5 = 0 as failed")
    both = model_usage(calls).unionByName(unit_usage(scans))
    return both.drop("model", "feature")
