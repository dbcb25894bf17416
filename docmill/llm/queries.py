"""The registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import decontaminate, exact, filters, html, jaccard, language, lm, packing, pieces, repeats, runs, token_counts, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.find_repeats(_table(spark, sf_dir, "documents"), window=50, block=25)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = _table(spark, sf_dir, "documents"), language.held_out(F.col("doc_id"), 4, 2)
    model = toxicity.fit(docs.where(~fold), _table(spark, sf_dir, "labels").where(~fold))
    found = toxicity.score(docs, model)
    return found.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), 4096)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), 1024)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = _table(spark, sf_dir, "documents"), language.held_out(F.col("doc_id"), 4, 2)
    found = language.predict(docs, language.fit(docs.where(~fold)))
    return found.select("doc_id", fold.alias("held_out"), "lang_pred", "score", "rejected")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = _table(spark, sf_dir, "documents"), language.held_out(F.col("doc_id"), 5, 1)
    return lm.score_texts(docs, docs.where(~fold), fold)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_classes(_table(spark, sf_dir, "documents"), n=5)
    return found.select("doc_id", "n_shingles", "component_id")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main(_table(spark, sf_dir, "pages"))


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode_texts(_table(spark, sf_dir, "documents"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(_table(spark, sf_dir, "documents"), least=6, times=4, source=runs.planted)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    every = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = [F.col(f"longest.{c}").alias(c) for c in ("start", "length", "period")]
    times = F.expr("(1000 * longest.length) div longest.period").alias("exponent_milli")
    digests = [F.sha2(every, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")]
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, times, *digests)


OP3 = """
with d as (select doc_id, coalesce(text, '') as text from documents),
g as (select text, max(doc_id) as keep_id, count(*) as group_size from d group by text)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.text) as text_sha256
from d join g on d.text = g.text
"""

OP11 = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
first as (select text, min(doc_id) as low from d group by text),
l as (select doc_id, max(cast(quality = 1 as int)) as good, max(cast(toxic = 1 as int)) as toxic from labels group by doc_id),
w as (
    select d.*, list_filter(string_split_regex(d.text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
        coalesce(d.doc_id > first.low, false) as copy, coalesce(l.good, 0) as good, coalesce(l.toxic, 0) as toxic
    from d join first on d.text = first.text left join l on d.doc_id = l.doc_id
),
f as (
    select part, good, toxic, len(words) < 200 as a, 100 * len(list_distinct(words)) < 50 * len(words) as b,
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) as c, regexp_matches(text, '[#$%&*|]') as d, copy as e
    from w
),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
    select p.x || q.x || r.x || s.x || t.x as filter_order from letters p, letters q, letters r, letters s, letters t
    where len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
),
kinds as (
    select part, good, toxic, a, b, c, d, e, count(*) as n, list_filter(
        ['A', 'B', 'C', 'D', 'E'], lambda x, i: [a, b, c, d, e][i]) as failed
    from f group by all
),
steps as (
    select k.*, o.filter_order, s.step, o.filter_order[s.step] as filter,
        coalesce(list_min(list_transform(k.failed, lambda x: instr(o.filter_order, x))), 99) as gone
    from kinds k, orders o, (select unnest([1, 2, 3, 4, 5]) as step) s
),
counts as (
    select part, filter_order, step, any_value(filter) as filter,
        coalesce(sum(n) filter (gone > step), 0) as kept, coalesce(sum(n) filter (gone = step), 0) as removed,
        coalesce(sum(n) filter (gone < step and list_contains(failed, filter)), 0) as redundant,
        coalesce(sum(n) filter (failed = [filter]), 0) as unique_fails,
        coalesce(sum(n * good) filter (gone = step), 0) as good_lost, coalesce(sum(n * toxic) filter (gone = step), 0) as toxic_lost
    from steps group by part, filter_order, step
)
select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
    cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
    cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, filter) as bigint) as shapley
from counts
"""


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracles() -> dict[str, str]:
    return {"op3_exact_dedup": OP3, "op11_filter_interaction_audit": OP11}
