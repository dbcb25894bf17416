"""The registered queries and the pipeline."""

import json
from collections import Counter, defaultdict

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
import corpus_pipeline
from docmill.llm import decontaminate, exact, jaccard, language, packing
from docmill.llm import queries as Q

COLUMNS = {
    "op1_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op2_toxicity": "doc_id held_out score predicted",
    "op3_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op4_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op5_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op6_benchmark_decontamination": "doc_id contaminated item_ids",
    "op7_language_id": "doc_id held_out lang_pred score",
    "op8_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op9_ngram_jaccard_join": "doc_id n_shingles component_id",
    "op10_html_extraction": "page_id url text n_chars",
    "op11_filter_interaction_audit": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    "op12_sentencepiece": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op13_periodic_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
}


def test_all_are_registered():
    assert set(Q.queries()) == set(COLUMNS) and set(Q.oracles()) <= set(COLUMNS)
    assert set(COLUMNS) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, sf_dir, name):
    found = Q.queries()[name](spark, sf_dir)
    assert found.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()
    table = spark.read.parquet(f"{sf_dir}/{'pages' if name.startswith('op10') else 'documents'}.parquet")
    assert found.count() >= table.count()
    if sql := Q.oracles().get(name):
        assert compare(found, connect(sf_dir), sql) == ""


def test_stages(spark, sf_dir, tmp_path):
    """Every stage keeps what its operator says of its own input, with all columns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        assert out.columns == columns and out.exceptAll(docs).count() == 0
        kept[name] = (Counter(r.doc_id for r in docs.collect()), Counter(r.doc_id for r in out.collect()), docs)
        docs = out
    before, after, table = kept["language ID"]
    rejected = {r.doc_id for r in language.predict(table, language.fit(table)).collect() if r.rejected}
    assert after == Counter({i: n for i, n in before.items() if i not in rejected})
    before, after, table = kept["exact dedup"]
    last = {}
    for r in table.collect():
        last[r.text] = max(r.doc_id, last.get(r.text, -1))
    assert sorted(after) == sorted(last.values())
    before, after, table = kept["n-gram Jaccard join"]
    assert set(after) == {r.component_id for r in jaccard.jaccard_classes(table).collect()}
    before, after, table = kept["benchmark decontamination"]
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert set(before) - set(after) == {r.doc_id for r in decontaminate.find_leaks(table, items).collect() if r.contaminated}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(after)
    assert json.dumps(sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)) == json.dumps(
        sorted((r.doc_id, r.piece, r.ids_crc32) for r in packing.tokenized_pieces(docs).collect())
    )
    assert exact.exact_groups(docs).where("not kept").count() == 0
    whole = defaultdict(int)
    for r in packed:
        whole[r.sequence_id] += r.length
    assert max(whole.values()) <= 4096


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]


def test_stages_on_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_stages_with_clashing_columns(spark, sf_dir):
    """The user's columns come through unchanged, also those named like the stages' own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).cache()
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    own = plain.selectExpr("*", *(f"concat(doc_id, '{c}') as {c}" for c in ("_row", "_sha", "_kept_id", "_kept_sha", "key", "score", "__3")), "'x' as doc_ID")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found, want = stage(spark, own, sf_dir), stage(spark, plain, sf_dir)
        assert found.columns == own.columns
        rows = [tuple(r) for r in found.collect()]
        assert Counter(r[0] for r in rows) == Counter(r.doc_id for r in want.collect())
        assert all(r[5:] == (*(f"{r[0]}{c}" for c in ("_row", "_sha", "_kept_id", "_kept_sha", "key", "score", "__3")), "x") for r in rows)


def test_rows_without_id_stay(spark, sf_dir):
    """A clean text without an id stays; one that is equal or near to another, or leaked, goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(0)
    near = " ".join(f"near{i}" for i in range(80))
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(1, "equal text here"), (None, "equal text here"), (None, "lone text here"), (None, "lone text here"), (2, near), (None, f"{near} end"), (None, f"Before. {item} After.")]
    docs = spark.createDataFrame(rows, docs.schema)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, sf_dir)
    assert Counter((r.doc_id, r.text) for r in docs.collect()) == Counter([(1, "equal text here"), (None, "lone text here"), (2, near)])
