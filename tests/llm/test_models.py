"""Language ID and toxicity: held-out accuracy, and the cases without data."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from docmill.llm import language, toxicity
from docmill.llm import queries as Q

LABELLED = "/root/testdata/sf0.01"


def test_language_accuracy(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{LABELLED}/documents.parquet").select("doc_id", "lang").collect()}
    rows = Q.op7_language_id(spark, LABELLED).collect()
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.rejected for r in rows) < 0.01 * len(rows)


def test_language_odd(odd, odd_rows, none, documents):
    model = language.fit(documents[1])
    got = language.predict(odd, model).collect()
    assert len(got) == len(odd_rows)
    unknown = {r.doc_id for r in got if r.lang_pred == "und"}
    assert unknown == {1, 2, 3, 10} and all(r.score == 0 and r.rejected for r in got if r.doc_id in unknown)
    kept = language.accepted(odd, model)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.rejected}
    assert language.predict(none, model).count() == 0
    empty = language.fit(none)
    assert {r.lang_pred for r in language.predict(odd, empty).collect()} == {"und"} and language.accepted(odd, empty).count() == 0


def test_language_ties_and_other_labels(spark):
    rows = [(i, "lorem ipsum dolor", n) for i, n in enumerate(["b", "a"] * 10)] + [(40 + i, "xyz", "zz-Unusual") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.predict(df, language.fit(df)).collect()}
    assert {got[i] for i in range(20)} == {"a"} and got[41] == "zz-Unusual"


def test_toxicity_accuracy(spark, sf_dir):
    rows = Q.op2_toxicity(spark, LABELLED).collect()
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LABELLED}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{LABELLED}/documents.parquet").count()
    # 40 toxic training texts in four languages; on a tenfold table the area is over 0.98
    held = [(r.score, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    s, y = np.array(held).T
    auc = (s[y == 1][:, None] > s[y == 0][None]).mean()
    assert auc > 0.8 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_toxicity_odd(spark, odd, odd_rows, none, documents):
    labels = documents[1].select("doc_id", (F.col("doc_id") % 7 == 0).cast("int").alias("toxic"))
    odd_labels = labels.limit(30).union(spark.createDataFrame([(None, 1), (3, None), (-1, 1)], "doc_id long, toxic int"))
    model = toxicity.fit(documents[1], odd_labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(odd_rows) and len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert toxicity.score(none, model).count() == 0
    zero = toxicity.fit(documents[1], labels.where("toxic > 5"))
    assert max(r.score for r in toxicity.score(odd, zero).collect()) < 1e-6
    only = toxicity.fit(documents[1], labels.where("toxic = 1"))
    assert min(r.score for r in toxicity.score(odd, only).collect()) > 0.99
    assert toxicity.score(odd, toxicity.fit(none, labels)).count() == len(odd_rows)


def test_toxicity_learns_a_word(spark):
    rng = np.random.default_rng(4)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("na", "so", "vi", "da")]
    rows = []
    for i in range(600):
        w = [words[k] for k in rng.integers(0, len(words), 30)]
        if i % 6 == 0:
            w[int(rng.integers(30))] = "Blorf"
        rows.append((i, " ".join(w), int(i % 6 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.where("doc_id < 400"), df.where("doc_id < 400").select("doc_id", "toxic"))
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert all((got[i] >= 0.3) == bool(t) for i, _, t in rows if i >= 400)
