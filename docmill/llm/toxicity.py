"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

For every hashed n-gram, all labelled training texts are counted that hold it, toxic and not.  The log of the ratio
of the two shares scales the n-gram's feature, which is present or absent; both shares are raised by ``smooth``
texts of the smaller class, so n-grams seen in few texts weigh little and unseen ones nothing.  A logistic
regression on the scaled features, fitted on a sample of labelled texts (at most about ``sample`` of either class,
chosen by a hash of the id), weighs them; its intercept is set back to the classes' true shares.

Scale: labels and texts meet once in a shuffle join; counts are added up in tasks as blocks of a table of fixed
size (2**BITS n-grams), and only n-grams with a ratio of ``least`` or more reach the driver.

Defined cases: null and empty texts have no features and score what the intercept says; an id with several labels is
toxic if one of them says so; null labels and labels without a text are not used; where one class has no text, all
texts score the share of toxic ones (about 0 without any); rows with null id are scored, never trained on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import arrays as A

BITS = 20
BLOCK = 1 << 10
SIZES = (4, 5, 6)


def features(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of each text, in order, and the text's number; only those to keep, if given."""
    chars, doc = A.characters(data, offsets, table)
    keys = []
    for n in SIZES:
        gram, of = A.ngrams(chars, doc, n, BITS)
        if keep is not None:
            at = np.flatnonzero(keep[gram])
            gram, of = gram[at], of[at]
        keys.append((of.astype(np.int64) << BITS) | gram)
    keys = np.concatenate(keys)
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]
    return keys & ((1 << BITS) - 1), keys >> BITS


class Linear:
    """Weights of the n-grams (ratio times coefficient) and the intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept


def regression(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, n_cols: int, penalty: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with a squared penalty, by Adam on all rows."""
    w, b = np.zeros(n_cols), 0.0
    m, v = np.zeros(n_cols + 1), np.zeros(n_cols + 1)
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=values * w[cols], minlength=len(y)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        grad = np.append(np.bincount(cols, weights=values * error[rows], minlength=n_cols) + penalty * w, error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def _constant(toxic: float, plain: float) -> Linear:
    """Where one class has no text: every text scores the share of toxic ones."""
    share = min(max(toxic / max(1.0, toxic + plain), 1e-9), 1 - 1e-9)
    return Linear(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, least: float = 1.0, smooth: float = 3.0) -> Linear:
    """Learn from the given texts (``doc_id, text``) and labels (``doc_id, toxic``)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    size = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    size = {1: sum(n for t, n in size.items() if t), 0: size.get(0, 0)}
    if not size[0] or not size[1]:
        return _constant(size[1], size[0])
    share = F.when(F.col("toxic") > 0, sample / size[1]).otherwise(sample / size[0])
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kind 0: counts of a block of n-grams, not toxic and toxic; kind 1: the features of a chosen text."""
        table, seen, n = A.character_table(False), np.zeros((2, 1 << BITS), np.int32), [0, 0]
        for rows, data, offsets in A.slices(batches, limit=1 << 20):
            toxic = np.array(rows.column("toxic").to_pylist()) > 0
            gram, of = features(data, offsets, table)
            for label in (0, 1):
                seen[label] += np.bincount(gram[toxic[of] == label], minlength=1 << BITS).astype(np.int32)
                n[label] += int((toxic == label).sum())
            at, out = np.append(np.searchsorted(of, np.arange(rows.num_rows)), len(of)), []
            for i in np.flatnonzero(np.array(rows.column("chosen").to_pylist(), bool)):
                out.append((1, int(toxic[i]), gram[at[i] : at[i + 1]].astype(np.int32).tobytes()))
            yield _rows(out)
        at = np.flatnonzero(seen.any(axis=0))
        out = [(0, b, A.pack(*x)) for b, x in A.by_bucket(at // BLOCK, (at % BLOCK).astype(np.uint16), seen[0][at], seen[1][at])]
        yield _rows([*out, (0, -1, A.pack(np.zeros(1, np.uint16), *np.array(n, np.int32).reshape(2, 1)))])

    # a merge join at every size: labels grow with the texts, so they are not broadcast where they happen to be few
    found = A.stored(texts.join(labels.hint("merge"), "doc_id").withColumn("chosen", chosen).select("text", "toxic", "chosen").mapInArrow(count, "kind int, block int, payload binary"))

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = np.zeros((2, BLOCK), np.int64)
        for x in table.column("payload").to_pylist():
            at, *n = A.unpack(x)
            total[:, at] += np.array(n)
        at = np.flatnonzero(total.any(axis=0))
        return pa.table({"gram": pa.array(key[0].as_py() * BLOCK + at), "plain": pa.array(total[0][at]), "toxic": pa.array(total[1][at])})

    counted = A.checkpointed(found.where("kind = 0").groupBy("block").applyInArrow(add, "gram long, plain long, toxic long"))
    plain, toxic = (float(x or 0) for x in counted.where("gram < 0").agg(F.max("plain"), F.max("toxic")).first())
    if not plain or not toxic:
        return _constant(toxic, plain)
    least_share = smooth / max(1.0, min(plain, toxic))
    ratio = F.log((F.col("toxic") / max(1.0, toxic) + least_share) / (F.col("plain") / max(1.0, plain) + least_share))
    ratios = np.zeros(1 << BITS, np.float32)
    for r in counted.where("gram >= 0").select("gram", ratio.alias("ratio")).where(F.abs("ratio") >= least).collect():
        ratios[r.gram] = r.ratio
    used = np.flatnonzero(ratios)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x, np.int32) for x in batch.column("payload").to_pylist()]
            yield pa.record_batch([batch.column("block"), pa.array([x[ratios[x] != 0].tobytes() for x in sets], pa.binary())], names=["toxic", "grams"])

    rows = found.where("kind = 1").select("block", "payload").mapInArrow(narrow, "toxic int, grams binary").collect()
    grams = [np.frombuffer(r.grams, np.int32) for r in rows]
    y = np.array([r.toxic for r in rows], float)
    row = np.repeat(np.arange(len(rows)), [len(g) for g in grams])
    cols = np.searchsorted(used, np.concatenate(grams)) if grams else np.zeros(0, int)
    if not len(rows):
        return _constant(toxic, plain)
    w, b = regression(row, cols, ratios[used][cols].astype(float), y, len(used))
    # the sample's share of toxic texts is not the corpus's
    if 0 < y.sum() < len(y):
        b += np.log(toxic / plain) - np.log(y.sum() / (len(y) - y.sum()))
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w * ratios[used]
    return Linear(weights, float(b))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
    return pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["kind", "block", "payload"])


def score(docs: DataFrame, model: Linear) -> DataFrame:
    """The probability that a text is toxic."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    at = np.flatnonzero(model.weights)
    values, intercept = model.weights[at], model.intercept

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, weights = A.character_table(False), np.zeros(1 << BITS, np.float32)
        weights[at] = values
        used = weights != 0
        for rows, data, offsets in A.slices(batches, limit=1 << 20):
            gram, of = features(data, offsets, table, used)
            z = np.bincount(of, weights=weights[gram], minlength=rows.num_rows) + intercept
            yield pa.record_batch([rows.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], names=["doc_id", "score"])

    return docs.mapInArrow(scored, "doc_id long, score double")
