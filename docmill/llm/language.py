"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed character n-grams: 1 + log of the count, times the inverse document frequency, brought
to length one.  Frequencies come from all training texts.  For every language in the labels, a sample of its
training texts (bounded by ``sample``, chosen by a hash of the id) is clustered by cosine into ``clusters``
centroids.  A text gets the language of the centroid with the largest cosine, which is its score; a cosine under
quarter of the least that a training text of the sample has with a centroid of its language is rejected as too far;
for texts of under ``FEW`` distinct n-grams, which lie far from every centroid, the bound falls with their root.

Defined cases: null texts and texts without a letter are ``und`` with score 0, and rejected; ties go to the language
that comes first by name; without any training label all texts are ``und``; rows that repeat are predicted alike;
rows with null id are predicted, never trained on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm import arrays as A

BITS = 12
SIZES = (1, 2, 3)
UNKNOWN = "und"
FEW = 100


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """The fold that nothing is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def counts(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams, a row for each text."""
    n = len(offsets) - 1
    chars, doc = A.characters(data, offsets, table)
    blank = np.append(True, chars[1:] != 32) | np.append(True, chars[:-1] != 32) if len(chars) else np.zeros(0, bool)
    chars, doc = chars[blank[: len(chars)]], doc[blank[: len(chars)]]  # runs of spaces are one
    out = np.zeros(n << BITS, np.int64)
    for k in SIZES:
        gram, of = A.ngrams(chars, doc, k, BITS)
        out += np.bincount((of.astype(np.int64) << BITS) | gram, minlength=n << BITS)
    return out.reshape(n, 1 << BITS)


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (np.log1p(found, dtype=np.float32) * idf).astype(np.float32)
    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.maximum(length, 1e-12)


def cluster(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from texts that are far apart."""
    centroids = [v.mean(axis=0)]
    near = v @ (centroids[0] / max(np.linalg.norm(centroids[0]), 1e-12))
    centroids = []
    for _ in range(min(k, len(v))):
        centroids.append(v[int(near.argmin())] if centroids else v[int(near.argmax())])
        near = np.maximum(near, v @ centroids[-1]) if len(centroids) > 1 else v @ centroids[-1]
    c = np.array(centroids)
    for _ in range(rounds):
        of = (v @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (of == j).any():
                c[j] = v[of == j].sum(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


class Centroids:
    """What has been learnt: inverse frequencies, centroids with their languages, and the least cosines."""

    def __init__(self, idf: np.ndarray, names: list[str], centroids: np.ndarray, of: np.ndarray, least: np.ndarray):
        self.idf, self.names, self.centroids, self.of, self.least = idf, names, centroids, of, least


def fit(docs: DataFrame, clusters: int = 4, sample: int = 300) -> Centroids:
    """Learn from the rows of ``doc_id, text, lang`` given."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    docs = docs.where("doc_id is not null and text is not null and lang is not null")

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = A.character_table(True), np.zeros((1 << BITS) + 1, np.int64)
        for _, data, offsets in A.slices(batches, limit=1 << 20, most_rows=512):
            seen[:-1] += (counts(data, offsets, table) > 0).sum(axis=0)
            seen[-1] += len(offsets) - 1
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(at), pa.array(seen[at])], names=["gram", "n"])

    total = docs.select("text").mapInArrow(frequency, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros((1 << BITS) + 1)
    for r in total:
        seen[r.gram] = r.n
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])).astype(np.float32) + np.float32(0.1)

    size = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}
    names = sorted(size)
    if not names:
        return Centroids(idf, [], np.zeros((0, 1 << BITS), np.float32), np.zeros(0, int), np.zeros(0))
    # texts of each language by a hash of their id, about as many as asked for
    share = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(1.2 * sample / size[n]))])
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = A.character_table(True)
        for rows, data, offsets in A.slices(batches, limit=1 << 20, most_rows=512):
            v = vectors(counts(data, offsets, table), idf).astype(np.float16)
            yield pa.record_batch([rows.column("lang"), rows.column("doc_id"), pa.array([x.tobytes() for x in v], pa.binary())], names=["lang", "doc_id", "v"])

    by: dict[str, list] = {}
    for r in chosen.select("doc_id", "text", "lang").mapInArrow(encode, "lang string, doc_id long, v binary").orderBy("doc_id").collect():
        if len(by.setdefault(r.lang, [])) < sample:
            by[r.lang].append(np.frombuffer(r.v, np.float16).astype(np.float32))
    centroids, of, least = [], [], []
    names = [n for n in names if n in by]
    for i, n in enumerate(names):
        v = np.array(by[n])
        c = cluster(v, clusters)
        centroids.append(c)
        of += [i] * len(c)
        least.append(float((v @ c.T).max(axis=1).min()))
    return Centroids(idf, names, np.concatenate(centroids), np.array(of), np.array(least))


def nearest(model: Centroids, data: np.ndarray, offsets: np.ndarray, known: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the language, score and rejection of each text; texts that are not ``known`` to hold a letter are rejected."""
    n = len(offsets) - 1
    known = known & (len(model.names) > 0)
    if not known.any():
        return np.zeros(n, int), np.zeros(n), np.ones(n, bool)
    found = counts(data, offsets, table)
    cosine = vectors(found, model.idf) @ model.centroids.T
    size = np.minimum(1, np.sqrt((found > 0).sum(axis=1) / FEW))
    of = model.of[cosine.argmax(axis=1)]
    score = np.where(known, np.clip(cosine.max(axis=1), 0, 1), 0.0)
    return of, score, ~known | (score < model.least[of] * size / 4)


LETTER = r"\p{L}"


def predict(docs: DataFrame, model: Centroids) -> DataFrame:
    """Language, score and whether the text lies too far from all centroids; other columns are not read."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("has_letter", F.coalesce(F.col("text").rlike(LETTER), F.lit(False)))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = A.character_table(True)
        for rows, data, offsets in A.slices(batches, limit=1 << 20, most_rows=512):
            known = np.array(rows.column("has_letter").to_pylist(), bool) & (len(model.names) > 0)
            of, score, far = nearest(model, data, offsets, known, table)
            lang = [model.names[i] if k else UNKNOWN for k, i in zip(known, of, strict=True)]
            yield pa.record_batch([rows.column("doc_id"), pa.array(lang, pa.string()), pa.array(score.astype(np.float64)), pa.array(far, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.mapInArrow(named, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Centroids) -> DataFrame:
    """The rows, with all their columns, whose text is in one of the languages."""
    flag = "_has_letter" + "_" * len(docs.columns)
    marked = docs.withColumn(flag, F.coalesce(F.col("text").rlike(LETTER), F.lit(False)))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = A.character_table(True)
        for rows, data, offsets in A.slices(batches, limit=1 << 20, most_rows=512):
            _, _, far = nearest(model, data, offsets, np.array(rows.column(flag).to_pylist(), bool), table)
            yield rows.drop_columns([flag]).filter(pa.array(~far))

    return marked.mapInArrow(kept, docs.schema)
