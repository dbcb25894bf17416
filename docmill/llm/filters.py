"""Audit of filters that are applied one after the other: what each removes, in every order.

A row fails some of the filters, its mask.  In an order it is removed at the first filter that it fails.  Written as
matrices: the mask matrix has 0 where a mask fails a filter and infinity elsewhere, and the inverse-permutation
matrix has the place of each filter in each order.  Their min-plus product, the minimum over the filters of the two
entries' sum, is the removal rank of every mask in every order.  So rows are first counted by part and mask, each
with its weights; then ranks and orders decide where every count goes: a scatter of weighted counts over (order,
rank) gives what is removed at each step, and of each mask's failing filters those that come after its rank are
redundant.

Rows are read once, into one narrow row per text, id and part that is kept as a table in the shared folder; texts do not move.  The
smallest id of each text is found with partial sums and joined back by id and digest together, so a text that a third
of all rows share is no hot key.  At most 2^filters counts of each part meet in one task.

Defined cases: a null text is empty, with no words, and fails only the conditions that hold for it (few words); a
null part is the empty string; a null id has no labels and is never a copy, and is no first either; labels that repeat
an id are 1 if any of them is; rows that repeat an id and text are both first or both copies; an empty table has no
parts and no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm import arrays as A

NEVER = 1 << 20
WHITE = r"[\x20\x09-\x0D]+"


def removal_ranks(failing: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """Rank (from 0) of the filter that removes each mask in each order; ``NEVER`` for a mask that fails none.

    ``failing`` is masks by filters, ``orders`` holds the filters of each order in turn.
    """
    cost = np.where(failing, 0, NEVER)
    place = np.argsort(orders, axis=1).T  # filters by orders
    ranks = np.full((len(failing), len(orders)), NEVER)
    for f in range(failing.shape[1]):
        ranks = np.minimum(ranks, cost[:, f, None] + place[f])
    return np.minimum(ranks, NEVER)


def audit(counts: DataFrame, filters: Sequence[str], weights: Sequence[str]) -> DataFrame:
    """All steps of all orders of the filters for each part.

    ``counts`` has ``part``, ``mask`` (bit k: fails filter k), ``n`` and a count for each of ``weights``; a part has each
    mask at most once.  Per part, order and step: rows kept after it, removed by it, redundant (fail its filter but
    were removed before), failing its filter alone, the weights removed by it as ``<weight>_lost``, and the filter's
    removals summed over all orders.
    """
    size = len(filters)
    orders = np.array(list(permutations(range(size))))
    names = ["".join(filters[f] for f in o) for o in orders]
    failing = (np.arange(1 << size)[:, None] >> np.arange(size)) & 1 == 1
    ranks = removal_ranks(failing, orders)
    columns = ["kept", "removed", "redundant", "unique_fails", *(f"{w}_lost" for w in weights), "shapley"]
    measures = ["n", *weights]
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in columns)

    def steps(count: np.ndarray) -> list[np.ndarray]:
        """``count`` is measures by masks; each result is orders by steps."""
        cell = np.arange(len(orders)) * size + np.minimum(ranks, size)
        gone = ranks < size
        out = np.zeros((len(measures), len(orders) * size), np.int64)
        for k in range(len(measures)):
            np.add.at(out[k], cell[gone], np.broadcast_to(count[k][:, None], ranks.shape)[gone])
        out = out.reshape(len(measures), len(orders), size)
        removed = out[0]
        late = failing[:, orders] & (np.arange(size) > ranks[:, :, None])
        redundant = np.tensordot(count[0], late.astype(np.int64), 1)
        alone = count[0][1 << orders]
        share = np.zeros(size, np.int64)
        np.add.at(share, orders, removed)
        return [int(count[0].sum()) - removed.cumsum(1), removed, redundant, alone, *out[1:], share[orders]]

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                count = np.zeros((len(measures), 1 << size), np.int64)
                for c in cells:
                    count[:, c["mask"]] = [c[m] for m in measures]
                found = [pa.array(x.ravel()) for x in steps(count)]
                head = [pa.array([part] * orders.size), pa.array(np.repeat(names, size)), pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(orders)))]
                yield pa.record_batch([*head, *found], names=["part", "filter_order", "step", *columns])

    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *measures)).alias("cells"))
    return cells.mapInArrow(worked, schema)


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides."""
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows by part (their source) and mask of failed filters A to E, with those of good quality and the toxic ones."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    bits = sum((c.cast("int") * (1 << k) for k, c in enumerate(text_failures(F.col("text")).values())), F.lit(0))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), bits.alias("bits"))
    rows = A.stored(rows.groupBy("doc_id", "digest", "part", "bits").agg(F.count("*").alias("n")))
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = [F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic")]
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(*marks)
    # rows without an id have nothing to find in either join
    named = rows.where("doc_id is not null").join(first, ["doc_id", "digest"], "left").join(labels, "doc_id", "left")
    copy = F.when(F.col("first").isNull(), 16).otherwise(0)
    named = named.select("part", (F.col("bits") + copy).alias("mask"), "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("quality", "toxic")))
    other = rows.where("doc_id is null").select("part", F.col("bits").alias("mask"), "n", F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    return (
        named.union(other).groupBy("part", "mask")
        .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters A to E over all orders, for each source."""
    return audit(failure_counts(docs, labels), "ABCDE", ["good", "toxic"])
