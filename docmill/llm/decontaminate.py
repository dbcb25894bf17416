"""Benchmark decontamination by template windows: finds benchmark passages even with other numbers, names and units.

Template.  Words are stripped of punctuation at their edges and lower-cased; numbers, units and names (a capital
first letter within a sentence) become placeholders of their type.  Every run of ``size`` template words is a window,
of documents and of benchmark items alike; items with fewer words are one window, and items of under ``LEAST``
words, which would match by chance, are left out.

Join.  Windows of documents meet the items' windows by hash.  With up to ``SMALL_SIDE`` item windows (counted before)
the tasks get their hashes and send on only windows that hit; with more, all windows go through the shuffle join.

Check.  Hits of a document and an item on one diagonal make a run.  A run goes on only as long as its slots are
consistent: a value of the item always stands for the same value of the document, and the other way round.  An item
has leaked if a run has ``run`` words (or all of a shorter item) with enough literal words among them.

Scale: nothing but hits leaves the tasks; a hot item is a broadcast row or is split by the join's skew handling, and
hits are grouped by document and item.

Defined cases: null or blank texts are clean; null items are ignored; rows that repeat an item id count as one item
with several texts; rows that repeat a document id get one result, but a run lies within one text of the document and
one text of the item; rows with null id are kept as clean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import arrays as A

LEAST = 4
SMALL_SIDE = 1 << 20
LITERALS = 6
CACHE = 200_000
NUMBER = re.compile(r"[+\-−]?[\d][\d.,:/]*\Z")
QUANTITY = re.compile(r"([\d][\d.,]*)([^\W\d_]{1,3}|%|°)\Z")
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers mg g kg t lb lbs oz gram grams "
    "kilogram kilograms pound pounds ounce ounces ton tons ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr "
    "hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur percent degree degrees mph kph watt watts volt volts".split()
)
LITERAL, NUM, UNIT, NAME = 0, 1, 2, 3
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
SCHEMA = "doc_id long, text_key long, pos int, size int, h long, slot_at array<int>, slots array<string>"


def word_kind(word: str) -> tuple[int, str, bool]:
    """Type of a word (a name only if it does not start a sentence), its bare form, and whether it ends a sentence."""
    ends = word.rstrip("\"')]}»”’").endswith((".", "!", "?", ":", ";", "|"))
    bare = EDGES.sub("", word)
    if NUMBER.match(bare) or QUANTITY.match(bare):
        return NUM, bare.lower(), ends
    if bare.lower() in UNITS or (not bare and word.strip(".,;:!?()") in ("%", "°", "$", "€", "£")):
        return UNIT, bare.lower() or word, ends
    if bare[:1].isupper() and bare[1:2].islower():
        return NAME, bare.lower(), ends
    return LITERAL, bare.lower(), ends


def template(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Template hash, type and text number of each template word, and where its bare form stands in the last list."""
    starts, ends, doc = A.words(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int8), doc, np.zeros(0, np.int64), []
    known, raw = A.task_cache("template", "words"), data.tobytes()
    h, first, of = np.unique(A.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    if len(known) > CACHE:
        known.clear()
    kinds, forms, stops = np.empty(len(h), np.int8), [], np.empty(len(h), bool)
    for i, (key, a, b) in enumerate(zip(h.tolist(), starts[first].tolist(), ends[first].tolist(), strict=True)):
        if (found := known.get(key)) is None:
            found = word_kind(raw[a:b].decode("utf-8", "replace"))
            if b - a < 64:
                known[key] = found
        kinds[i], stops[i] = found[0], found[2]
        forms.append(found[1])
    bare = [f.encode() for f in forms]
    at = np.concatenate(([0], np.cumsum([len(b) for b in bare])))
    filled = np.flatnonzero(np.diff(at))
    buffer = np.frombuffer(b"".join(bare), np.uint8)
    literal = np.zeros(len(h), np.uint64)
    literal[filled] = A.word_hashes(np.where(A.SPACE[buffer], 95, buffer).astype(np.uint8), at[filled], at[1:][filled])
    kind, stop = kinds[of], stops[of]
    begins = np.append(True, (doc[1:] != doc[:-1]) | stop[:-1])
    kind = np.where((kind == NAME) & begins, LITERAL, kind)
    value = np.where(kind == LITERAL, literal[of], A.mix(kind.astype(np.uint64)))
    keep = (kind != LITERAL) | (literal[of] != 0)
    return value[keep], kind[keep], doc[keep], of[keep], forms


def find_leaks(docs: DataFrame, items: DataFrame, size: int = 8, run: int = 12) -> DataFrame:
    """One row per document: whether an item has leaked into it, which, and the longest run in words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    items = items.select(F.col("item_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    items = items.withColumn("text_key", F.xxhash64("text")).distinct()

    def windows(sizes: list[int], mask: np.ndarray | None, wanted: np.ndarray | None, whole: bool):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, data, offsets in A.slices(batches):
                value, kind, doc, of, forms = template(data, offsets)
                n_words = np.bincount(doc, minlength=rows.num_rows)
                first = np.concatenate(([0], np.cumsum(n_words)))
                slot = np.flatnonzero(kind != LITERAL)
                ids, texts, out = rows.column("doc_id").to_pylist(), rows.column("text_key").to_pylist(), []
                for k in sizes:
                    w = A.windows(value, k)
                    hit = doc[: len(w)] == doc[k - 1 :][: len(w)]
                    if whole:  # items: long ones by windows of the full size, short ones as a whole
                        hit &= (n_words[doc[: len(w)]] == k) | ((k == size) & (n_words[doc[: len(w)]] > k))
                    if mask is not None:
                        hit &= mask[w & np.uint64(len(mask) - 1)]
                    at = np.flatnonzero(hit)
                    if wanted is not None:
                        at = at[np.isin(w[at], wanted)]
                    begin, end = np.searchsorted(slot, at), np.searchsorted(slot, at + k)
                    for p, b, e in zip(at.tolist(), begin.tolist(), end.tolist(), strict=True):
                        s = slot[b:e]
                        out.append((ids[doc[p]], texts[doc[p]], p - int(first[doc[p]]), k, int(w[p].astype(np.int64)), (s - p).tolist(), [forms[i] for i in of[s]]))
                cols = list(zip(*out, strict=True)) if out else [[]] * 7
                yield pa.record_batch(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.list_(pa.int32())), pa.array(cols[6], pa.list_(pa.string()))],
                    names=["doc_id", "text_key", "pos", "size", "h", "slot_at", "slots"],
                )

        return find

    known = A.checkpointed(items.mapInArrow(windows(list(range(LEAST, size + 1)), None, None, True), SCHEMA))
    n_windows = known.count()
    sizes = [r.size for r in known.select("size").distinct().collect()]  # at most eight
    mask = wanted = None
    if n_windows <= SMALL_SIDE:
        wanted = np.array([r.h for r in known.select("h").distinct().collect()], np.int64).view(np.uint64)
        mask = np.zeros(1 << 20, bool)
        mask[wanted & np.uint64(len(mask) - 1)] = True
    hits = docs.where("doc_id is not null").mapInArrow(windows(sizes, mask, wanted, False), SCHEMA)
    lengths = known.groupBy("doc_id", "text_key").agg(F.max(F.col("pos") + F.col("size")).alias("length"))
    side = known.join(lengths, ["doc_id", "text_key"]).select(
        F.col("doc_id").alias("item_id"), F.col("text_key").alias("item_key"), F.col("pos").alias("item_pos"), "size", "h", F.col("slot_at").alias("item_at"), F.col("slots").alias("item_slots"), "length"
    )
    if n_windows <= SMALL_SIDE:
        side = F.broadcast(side)
    joined = hits.join(side, ["h", "size"])
    one = F.struct("pos", "item_pos", "size", "slot_at", "slots", "item_at", "item_slots", "length")
    grouped = joined.groupBy("doc_id", "text_key", "item_id", "item_key").agg(F.collect_set(one).alias("hits"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            longest = [longest_run(x, run) for x in batch.column("hits").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("item_id"), pa.array(longest, pa.int32())], names=["doc_id", "item_id", "words"])

    leaks = grouped.mapInArrow(check, "doc_id long, item_id long, words int").where("words > 0")
    leaks = leaks.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("words").alias("longest_run"))
    out = docs.select("doc_id").join(leaks, "doc_id", "left")
    return out.select(
        "doc_id",
        F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"),
        F.coalesce("longest_run", F.lit(0)).alias("longest_run"),
    )


def longest_run(hits: list[dict], run: int) -> int:
    """Words of the longest consistent run of hits that is long enough; 0 if there is none."""
    best = 0
    hits = sorted(hits, key=lambda x: (x["pos"] - x["item_pos"], x["size"], x["pos"]))
    line, last, start, there, back, slots, literal_all = None, None, 0, {}, {}, set(), 0
    for x in hits:
        key = (x["pos"] - x["item_pos"], x["size"], x["length"])
        pairs = [(x["pos"] + a, v, w) for a, v, w in zip(x["slot_at"], x["item_slots"], x["slots"], strict=True)]
        goes_on = key == line and x["pos"] == last + 1 and all(there.get(v, w) == w and back.get(w, v) == v for _, v, w in pairs)
        if not goes_on:
            start, there, back, slots = x["pos"], {}, {}, set()
        consistent = True
        for p, v, w in pairs:
            consistent &= there.setdefault(v, w) == w and back.setdefault(w, v) == v
            slots.add(p)
        if not consistent:
            line = None
            continue
        line, last = key, x["pos"]
        words = last + x["size"] - start
        literal_all = words - len(slots)
        if words >= min(run, x["length"]) and literal_all >= min(LITERALS, max(1, words // 2)):
            best = max(best, words)
    return best
