"""Substring dedup: passages of ``window`` words that also stand in a document with a smaller id are cut out.

Anchors.  Every document is cut into blocks of ``block`` words, one after the other, which form the index; with
``window >= 2 * block - 1`` each window holds a whole block of any document it stands in.  Every rolling run of
``block`` words is a probe.  An anchor is a run that is a block somewhere and stands in at least two documents.

Extension.  Each window that holds an anchor is compared, by a 64-bit hash of its words, with the windows of all
other documents around the same anchor; of several anchors in a window the one with the smallest hash is used,
which is the same one in every copy.  A window found in a document with a smaller id marks its words; marked
windows that overlap make up the maximal repeats.

Skew.  A passage in a third of all documents gives each task at most a few messages per slice of text: runs that
several documents of a slice share are settled there, and one entry stands for them in the shuffle.

Defined cases: null text has no words; a text shorter than the window loses nothing; rows with null id are left out;
rows with the same id count as one document, so they never cut each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import arrays as A

#: So many documents of one slice make a run an anchor without a block being seen.
MANY = 8
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<start:int,end:int>>"
MESSAGE = "bucket int, kind int, doc_id long, payload binary"


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.record_batch(
        [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())],
        names=["bucket", "kind", "doc_id", "payload"],
    )


def _signs(h: np.ndarray, doc: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket number (upper half) and 32 bits of each run of n words, and which runs lie within one text."""
    w = A.windows(h, n)
    inside = doc[: len(w)] == doc[n - 1 :][: len(w)]
    high = (w >> np.uint64(32)) % np.uint64(buckets)
    return (high << np.uint64(32)) | (w & np.uint64(0xFFFFFFFF)), inside


def find_repeats(docs: DataFrame, window: int = 50, block: int = 25) -> DataFrame:
    """Kept words of every document, with the word spans that were cut."""
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block wherever it starts")
    buckets = A.bucket_count(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in A.slices(batches, limit=3 * A.SLICE_BYTES):
            starts, ends, doc = A.words(data, offsets)
            if len(starts) < block:
                continue
            ids = rows.column("doc_id").to_numpy()
            sign, inside = _signs(A.word_hashes(data, starts, ends), doc, block, buckets)
            first = np.searchsorted(doc, doc)  # the text's first word
            at = np.flatnonzero(inside)
            is_block = (at - first[at]) % block == 0
            sign, of = sign[at], doc[at]
            order = np.lexsort((of, sign))
            sign, of, is_block = sign[order], of[order], is_block[order]
            # one entry for each run and document
            head = np.flatnonzero((np.append(True, sign[1:] != sign[:-1])) | (np.append(True, of[1:] != of[:-1]))) if len(sign) else order
            if not len(head):
                continue
            is_block = np.logical_or.reduceat(is_block, head)
            sign, of = sign[head], of[head]
            head = A.heads(sign)
            sizes = np.diff(np.append(head, len(sign)))
            # ids decide, since rows may repeat an id
            low, high = np.minimum.reduceat(ids[of], head), np.maximum.reduceat(ids[of], head)
            settled = (low != high) & (np.logical_or.reduceat(is_block, head) | (sizes >= MANY))
            known = np.repeat(settled, sizes)
            out = [(int(ids[d]) * 2_654_435_761 % buckets, 1, int(ids[d]), A.pack(np.sort(x[0]))) for d, x in _by_doc(of[known], sign[known])]
            send = ~known
            send[head] = True
            flag = is_block[send].astype(np.uint8) | (known[send].astype(np.uint8) << 1)
            sign, of = sign[send], of[send]
            small = np.uint16 if len(ids) < 65536 else np.uint32
            for b, (f, d, x) in A.by_bucket((sign >> np.uint64(32)).astype(np.int64), (sign & np.uint64(0xFFFFFFFF)).astype(np.uint32), of.astype(small), flag):
                out.append((b, 0, None, A.pack(ids, f, d, x)))
            yield _messages(out)

    def anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        out_doc, out_sign = [], []
        ids, prints, flags = [], [], []
        for kind, doc_id, payload in zip(*(table.column(c).to_pylist() for c in ("kind", "doc_id", "payload")), strict=True):
            if kind:
                (known,) = A.unpack(payload)
                out_doc.append(np.full(len(known), doc_id, np.int64))
                out_sign.append(known.astype(np.int64))
            else:
                of, f, d, x = A.unpack(payload)
                ids.append(of[d])
                prints.append(f)
                flags.append(x)
        if ids:
            ids, prints, flags = np.concatenate(ids), np.concatenate(prints), np.concatenate(flags)
            order = np.argsort(prints, kind="stable")
            ids, prints, flags = ids[order], prints[order], flags[order]
            head = A.heads(prints)
            seen = np.bitwise_or.reduceat(flags, head)
            many = np.minimum.reduceat(ids, head) != np.maximum.reduceat(ids, head)
            active = np.repeat(((seen & 1) > 0) & many | (seen & 2 > 0), np.diff(np.append(head, len(prints))))
            out_doc.append(ids[active])
            out_sign.append(prints[active].astype(np.int64) | (int(key[0].as_py()) << 32))
        doc = np.concatenate(out_doc) if out_doc else np.zeros(0, np.int64)
        sign = np.concatenate(out_sign) if out_sign else np.zeros(0, np.int64)
        return pa.table({"doc_id": doc, "sign": sign})

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in A.slices(batches, limit=3 * A.SLICE_BYTES):
            starts, ends, doc = A.words(data, offsets)
            if len(starts) < window:
                continue
            ids = rows.column("doc_id").to_numpy()
            h = A.word_hashes(data, starts, ends)
            sign, inside = _signs(h, doc, block, buckets)
            hits = rows.column("signs")
            values = hits.flatten().to_numpy().astype(np.uint64)
            owner = np.repeat(np.arange(len(ids)), hits.value_lengths().fill_null(0).to_numpy())
            salt = lambda d: A.mix(d.astype(np.uint64) * A.BASE)
            hit = inside & np.isin(sign ^ salt(doc[: len(sign)]), values ^ salt(owner))
            # the anchor of a window: the smallest hash among those that lie in it
            least = np.where(hit, sign, np.uint64(2**64 - 1))
            span, k = window - block + 1, 1
            while 2 * k <= span:
                least = np.minimum(least[: len(least) - k], least[k:])
                k *= 2
            m = len(h) - window + 1
            least = np.minimum(least[:m], least[span - k :][:m])
            at = np.flatnonzero((least != np.uint64(2**64 - 1)) & (doc[:m] == doc[window - 1 :]))
            full, of = A.windows(h, window)[at], doc[at]
            bucket = (least[at] >> np.uint64(32)).astype(np.int64)
            pos = (at - np.searchsorted(doc, of)).astype(np.int32)
            # a smaller id in this slice settles a window here
            order = np.lexsort((pos, ids[of], full))
            full, of, pos, bucket = full[order], of[order], pos[order], bucket[order]
            if not len(full):
                continue
            head = A.heads(full)
            least_id = np.repeat(np.minimum.reduceat(ids[of], head), np.diff(np.append(head, len(full))))
            cut = ids[of] > least_id
            out = [(int(ids[d]) * 2_654_435_761 % buckets, 1, int(ids[d]), A.pack(x[0])) for d, x in _by_doc(of[cut], pos[cut])]
            order = np.argsort(bucket[~cut], kind="stable")
            rest = [a[~cut][order] for a in (bucket, full, of, pos)]
            for b, (f, d, p) in A.by_bucket(rest[0], *rest[1:]):
                out.append((b, 0, None, A.pack(f, ids[d], p)))
            yield _messages(out)

    def compare(table: pa.Table) -> pa.Table:
        doc, positions, parts = [], [], []
        for kind, doc_id, payload in zip(*(table.column(c).to_pylist() for c in ("kind", "doc_id", "payload")), strict=True):
            if kind:
                doc.append(doc_id)
                positions.append(A.unpack(payload)[0].tobytes())
            else:
                parts.append(A.unpack(payload))
        if parts:
            full, of, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((of, full))
            full, of, pos = full[order], of[order], pos[order]
            head = A.heads(full)
            cut = of > np.repeat(of[head], np.diff(np.append(head, len(full))))
            order = np.argsort(of[cut], kind="stable")
            for d, (p,) in A.by_bucket(of[cut][order], pos[cut][order]):
                doc.append(d)
                positions.append(p.tobytes())
        return pa.table({"doc_id": pa.array(doc, pa.int64()), "positions": pa.array(positions, pa.binary())})

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in A.slices(batches):
            starts, ends, doc = A.words(data, offsets)
            text = data.tobytes()
            lists, out = rows.column("positions"), []
            bounds = np.searchsorted(doc, np.arange(rows.num_rows + 1))
            for i in range(rows.num_rows):
                s, e = starts[bounds[i] : bounds[i + 1]], ends[bounds[i] : bounds[i + 1]]
                found = [np.frombuffer(x, np.int32) for x in lists[i].as_py() or []]
                gone, spans = np.zeros(len(s), bool), []
                if found:
                    step = np.zeros(len(s) + 1, np.int64)
                    at = np.concatenate(found)
                    at = at[at + window <= len(s)]  # of rows that share an id
                    np.add.at(step, at, 1)
                    np.add.at(step, at + window, -1)
                    gone = np.cumsum(step[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False]))))
                    spans = [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]
                kept = b" ".join(text[a:b] for a, b in zip(s[~gone].tolist(), e[~gone].tolist(), strict=True))
                out.append((rows.column("doc_id")[i].as_py(), len(s), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"), spans))
            cols = list(zip(*out, strict=True))
            yield pa.record_batch(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3]), pa.array(cols[4]),
                 pa.array(cols[5], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans"],
            )

    hits = docs.mapInArrow(probe, MESSAGE).groupBy("bucket").applyInArrow(anchors, "doc_id long, sign long")
    hits = hits.groupBy("doc_id").agg(F.collect_set("sign").alias("signs"))
    near = docs.join(hits, "doc_id").mapInArrow(extend, MESSAGE)
    cuts = near.groupBy("bucket").applyInArrow(compare, "doc_id long, positions binary")
    cuts = cuts.groupBy("doc_id").agg(F.collect_list("positions").alias("positions"))
    return docs.join(cuts, "doc_id", "left").mapInArrow(keep, RESULT)


def _by_doc(of: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(of, kind="stable")
    return A.by_bucket(of[order], values[order])
