"""Best-fit packing of tokenized documents into sequences, improved by swap-based local search.

Documents longer than a sequence are cut into pieces.  Pieces are dealt by a hash of their id into groups of about
``GROUP``, each packed in one task: best fit in falling order first, then local search between underfull bins.  A
step moves a piece to a fuller bin, exchanges one piece for a smaller one of a fuller bin, or two pieces for one;
each step raises the sum of squared fills, so full bins fill up and the emptiest run empty.  Bins that hold no room
for the group's smallest piece are done; the pieces of the other bins go on to the next round, in fewer groups, and
the last round is one group.  So no task ever holds more than a few thousand pieces, whatever the input.

Words repeat, so each worker keeps the ids of the words it has seen (at most ``CACHE``; then it starts anew), and new
words of Latin letters are encoded many at a time.

Defined cases: a null text is empty, and an empty document is the end token alone; equal lengths are told apart by
(doc_id, piece), so results do not depend on the order of rows; rows that repeat an id are packed each on their own.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import arrays as A

GROUP = 16_384
CACHE = 1_000_000
#: Words encoded as one text.
RUN = 64
LETTERS = re.compile(rb"(?:[a-zA-Z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
MARK = np.zeros(256, bool)
MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
END = 1
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _encoded(tokenizer, ends: np.ndarray, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """Words and their ids.  A word of Latin letters is one piece of text to the tokenizer, and the last id of such a piece says so.

    So many of those words are encoded as one text, which is cut after every last id; other words are encoded each on their own.
    """
    plain, other = [], []
    for w in words:
        (plain if LETTERS.fullmatch(w) else other).append(w)
    runs = [plain[at : at + RUN] for at in range(0, len(plain), RUN)]
    for run, e in zip(runs, tokenizer.encode_batch_fast([b" ".join(r).decode() for r in runs], add_special_tokens=False), strict=True):
        ids = np.array(e.ids, "<u4")
        cuts = [0, *(4 * (np.flatnonzero(ends[ids]) + 1)).tolist()]
        if len(cuts) - 1 != len(run) or cuts[-1] != 4 * len(ids):  # a vocabulary without such ids
            other += run
            continue
        raw = ids.tobytes()
        yield from zip(run, [raw[a:b] for a, b in zip(cuts, cuts[1:])], strict=True)  # noqa: B905
    for w, e in zip(other, tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False), strict=True):
        yield w, array("I", e.ids).tobytes()


def word_ids(words: list[bytes], vocabulary: str) -> dict[bytes, bytes]:
    """The ids of words as little-endian 32-bit values; the tokenizer never joins across ASCII white space."""
    known = A.task_cache("ids", vocabulary)
    missing = list(set(words).difference(known))
    if missing:
        keep = A.task_cache("ids", "tokenizers")
        if vocabulary not in keep:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            tokenizer = Tokenizer.from_file(vocabulary)
            ends = np.zeros(tokenizer.get_vocab_size(), bool)
            suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
            if suffix:
                ends[[i for token, i in tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
            keep[vocabulary] = tokenizer, ends
        if len(known) + len(missing) > CACHE:
            known.clear()
            missing = list(set(words))
        for at in range(0, len(missing), 10_000):
            known.update(_encoded(*keep[vocabulary], missing[at : at + 10_000]))
    return known


def even_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with fewer different words: ASCII letters in lower case, ASCII marks after a Latin letter set apart.

    The tokenizer lower-cases, and a piece of text ends between a letter and such a mark.  Texts near a special string
    are left alone, since those are told apart by case.
    """
    if b"<|" in data.tobytes():
        return data, offsets
    low = A.LOWER[data]
    letter = (low >= 97) & (low <= 122)
    letter[1:] |= (low[:-1] == 0xC3) & (low[1:] != 0x97) & (low[1:] != 0xB7)  # two bytes, without the signs of times and division
    letter[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = False  # the next text's mark is not this one's
    at = np.flatnonzero(MARK[low[1:]] & letter[:-1]) + 1
    return np.insert(low, at, 32), offsets + np.searchsorted(at, offsets)


def token_ids(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of rows with the ids of each text, as bytes."""
    for rows, data, offsets in A.slices(batches, limit=1 << 20):
        if len(data):
            data, offsets = even_words(data, offsets)
        raw, at = data.tobytes(), offsets.tolist()
        words, ends = [], [0]
        for a, b in zip(at, at[1:]):  # noqa: B905
            words += raw[a:b].split()
            ends.append(len(words))
        ids = list(map(A.task_cache("ids", vocabulary).get, words))
        new = [i for i, x in enumerate(ids) if x is None]
        known = word_ids([words[i] for i in new], vocabulary)
        for i in new:
            ids[i] = known[words[i]]
        yield rows, [b"".join(ids[a:b]) for a, b in zip(ends, ends[1:])]  # noqa: B905


def tokenized_pieces(docs: DataFrame, length: int = 4096, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece of at most ``length`` tokens: its place in the document and a digest of its ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in token_ids(batches, vocabulary):
            out = []
            for doc_id, ids in zip(rows.column("doc_id").to_pylist(), texts, strict=True):
                ids += END.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(cut, PIECES)


class Bins:
    """Bins of item numbers with a common capacity, changed only in ways that raise the sum of squared fills."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self) -> None:
        """Largest first, each into the fullest bin with room."""
        rooms: list[tuple[int, int]] = []  # (room, bin), sorted
        for i in sorted(range(len(self.sizes)), key=lambda i: (-self.sizes[i], i)):
            at = bisect_left(rooms, (self.sizes[i], -1))
            if at < len(rooms):
                room, b = rooms.pop(at)
            else:
                room, b = self.capacity, len(self.items)
                self.items.append([])
                self.fill.append(0)
            self.items[b].append(i)
            self.fill[b] += self.sizes[i]
            if room > self.sizes[i]:
                insort(rooms, (room - self.sizes[i], b))

    def improve(self) -> None:
        """Local search until no step helps; fullest bins take first, emptiest bins give first."""
        open_bins = sorted((b for b in range(len(self.items)) if self.fill[b] < self.capacity), key=lambda b: (-self.fill[b], b))
        changed = True
        while changed:
            changed = False
            open_bins = sorted((b for b in open_bins if 0 < self.fill[b] < self.capacity), key=lambda b: (-self.fill[b], b))
            for k, target in enumerate(open_bins):
                for source in reversed(open_bins[k + 1 :]):
                    while self.fill[source] and self.fill[target] < self.capacity and self.fill[source] <= self.fill[target] and self._step(source, target):
                        changed = True

    def _step(self, source: int, target: int) -> bool:
        """The step between two bins that fills the target most: a move, one for one, or two for one."""
        sizes, room = self.sizes, self.capacity - self.fill[target]
        give = sorted(self.items[source], key=lambda i: (sizes[i], i))
        have = [sizes[i] for i in give]
        best, plan = 0, None
        at = bisect_right(have, room)
        if at:
            best, plan = have[at - 1], ([give[at - 1]], [])
        for j in {sizes[j]: j for j in self.items[target]}.values():
            if best == room:
                break
            limit = room + sizes[j]
            at = bisect_right(have, limit)
            if at and have[at - 1] - sizes[j] > best:
                best, plan = have[at - 1] - sizes[j], ([give[at - 1]], [j])
            lo, hi = 0, len(have) - 1
            while lo < hi:
                both = have[lo] + have[hi]
                if both > limit:
                    hi -= 1
                    continue
                if both - sizes[j] > best:
                    best, plan = both - sizes[j], ([give[lo], give[hi]], [j])
                lo += 1
        if plan is None:
            return False
        for i in plan[0]:
            self.items[source].remove(i)
            self.items[target].append(i)
        for j in plan[1]:
            self.items[target].remove(j)
            self.items[source].append(j)
        self.fill[source] -= best
        self.fill[target] += best
        return True


def pack(pieces: DataFrame, capacity: int = 4096, group: int = GROUP) -> DataFrame:
    """Place every piece: ``sequence_id`` and ``offset`` beside the given columns."""
    columns = pieces.columns

    def packed(base: int, last: bool):
        def one(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending"), ("length", "ascending")])
            bins = Bins(table.column("length").to_pylist(), capacity)
            bins.best_fit()
            bins.improve()
            least, n = min(bins.sizes), len(bins.sizes)
            number, offset, done = [0] * n, [0] * n, [False] * n
            for k, (items, fill) in enumerate(zip(bins.items, bins.fill, strict=True)):
                at = 0
                for i in items:
                    number[i], offset[i], done[i] = (base + key[0].as_py()) << 24 | k, at, last or capacity - fill < least
                    at += bins.sizes[i]
            table = table.select(columns)
            for name, values in (("sequence_id", pa.array(number, pa.int64())), ("offset", pa.array(offset, pa.int64())), ("done", pa.array(done))):
                table = table.append_column(name, values)
            return table

        return one

    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long, done boolean"
    rest, placed, base, before = A.checkpointed(pieces), [], 0, None
    while True:
        left = rest.count()
        groups = max(1, math.ceil(left / group))
        last = groups == 1 or (before is not None and left > 0.9 * before)
        # ids may be missing or repeated, texts too: rows that agree in all are dealt out by their place in the checkpoint
        key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).alias("group")
        out = rest.groupBy(key).applyInArrow(packed(base, last), schema)
        placed.append(out)
        if last:
            break
        placed[-1] = A.checkpointed(out)
        rest = placed[-1].where("not done").select(columns)
        base, before = base + groups, left
    out = placed[0].where("done")
    for more in placed[1:]:
        out = out.union(more.where("done"))
    return out.drop("done")


def pack_documents(docs: DataFrame, capacity: int = 4096, vocabulary: str = VOCABULARY) -> DataFrame:
    return pack(tokenized_pieces(docs, capacity, vocabulary), capacity)
