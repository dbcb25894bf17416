"""Token counts by prefix dynamic programming over a byte-level BPE vocabulary.

The encoding of a piece of text ends, at every prefix, with exactly one token that fits the encoding of what
stands before it: two tokens fit when encoding their joined bytes gives the two back.  So one pass over the bytes
finds the last token of every prefix, and with it the exact count: ``count[i] = count[i - len(last)] + 1``.
Pieces (what the vocabulary's pattern splits a text into) are encoded apart, so a text's table is the tables of its
pieces one after the other, and budget questions are answered by a search in it, without encoding anything again.

Words repeat, so each worker keeps the counts of the chunks it has seen (at most ``CACHE`` of them; then it starts
anew).  Special strings inside a text are single tokens, as the tokenizer file has them.

Defined cases: a null text is an empty one with no tokens; ties and repeated rows need no rule, since each row is
counted alone.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import arrays as A

CACHE = 600_000
RUN = 2 << 20
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies: printable bytes for themselves, the rest from 256 on."""
    same = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in same]
    return {chr(b): b for b in same} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Exact token counts of every prefix of a text."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        self.vocabulary = {raw(t): i for t, i in model["vocab"].items() if all(c in alphabet for c in t)}
        size = max(self.vocabulary.values()) + 1
        self.lengths = {i: len(t) for t, i in self.vocabulary.items()}
        self.longest = max(self.lengths.values())
        # the merge that forms each token: its rank (-1: a byte) and its two parts
        self.formed, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.rank: dict[int, int] = {}
        for i, m in enumerate(model["merges"]):
            x, y = map(raw, m if isinstance(m, list) else m.split(" "))
            token = self.vocabulary[x + y]
            x, y = self.vocabulary[x], self.vocabulary[y]
            self.rank[x << 32 | y] = i
            if self.formed[token] < 0:
                self.formed[token], self.left[token], self.right[token] = i, x, y
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        self._before: tuple[bytes, list[int], list[int]] = (b"", [0], [-1])
        self._tables: dict[bytes, list[int]] = {}
        self._chunks: dict[str, int | None] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens stay apart: no merge across their border comes before those that form them.

        The merges that form the two are undone from the last one back; at each step the two parts at the border
        would have merged if their own rank came before that of the merge that used up either of them.  Of equal
        ranks the merge further left comes first.
        """
        rank, formed = self.rank, self.formed
        until_left = until_right = 1 << 60
        while True:
            if (r := rank.get(left << 32 | right)) is not None and r < until_left and r <= until_right:
                return False
            f, g = formed[left], formed[right]
            if f > g:
                until_left, left = f, self.right[left]
            elif g >= 0:
                until_right, right = g, self.left[right]
            else:
                return True

    def lasts(self, piece: bytes) -> tuple[list[int], list[int]]:
        """For the prefixes of 0, 1, ... bytes of one piece: the token count and the id of the last token.

        What the last piece began with as well is taken from there, so pieces in order share most of the work.
        """
        before, counts, last = self._before
        same = next((i for i, (x, y) in enumerate(zip(before, piece)) if x != y), min(len(before), len(piece)))  # noqa: B905
        del counts[same + 1 :], last[same + 1 :]
        self._before, vocabulary, fits = (piece, counts, last), self.vocabulary, self.fits
        for i in range(same + 1, len(piece) + 1):
            for at in range(max(0, i - self.longest), i):
                token = vocabulary.get(piece[at:i])
                if token is not None and (not at or fits(last[at], token)):
                    counts.append(counts[at] + 1)
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return counts.copy(), last.copy()

    def piece(self, piece: bytes) -> list[int]:
        """Token counts of the prefixes of 0, 1, ... bytes of one piece."""
        if (counts := self._tables.get(piece)) is not None:
            return counts
        counts = self.lasts(piece)[0]
        if len(piece) <= 16:
            if len(self._tables) >= CACHE // 4:
                self._tables.clear()
            self._tables[piece] = counts
        return counts

    def parts(self, text: str) -> Iterator[tuple[str, list[int]]]:
        """The pieces of a text with their tables; a special string is one token."""
        at = 0
        found = [(m.start(), m.end()) for m in self.special.finditer(text)] if self.special else []
        for start, end in [*found, (len(text), None)]:
            for p in self.pieces.findall(text[at:start]):
                yield p, self.piece(p.encode())
            if end:
                yield text[start:end], [0] * (end - start) + [1]
                at = end

    def prefix_table(self, text: str) -> tuple[list[int], list[int]]:
        """Byte ends of the pieces and the token count up to each, from 0 on."""
        ends, counts = [0], [0]
        for p, table in self.parts(text):
            ends.append(ends[-1] + len(p.encode()))
            counts.append(counts[-1] + table[-1])
        return ends, counts

    def budget(self, text: str, tokens: int) -> int:
        """The bytes that the first ``tokens`` tokens of the text hold, from the tables alone."""
        at = 0
        for p, table in self.parts(text):
            if table[-1] > tokens:
                counts, last = self.lasts(p.encode())
                end = len(counts) - 1
                while counts[end] > tokens:
                    end -= self.lengths[last[end]]
                return at + end
            tokens -= table[-1]
            at += len(p.encode())
        return at

    def chunk(self, chunk: str) -> int | None:
        """Tokens of one chunk between single spaces; None if white space at its edges ties it to its neighbours."""
        if not chunk:
            return 0  # a text that starts with a space; its next chunk starts like any other
        word = chunk[1:] if chunk[0] == " " else chunk
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        return sum(table[-1] for _, table in self.parts(chunk))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts."""
        cache = self._chunks
        split = [t.split(" ") for t in texts]
        for chunks in split:
            chunks[1:] = [" " + c for c in chunks[1:]]
        new = {c for chunks in split for c in chunks if c not in cache}
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = {c for chunks in split for c in chunks}
        for c in sorted(new):
            cache[c] = self.chunk(c)
        out = []
        for text, chunks in zip(texts, split, strict=True):
            counts = [cache[c] for c in chunks]
            out.append(sum(table[-1] for _, table in self.parts(text)) if None in counts else sum(counts))
        for c in new:
            if len(c) > 64:
                del cache[c]
        return out


def count_tokens(docs: DataFrame, limit: int = 1024, vocabulary: str = VOCABULARY) -> DataFrame:
    """Bytes and tokens of every text, and whether it has more than ``limit`` tokens."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = A.task_cache("prefix", "counters")
        counter = keep.setdefault(vocabulary, None) or PrefixCounter(vocabulary)
        keep[vocabulary] = counter
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts, run, size = [], [], 0
            for t in texts:
                run.append(t)
                size += len(t)
                if size > RUN:
                    counts += counter.count(run)
                    run, size = [], 0
            counts += counter.count(run)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
