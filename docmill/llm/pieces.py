"""SentencePiece encoding and decoding by a table of the last piece of every prefix.

The merges of a merge-type vocabulary join two neighbouring parts when their joined text is a piece, the best score
first and the leftmost of equal scores.  The encoding of every prefix of a text ends with exactly one piece that fits
the one before it, where two pieces fit if encoding their joined text gives the two back.  So the table is filled from
left to right: an automaton over all pieces names those that end at a character, and the one that fits the last piece
of the prefix before it is stored.  The ids are then read from the end of the text backwards, piece by piece.

No piece has a space behind another character (checked when a vocabulary is read), so nothing merges across the
beginning of a run of spaces, nor between two characters that stand side by side in no piece.  A text is cut there,
and each worker keeps the encodings of the stretches and parts it has seen, at most ``CACHE`` of each and none longer
than ``LONG``; then it starts anew.  Characters that no piece has are written as their bytes.  The text is used as it is, with one space put before it, which is what vocabularies with the
identity rule ask for; others are refused.

Decoding joins the text of the pieces, turns runs of bytes into characters and takes the first space away.

Defined cases: a null text is an empty one with no ids; a sign U+2581 is a space, as in the library; null ids are
kept; rows are encoded one by one, so repeated rows need no rule; other columns of the input are ignored, whatever
their names; a text of any length is encoded whole, with a table in proportion to its longest stretch without spaces.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain
from operator import add

import ahocorasick
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as spec

from docmill.llm import arrays as A

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
CACHE, LONG = 400_000, 64
#: Characters encoded before their rows are handed on.
RUN = 1 << 20
SPACE = "▁"
STRETCH = re.compile(f"{SPACE}+[^{SPACE}]*")


class PieceTable:
    """Exact encoding and decoding with one vocabulary."""

    def __init__(self, path: str = VOCABULARY):
        model = spec.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rule, kinds = model.normalizer_spec, spec.ModelProto.SentencePiece
        if model.trainer_spec.model_type != spec.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("a merge-type vocabulary with byte pieces is needed")
        if rule.precompiled_charsmap or not rule.add_dummy_prefix or rule.remove_extra_whitespaces or not rule.escape_whitespaces:
            raise ValueError("the vocabulary changes texts before encoding them")
        if any(p.type not in (kinds.NORMAL, kinds.BYTE, kinds.CONTROL, kinds.UNKNOWN) for p in model.pieces):
            raise ValueError("the vocabulary has pieces with rules of their own")
        #: Ids and scores of the pieces that texts are made of; ids of the bytes.
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.score = {p: model.pieces[i].score for p, i in self.ids.items()}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.values = {i: b for b, i in self.bytes.items()}
        self.texts = [p.piece if p.type == kinds.NORMAL else "" for p in model.pieces]
        single = {c for p in self.ids for c in p}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids) or not single <= self.ids.keys():
            raise ValueError("the vocabulary joins words, or lacks a character of its pieces")
        self.beside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self._formed: dict[str, tuple[str, str] | None] = {c: None for c in single}
        self._fit: dict[int, bool] = {}
        self._stretches: dict[str, tuple[int, ...]] = {}
        self._parts: dict[str, tuple[int, ...]] = {}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if self.formed(p) != ("", ""):
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()

    def merges(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The parts of a short text after all merges, worked off one by one, and the two parts of the last merge."""
        parts, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap = [(-self.score[p], i, p) for i in range(len(text) - 1) if (p := text[i : i + 2]) in self.score]
        heapify(heap)
        last = None
        while heap:
            _, i, p = heappop(heap)
            j = after[i]
            if not parts[i] or j >= len(text) or parts[i] + parts[j] != p:
                continue
            last = parts[i], parts[j]
            parts[i], parts[j], after[i] = p, "", after[j]
            if after[i] < len(text):
                before[after[i]] = i
                if (q := p + parts[after[i]]) in self.score:
                    heappush(heap, (-self.score[q], i, q))
            if before[i] >= 0 and (q := parts[before[i]] + p) in self.score:
                heappush(heap, (-self.score[q], before[i], q))
        return [p for p in parts if p], last

    def formed(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge makes a piece; None for a single character, ("", "") for one no merges lead to."""
        if piece not in self._formed:
            parts, last = self.merges(piece)
            self._formed[piece] = last if len(parts) == 1 else ("", "")
        return self._formed[piece]

    def fits(self, left: str, right: str) -> bool:
        """Whether two neighbouring pieces stay apart: no merge across their border comes before those that form them.

        The merges that form the two are undone from the last one back.  Pieces of spaces only share one score, where
        the place decides, so for them the merges are worked off.
        """
        score = self.score
        if not left.strip(SPACE):
            return self.merges(left + right)[0] == [left, right]
        until_left = until_right = float("-inf")
        while True:
            if (s := score.get(left + right)) is not None and s > until_left and s >= until_right:
                return False
            x, y = self.formed(left), self.formed(right)
            if x and (not y or score[left] <= score[right]):
                until_left, left = score[left], x[1]
            elif y:
                until_right, right = score[right], y[0]
            else:
                return True

    def lasts(self, text: str) -> list[int]:
        """The id of the last piece of every prefix of one character or more, or -1 for a character that no piece has."""
        last: list[int] = []
        fit, texts, have = self._fit, self.texts, 0
        for end, (piece, length) in self.automaton.iter(text):
            if have > end:
                continue  # found already
            if have < end:
                last.extend([-1] * (end - have))
                have = end
            before = last[end - length] if end >= length else -1
            if before >= 0:
                pair = before << 32 | piece
                stays = fit.get(pair)
                if stays is None:
                    stays = fit[pair] = self.fits(texts[before], texts[piece])
                if not stays:
                    continue
            last.append(piece)
            have += 1
        last.extend([-1] * (len(text) - have))
        if len(fit) > 4 * CACHE:
            fit.clear()
        return last

    def part(self, text: str) -> tuple[int, ...]:
        """The ids of a part that nothing around it merges with, read from its end backwards."""
        last, out, at = self.lasts(text), [], len(text)
        while at:
            if (piece := last[at - 1]) >= 0:
                out.append(piece)
                at -= len(self.texts[piece])
            else:
                at -= 1
                out.extend(self.bytes[b] for b in reversed(text[at].encode()))
        return tuple(reversed(out))

    def stretch(self, text: str) -> tuple[int, ...]:
        """The ids of one stretch, from the parts between characters that are side by side in no piece."""
        cuts = [k for k, pair in enumerate(map(add, text, text[1:]), 1) if pair not in self.beside]
        out: list[int] = []
        for at, end in zip([0, *cuts], [*cuts, len(text)], strict=True):
            part = text[at:end]
            if (ids := self._parts.get(part)) is None:
                ids = self.part(part)
                if len(part) <= LONG:
                    self._parts[part] = ids
            out += ids
        if len(self._parts) > CACHE:
            self._parts.clear()
        return tuple(out)

    def encode(self, text: str) -> array:
        """The ids of a whole text."""
        if not text:
            return array("i")
        cache, stretches = self._stretches, STRETCH.findall(SPACE + text.replace(" ", SPACE))
        for s in stretches:
            if s not in cache:
                break
        else:
            return array("i", chain.from_iterable(map(cache.__getitem__, stretches)))
        if len(cache) > CACHE:
            cache.clear()
        found = []
        for s in stretches:
            if (ids := cache.get(s)) is None:
                ids = self.stretch(s)
                if len(s) <= LONG:
                    cache[s] = ids
            found.append(ids)
        return array("i", chain.from_iterable(found))

    def decode(self, ids: Iterable[int]) -> str:
        """The text of a row of ids."""
        ids, texts, values = list(ids), self.texts, self.values
        if values.keys().isdisjoint(ids):
            out = "".join(map(texts.__getitem__, ids))
        else:
            parts, run = [], bytearray()
            for i in ids:
                if (b := values.get(i)) is not None:
                    run.append(b)
                    continue
                if run:
                    parts.append(run.decode("utf-8", "replace"))
                    run.clear()
                parts.append(texts[i])
            out = "".join(parts) + run.decode("utf-8", "replace")
        return out.removeprefix(SPACE).replace(SPACE, " ")


def encode_texts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row its ids and the text that they decode to."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = A.task_cache("pieces", "tables")
        table = keep.get(vocabulary)
        if table is None:
            table = keep[vocabulary] = PieceTable(vocabulary)
        for rows, _, _ in A.slices(batches, limit=RUN):
            ids = [table.encode(t or "") for t in rows.column("text").to_pylist()]
            ends = array("i", [0])
            for x in ids:
                ends.append(ends[-1] + len(x))
            flat = array("i")
            for x in ids:
                flat.extend(x)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.record_batch([rows.column("doc_id"), lists, pa.array([table.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(encoded, "doc_id long, ids array<int>, decoded string")
