"""Periodic runs of words, found in a grammar of the texts.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that no neighbouring
word extends; it counts from ``times`` periods and ``least`` words on.

Re-Pair.  The word ids of a slice of texts are shortened in rounds.  A round counts all neighbouring pairs within a
text and replaces the frequent ones, the most frequent first where they overlap, by a symbol of their own; a pair
keeps its symbol in later rounds.  Texts of a slice share one grammar, so copies of a passage become one symbol.
Rounds end where they shorten little; what is left of each text is its start rule, cut up as a balanced tree.  Which
pairs are replaced decides how much work is shared and never the result.

Runs of a symbol.  A run lies in exactly one lowest node of a text's derivation, whose border between left and right
part it crosses.  Crossing runs are found once for each symbol, at its first place, and once for each node of a start
rule.  A run of four periods has two of them on one side of the border, so for each period it is enough to compare the
two periods before the border, and the two after it, by prefix hashes; a hit is extended to both sides by bisection
and then compared word by word.  Should a comparison fail, the hashes are made anew with another base.

Translation.  The places of a symbol are those where it was put in, so the runs found in it are moved to each place.
A symbol's border may cut a run short, but its lowest node holds it whole: intervals of one period that overlap by a
period or more are merged, and of equal intervals the smallest period stays.

Each text lies in one task from its words to its runs; a task works on slices of about two MB and on a longer text by
itself, with arrays in proportion to it.  No shuffle is needed, and a lost task is run again alone.

Defined cases: null, empty and blank texts have no words and no runs; a null id is kept; repeated rows are worked off
one by one; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import arrays as A

#: A round replaces pairs that are at least this part as frequent as the most frequent one.
SPREAD = 4
#: Rounds end when they replace less than this part of the symbols.
WORTH = 1 / 256
#: So many (border, period) pairs are tested at a time.
TESTS = 1 << 21
U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407, 0x9FB21C651E98DF25)


class Grammar(NamedTuple):
    """Symbols with the places of their first use, all places, and the start rules' symbols."""

    low: np.ndarray  # first place of each symbol: where it starts, its border, its end
    border: np.ndarray
    high: np.ndarray
    symbol: np.ndarray  # every place: which symbol
    at: np.ndarray  # and where it starts
    start: np.ndarray  # where the symbols of the start rules begin
    text: np.ndarray  # and the text of each


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words only."""
    lens = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
    letters = data[~A.SPACE[data]]
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(lens), pa.py_buffer(letters)])
    return column.dictionary_encode().indices.to_numpy().astype(np.int64)


def _chosen(rank: np.ndarray, none: int) -> np.ndarray:
    """Places whose rank is not above those beside it; of neighbours with one rank every other."""
    padded = np.concatenate(([none], rank, [none]))
    good = (rank < none) & (rank <= padded[:-2]) & (rank <= padded[2:])
    at = np.flatnonzero(good)
    first = np.append(True, at[1:] != at[:-1] + 1)[: len(at)]
    begin = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0)) if len(at) else at
    return at[(np.arange(len(at)) - begin) % 2 == 0]


def re_pair(ids: np.ndarray, text: np.ndarray) -> Grammar:
    """Grammar of all texts; ``text`` is the number of the text of each word, in order."""
    symbol, start, end = ids, np.arange(len(ids)), np.arange(1, len(ids) + 1)
    first_new = fresh = int(ids.max(initial=-1)) + 1
    known, named = np.zeros(0, np.int64), np.zeros(0, np.int64)
    rules, places = [], []
    bound = None
    while len(symbol) > 1:
        same = text[1:] == text[:-1]
        code = np.where(same, symbol[:-1] << 32 | symbol[1:], -1)
        pairs, which, count = np.unique(code, return_inverse=True, return_counts=True)
        count = np.where(pairs < 0, 0, count)
        top = int(count.max())
        if top < 2:
            break
        bound = max(2, top // SPREAD) if bound is None else max(2, min(bound, top // SPREAD))
        taken = np.flatnonzero(count >= bound)
        order = taken[np.lexsort((A.mix(pairs[taken].astype(U)), -count[taken]))]
        rank = np.full(len(pairs), len(order))
        rank[order] = np.arange(len(order))
        at = _chosen(rank[which], len(order))
        used, first, of = np.unique(code[at], return_index=True, return_inverse=True)
        where = np.searchsorted(known, used)
        old = np.zeros(len(used), bool) if not len(known) else known[np.minimum(where, len(known) - 1)] == used
        name = np.empty(len(used), np.int64)
        name[old] = named[where[old]]
        name[~old] = fresh + np.arange(int((~old).sum()))
        fresh += int((~old).sum())
        new = at[first[~old]]
        rules.append((start[new], end[new], end[new + 1]))
        known, named = np.insert(known, where[~old], used[~old]), np.insert(named, where[~old], name[~old])
        places.append((name[of] - first_new, start[at]))
        symbol = symbol.copy()
        symbol[at] = name[of]
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        end = end.copy()
        end[at] = end[at + 1]
        little = len(at) < WORTH * len(symbol)
        symbol, start, end, text = symbol[keep], start[keep], end[keep], text[keep]
        if little:
            if bound == 2:
                break
            bound = max(2, bound // SPREAD)
    join = lambda parts, k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64)
    return Grammar(*(join(rules, k) for k in range(3)), *(join(places, k) for k in range(2)), start, text)


def tree_levels(start: np.ndarray, text: np.ndarray, total: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Nodes of balanced trees over the start rules, level by level: begin, border and end of each in words."""
    place = np.append(start, total)
    low = A.heads(text)
    high = np.append(low[1:], len(text))
    while True:
        keep = (high - low > 1) & (place[high] - place[low] >= least)
        low, high = low[keep], high[keep]
        if not len(low):
            return
        middle = (low + high) // 2
        yield place[low], place[middle], place[high]
        low, high = np.concatenate((low, middle)), np.concatenate((middle, high))


class _Prefixes:
    """Prefix hashes of a row of ids, to compare two stretches that lie ``shift`` words apart."""

    def __init__(self, ids: np.ndarray, base: int):
        self.power = np.cumprod(np.append(np.ones(1, U), np.full(len(ids), base, U)))
        self.sum = np.append(np.zeros(1, U), np.cumsum(A.mix(ids.astype(U) + U(base)) * self.power[:-1]))

    def equal(self, at: np.ndarray, length: np.ndarray, shift: np.ndarray) -> np.ndarray:
        s = self.sum
        return (s[at + length] - s[at]) * self.power[shift] == s[at + length + shift] - s[at + shift]

    def reach(self, at: np.ndarray, shift: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How far the stretches at ``at`` and ``at + shift`` agree, forwards from there or backwards to before it."""
        got = np.zeros(len(at), np.int64)
        step = 1 << max(0, int(most.max(initial=0)).bit_length() - 1)
        while step:
            more = got + step
            fine = np.flatnonzero(more <= most)
            begin = at[fine] - more[fine] if back else at[fine]
            fine = fine[self.equal(begin, more[fine], shift[fine])]
            got[fine] = more[fine]
            step >>= 1
        return got


def crossing(ids: np.ndarray, prefixes: _Prefixes, low: np.ndarray, border: np.ndarray, high: np.ndarray, least: int, times: int) -> tuple[np.ndarray, ...]:
    """Runs within each node that cross its border: node, begin, end, period.  Not yet compared word by word."""
    most = np.where(high - low >= least, (high - low) // times, 0)
    ends = np.cumsum(most)
    out = [np.zeros((4, 0), np.int64)]
    node = 0
    while node < len(low):
        before = int(ends[node - 1]) if node else 0
        stop = max(node + 1, int(np.searchsorted(ends, before + TESTS, side="right")))
        of = np.repeat(np.arange(node, stop), most[node:stop])
        q = np.arange(1, len(of) + 1) - np.repeat(ends[node:stop] - most[node:stop] - before, most[node:stop])
        node = stop
        b, l, h = border[of], low[of], high[of]
        near = np.flatnonzero((2 * q <= b - l) & (ids[b - 1] == ids[np.maximum(b - 1 - q, 0)]))
        left = near[prefixes.equal(b[near] - 2 * q[near], q[near], q[near])]
        near = np.flatnonzero((2 * q <= h - b) & (ids[b] == ids[np.minimum(b + q, len(ids) - 1)]))
        right = near[prefixes.equal(b[near], q[near], q[near])]
        hit = np.concatenate((left, right))
        # the two periods that agree: where they begin
        square = np.concatenate((b[left] - 2 * q[left], b[right]))
        of, q, l, h = of[hit], q[hit], l[hit], h[hit]
        begin = square - prefixes.reach(square, q, square - l, True)
        end = square + 2 * q + prefixes.reach(square + q, q, h - square - 2 * q, False)
        fine = (end - begin >= np.maximum(least, times * q)) & (begin < border[of]) & (end > border[of])
        out.append(np.stack([of, begin, end, q])[:, fine])
    of, begin, end, q = np.concatenate(out, axis=1)
    order = np.lexsort((q, end, begin, of))
    of, begin, end, q = of[order], begin[order], end[order], q[order]
    new = np.append(True, (of[1:] != of[:-1]) | (begin[1:] != begin[:-1]) | (end[1:] != end[:-1]))[: len(of)]
    return of[new], begin[new], end[new], q[new]


def periodic(ids: np.ndarray, begin: np.ndarray, end: np.ndarray, q: np.ndarray) -> bool:
    """Whether all stretches have their period, word by word."""
    length = end - begin - q
    ends = np.cumsum(length)
    at = 0
    while at < len(q):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + TESTS, side="right")))
        n = length[at:stop]
        i = np.arange(int(n.sum())) + np.repeat(begin[at:stop] - (ends[at:stop] - n - before), n)
        if not np.array_equal(ids[i], ids[i + np.repeat(q[at:stop], n)]):
            return False
        at = stop
    return True


def merged(begin: np.ndarray, end: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal intervals by start and period: those of one period that share a period are one; of equal ones the smallest period."""
    order = np.lexsort((begin, q))
    begin, end, q = begin[order], end[order], q[order]
    if len(q):
        far = int(end.max()) + 1
        reach = np.maximum.accumulate(end + q * far) - q * far
        new = np.append(True, (q[1:] != q[:-1]) | (begin[1:] > reach[:-1] - q[1:]))
        at = np.flatnonzero(new)
        begin, end, q = begin[at], np.maximum.reduceat(end, at), q[at]
    order = np.lexsort((q, end, begin))
    begin, end, q = begin[order], end[order], q[order]
    new = np.append(True, (begin[1:] != begin[:-1]) | (end[1:] != end[:-1]))[: len(q)]
    begin, end, q = begin[new], end[new], q[new]
    order = np.lexsort((q, begin))
    return begin[order], end[order], q[order]


def word_runs(ids: np.ndarray, text: np.ndarray, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and period of all runs of all texts, in order of begin and period."""
    grammar = re_pair(ids, text)
    for base in BASES:
        prefixes = _Prefixes(ids, base)
        rule, begin, end, q = crossing(ids, prefixes, grammar.low, grammar.border, grammar.high, least, times)
        if not periodic(ids, begin, end, q):
            continue
        # to every place of its symbol
        holds = np.flatnonzero(np.isin(grammar.symbol, rule))
        first, last = np.searchsorted(rule, grammar.symbol[holds]), np.searchsorted(rule, grammar.symbol[holds], side="right")
        n = last - first
        k = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
        move = np.repeat(grammar.at[holds], n) - grammar.low[rule[k]]
        found = [(begin[k] + move, end[k] + move, q[k])]
        for low, border, high in tree_levels(grammar.start, grammar.text, len(ids), least):
            _, begin, end, q = crossing(ids, prefixes, low, border, high, least, times)
            if not periodic(ids, begin, end, q):
                break
            found.append((begin, end, q))
        else:
            return merged(*(np.concatenate([f[i] for f in found]) for i in range(3)))
    raise ValueError("all bases of the prefix hashes met stretches that they cannot tell apart")


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Where the words of a tenth of the texts, chosen by id, come from: a prefix, then a period over and over."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


RUN = "struct<start:long,length:long,period:long>"
SCHEMA = f"doc_id long, n_words long, runs array<{RUN}>, longest {RUN}, collapsed string"


def find_runs(docs: DataFrame, least: int = 6, times: int = 4, source: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """Per row: its words, its runs by start and period, the one with most periods, and the text with each run cut to its first period.

    ``source`` may give, for an id and a number of words, the word that each word is taken from.
    """
    three = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in A.slices(batches):
            starts, ends, text = A.words(data, offsets)
            count = np.bincount(text, minlength=rows.num_rows)
            base = np.append(0, np.cumsum(count))
            take = np.arange(len(starts))
            if source:
                for k, doc_id in enumerate(rows.column("doc_id").to_pylist()):
                    if (moved := source(doc_id, int(count[k]))) is not None:
                        take[base[k] : base[k + 1]] = base[k] + moved
            ids = word_ids(data, starts, ends)[take]
            begin, end, q = word_runs(ids, text, least, times)
            of = text[begin]
            runs = pa.StructArray.from_arrays([pa.array(x) for x in (begin - base[of], end - begin, q)], fields=list(three))
            per = np.searchsorted(of, np.arange(rows.num_rows + 1)).astype(np.int32)
            order = np.lexsort((q, begin, -(end - begin) / q, of))
            best = np.full(rows.num_rows, -1)
            best[of[order][::-1]] = order[::-1]
            longest = runs.take(pa.array(np.maximum(best, 0), mask=best < 0))
            dropped = np.zeros(len(ids) + 1, np.int64)
            np.add.at(dropped, begin + q, 1)
            np.add.at(dropped, end, -1)
            kept = np.flatnonzero(np.cumsum(dropped[:-1]) == 0)
            last = np.append(text[kept][1:] != text[kept][:-1], True)[: len(kept)]
            size = ends[take[kept]] - starts[take[kept]] + ~last
            total = np.cumsum(size)
            out = data[np.minimum(np.arange(int(size.sum())) + np.repeat(starts[take[kept]] - (total - size), size), max(len(data) - 1, 0))]
            out[total[~last] - 1] = 0x20
            edge = np.append(0, total)[np.searchsorted(text[kept], np.arange(rows.num_rows + 1))]
            collapsed = pa.LargeStringArray.from_buffers(rows.num_rows, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(out))
            yield pa.record_batch(
                [rows.column("doc_id"), pa.array(count), pa.ListArray.from_arrays(pa.array(per), runs), longest, collapsed.cast(pa.string())],
                names=["doc_id", "n_words", "runs", "longest", "collapsed"],
            )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(worked, SCHEMA)
