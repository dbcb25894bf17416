"""Filter audit, SentencePiece pieces and periodic runs against brute force and the library."""

import hashlib
import random
import re
import zlib
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from docmill.llm import filters, pieces, runs
from docmill.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# filter interaction audit


def audit_rows(docs, labels):
    """The audit of (doc_id, text, source) rows by walking every row through every order."""
    marks, first = {}, {}
    for i, good, toxic in labels:
        g, t = marks.get(i, (0, 0))
        marks[i] = g or int(good == 1), t or int(toxic == 1)
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    rows = []
    for i, text, part in docs:
        text = text or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > first[text],
        }
        rows.append((part or "", {k for k, v in fails.items() if v}, *(marks.get(i, (0, 0)) if i is not None else (0, 0))))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                late = sum(f in r[1] for r in mine) - len(gone)
                left = [r for r in left if f not in r[1]]
                removed_by[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), late, sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(removed_by[f])
    return out


def audited(df):
    measures = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r.part, r.filter_order, r.step): [r[m] for m in measures] for r in df.collect()}


def test_audit_against_brute_force(spark, odd_rows):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "b", "Word", "x#y", "é", *(f"w{k}" for k in range(300))]) for _ in range(rng.choice([0, 3, 190, 260, 400]))) for _ in range(30)]
    docs = [(i, t, None if i < 0 else "s1") for i, t in odd_rows if i is not None and i != 4] + [(None, "no id", "s2"), (None, "no id", "s2"), (6, odd_rows[5][1], "s2")]
    docs += [(20 + k, rng.choice(texts), rng.choice(["s1", "", None, "s3"])) for k in range(80)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(60)] + [(6, 1, 0), (6, 0, 1), (None, 1, 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "'x' as part", "'x' as n", "'x' as digest", "'x' as quality", "'x' as first", "'x' as mask")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' as part", "'x' as n", "'x' as mask")
    found = audited(filters.filter_audit(table, marks))
    assert found == audit_rows(docs, labels)
    assert filters.filter_audit(table.limit(0), marks).count() == 0
    assert filters.filter_audit(table, marks.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_removal_ranks():
    failing = np.array([[False, False], [True, False], [True, True]])
    assert filters.removal_ranks(failing, np.array([[0, 1], [1, 0]])).tolist() == [[filters.NEVER] * 2, [0, 1], [0, 0]]


# SentencePiece


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=pieces.VOCABULARY)


@pytest.fixture(scope="module")
def table():
    return pieces.PieceTable()


def test_pieces_like_the_library(table, library):
    rng = random.Random(1)
    alphabet = [*"ab  the in_\n\t▁éЖ日本🧿\x00'.,<s>09e", "ing", "er", "  ", "tion", "<s>", "<unk>", "<0x41>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    some = [p.replace("▁", " ") for p in table.ids]
    texts += ["".join(rng.choice(some) for _ in range(rng.randint(0, 8))) for _ in range(3000)]
    texts += [" " * k + "the" + " " * (70 - k) for k in range(70)] + ["", " ", "▁", "a" * 5000, "日" * 3000, "é" * 50, "\n" * 40]
    for t in texts:
        ids = library.encode(t)
        assert list(table.encode(t)) == ids, t
        assert table.decode(ids) == library.decode(ids), t


def test_last_piece_of_every_prefix(table, library):
    """The stored piece is the last one of the prefix's own encoding."""
    for text in ("▁international", "▁▁▁▁▁reorganisationen", "internationally,.", "▁日本語x"):
        for n, last in enumerate(table.lasts(text), 1):
            if last >= 0:
                assert library.id_to_piece(library.encode("x\n" + text[:n].replace("▁", " "))[-1]) == library.id_to_piece(last)


def test_pieces_of_odd_rows(odd, odd_rows, none, library):
    found = sorted(((r.doc_id, r.decoded, r.ids) for r in pieces.encode_texts(odd).collect()), key=str)
    want = sorted(((i, library.decode(library.encode(t or "")), library.encode(t or "")) for i, t in odd_rows), key=str)
    assert found == want
    assert pieces.encode_texts(none).count() == 0


def test_piece_query(spark, sf_dir, documents, library):
    found = {r.doc_id: tuple(r)[1:] for r in Q.op12_sentencepiece(spark, sf_dir).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for doc_id, text in documents[0]:
        ids = library.encode(text or "")
        assert found[doc_id] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


# periodic runs


def brute_runs(words, least=6, times=4):
    out = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q) and j > i:
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, q, e) for (s, e), q in out.items())


def described(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {k for s, q, e in found for k in range(s + q, e)}
    best = min(found, key=lambda f: (-Fraction(f[2] - f[0], f[1]), f[0], f[1]), default=None)
    top = (best[0], best[2] - best[0], best[1], 1000 * (best[2] - best[0]) // best[1]) if best else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = "".join(f"{s},{e - s},{q}\n" for s, q, e in found)
    return (len(found), *top, sha(lines), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_runs_against_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 5)):
            n, kinds = rng.randint(0, 80), rng.choice([1, 2, 2, 3, 5, 50])
            w = [rng.randrange(kinds) for _ in range(n)]
            if n and rng.random() < 0.5:
                a, p = rng.randrange(n), rng.randint(1, n // 4 + 1)
                w = [w[i] if i < a else w[min(a + (i - a) % p, n - 1)] for i in range(n)]
            texts.append(w * rng.choice([1, 1, 2, 5]))
        ids = np.array([x for w in texts for x in w], np.int64)
        begin, end, q = runs.word_runs(ids, np.repeat(np.arange(len(texts)), [len(w) for w in texts]))
        want, at = [], 0
        for w in texts:
            want += [(s + at, k, e + at) for s, k, e in brute_runs(w)]
            at += len(w)
        assert list(zip(begin.tolist(), q.tolist(), end.tolist(), strict=True)) == want


def test_grammar_derives_its_texts():
    """Each symbol stands for the same words at all its places, and none crosses a text's border."""
    rng = np.random.default_rng(2)
    ids, text = rng.integers(0, 3, 3000), np.repeat(np.arange(30), 100)
    g = runs.re_pair(ids, text)
    assert len(g.low) > 20 and len(g.start) < 1500
    assert ((g.low < g.border) & (g.border < g.high)).all() and (text[g.low] == text[g.high - 1]).all()
    for rule, at in zip(g.symbol.tolist(), g.at.tolist(), strict=True):
        length = g.high[rule] - g.low[rule]
        assert np.array_equal(ids[at : at + length], ids[g.low[rule] : g.high[rule]])


def test_other_bases_after_a_collision(monkeypatch):
    """Prefix hashes that cannot tell words apart are noticed word by word; with another base the runs are right."""
    monkeypatch.setattr(runs, "BASES", (0, *runs.BASES))  # base 0 knows only the first word
    ids = np.array([1, 2, 3, 4, 5, 6, 7, 7, 7, 7, 7, 7, 8, 9, 1, 2] * 3, np.int64)
    begin, end, q = runs.word_runs(ids, np.zeros(len(ids), np.int64))
    assert list(zip(begin.tolist(), q.tolist(), end.tolist(), strict=True)) == brute_runs(ids.tolist())


def test_runs_of_odd_rows(spark, odd, odd_rows, none):
    found = {(r.doc_id, r.n_words): r for r in runs.find_runs(odd, source=runs.planted).collect()}
    short = [(i, t) for i, t in odd_rows if i not in (4, 13)]
    for i, t in short:
        r = found[i, len(WORD.findall(t or ""))]
        assert (len(r.runs), hashlib.sha256(r.collapsed.encode()).hexdigest()) == (described(i, t)[0], described(i, t)[-1])
    plain = {r.doc_id: r for r in runs.find_runs(odd).collect()}
    assert plain[14].longest.asDict() == {"start": 0, "length": 300, "period": 1} and plain[14].collapsed == "rep"
    assert plain[1].runs == [] and plain[1].longest is None and plain[1].collapsed == ""
    assert runs.find_runs(none).count() == 0


def test_run_query(spark, sf_dir, documents):
    found = {r.doc_id: tuple(r)[1:] for r in Q.op13_periodic_runs(spark, sf_dir).collect()}
    for doc_id, text in documents[0]:
        if len(text or "") < 20_000:
            assert found[doc_id] == described(doc_id, text), doc_id
