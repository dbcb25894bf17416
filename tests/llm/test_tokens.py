"""Packing, token counts and the language model against the tokenizer libraries and brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docmill.llm import language, lm, packing, token_counts

MIX = ["a", "B", " ", "  ", "\n", ".", ",", "..", ", ", "'s", "'LL", "É", "é", "日本", "1", "23", "!", "###", "<|endoftext|>", "<|STARTOFTEXT|>",
       "The", "\x1c", "　", "İ", "Σ", "…", "\r\n", "ing", "🙂"]


def random_texts(n, size=40, seed=3):
    rng = random.Random(seed)
    parts = [p for p in MIX if "<|" not in p]
    return ["".join(rng.choice(MIX if k % 5 == 0 else parts) for _ in range(rng.randrange(size))) for k in range(n)]


def test_word_ids_are_the_librarys():
    texts = random_texts(6000)
    want = Tokenizer.from_file(packing.VOCABULARY).encode_batch(texts, add_special_tokens=False)
    got = [x for _, ids in packing.token_ids([pa.record_batch([pa.array(texts)], names=["text"])], packing.VOCABULARY) for x in ids]
    assert got == [np.array(e.ids, "<u4").tobytes() for e in want]


def expected_pieces(rows, length):
    library, out = Tokenizer.from_file(packing.VOCABULARY), Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), length)):
            part = np.array(ids[at : at + length], "<u4")
            out[(i, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    return out


def check_packing(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("group", [packing.GROUP, 40])
def test_packing(documents, odd, odd_rows, group):
    for df, rows in ((documents[1], documents[0]), (odd, odd_rows)):
        got = packing.pack(packing.tokenized_pieces(df, 512), 512, group).collect()
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected_pieces(rows, 512)
        least = math.ceil(sum(r.length for r in got) / 512)
        assert check_packing(got, 512) <= least * (1.01 if group > 40 else 1.05) + 1


def test_packing_empty(none):
    assert packing.pack_documents(none).count() == 0


def test_local_search_raises_squares_and_empties_bins():
    rng = random.Random(1)
    for _ in range(30):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(1, 80))]
        bins = packing.Bins(sizes, 100)
        bins.items, bins.fill = [[i] for i in range(len(sizes))], list(sizes)
        before = sum(f * f for f in bins.fill)
        bins.improve()
        assert sorted(i for b in bins.items for i in b) == list(range(len(sizes)))
        assert all(f == sum(sizes[i] for i in b) <= 100 for b, f in zip(bins.items, bins.fill))
        assert sum(f * f for f in bins.fill) >= before
        assert sum(f > 0 for f in bins.fill) <= math.ceil(sum(sizes) / 100) * 1.2 + 1


def test_counts_are_the_librarys(documents, odd, odd_rows, none):
    library = Tokenizer.from_file(token_counts.VOCABULARY)
    texts = random_texts(6000) + ["".join(random.Random(k).choice("abcdeth ing") for _ in range(k % 90)) for k in range(2000)]
    assert token_counts.PrefixCounter().count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    for df, rows in ((documents[1], documents[0]), (odd, odd_rows)):
        got = token_counts.count_tokens(df, 100).collect()
        want = Counter()
        for i, t in rows:
            n = len(library.encode(t or "", add_special_tokens=False).ids)
            want[(i, len((t or "").encode()), n, n > 100)] += 1
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts.count_tokens(none).count() == 0


def test_every_prefix_of_a_piece_and_budgets():
    library, counter = Tokenizer.from_file(token_counts.VOCABULARY), token_counts.PrefixCounter()
    for piece in ("internationalization", " thereinandout", "aaaaaaaaaaaaaaa", "-----------------------", "strawberry"):
        assert counter.piece(piece.encode()) == [len(library.encode(piece[:k], add_special_tokens=False).ids) for k in range(len(piece) + 1)]
    text = "The prefix tables answer questions, e.g. how much text 17 tokens hold; 'unbelievable' isn't it?\n\nYes  it is."
    ends = [e for _, e in library.encode(text, add_special_tokens=False).offsets]
    assert [counter.budget(text, k) for k in range(len(ends) + 3)] == [0, *ends, ends[-1], ends[-1]]
    at, counts = counter.prefix_table(text)
    assert at[-1] == len(text) and counts[-1] == len(ends)


def test_unigram_counts(documents, odd, odd_rows, none):
    for df, rows in ((documents[1], documents[0]), (odd, odd_rows)):
        fold = language.held_out(F.col("doc_id"), 5, 1)
        got = lm.score_texts(df, df.where(~fold), fold).collect()
        word = re.compile(rb"[^\x20\x09-\x0D]+")
        rows = [(i, word.findall((t or "").encode().lower())) for i, t in rows if i is not None]
        held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
        c, n_docs = Counter(), 0
        for i, w in rows:
            if not held[i]:
                c.update(w)
                n_docs += 1
        n, v = sum(c.values()) + n_docs, len(c) + 1
        base = lambda k: math.log10((k + 0.5) / (n + 0.5 * (v + 1)))
        want = sorted((i, held[i], len(w) + 1, sum(c[x] > 0 for x in w) + 1, round(sum(base(c[x]) for x in w) + base(n_docs), 2)) for i, w in rows)
        assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 2)) for r in got) == want
        assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)
    fold = language.held_out(F.col("doc_id"), 5, 1)
    assert lm.score_texts(none, none, fold).count() == 0
    untrained = lm.score_texts(odd, none, fold).collect()
    assert len(untrained) == len([r for r in odd_rows if r[0] is not None]) and {r.n_known for r in untrained} == {0}


def test_rare_words_take_the_join(documents, monkeypatch):
    """With a small table of frequent words, the others' counts come from the join."""
    _, df = documents
    fold = language.held_out(F.col("doc_id"), 5, 1)
    whole = {r.doc_id: r for r in lm.score_texts(df, df.where(~fold), fold).collect()}
    monkeypatch.setattr(lm, "FREQUENT", 50)
    for r in lm.score_texts(df, df.where(~fold), fold).collect():
        assert (r.n_tokens, r.n_known) == (whole[r.doc_id].n_tokens, whole[r.doc_id].n_known)
        assert math.isclose(r.base_score, whole[r.doc_id].base_score, rel_tol=1e-9)


def test_model_is_a_causal_distribution_and_learns():
    rng = np.random.default_rng(0)
    model = lm.Attention()
    x = rng.integers(0, 50, (4, lm.WINDOW)).astype(np.int32)
    total = sum(np.exp(model.log_probability(x, np.full(x.shape, c))) for c in range(lm.OWN + lm.SHARED))
    assert np.allclose(total, 1, atol=1e-4)
    changed = x.copy()
    changed[:, 20:] = 7
    y = rng.integers(0, 50, x.shape)
    assert np.allclose(model.log_probability(x, y)[:, :20], model.log_probability(changed, y)[:, :20], atol=1e-5)
    # the gradient is the slope
    valid = np.ones(x.shape, np.int32)
    loss = lambda: -float((model.log_probability(x, y)).mean())
    g = model.gradient(x, y, valid)
    for name in ("q", "v", "o", "in", "class", "embed", "place"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        keep, slopes = model.p[name][at], []
        for d in (1e-2, -1e-2):
            model.p[name][at] = keep + d
            slopes.append(loss())
        model.p[name][at] = keep
        assert math.isclose((slopes[0] - slopes[1]) / 2e-2, g[name][at], rel_tol=0.1, abs_tol=1e-4), name
    x = np.tile(np.arange(lm.WINDOW, dtype=np.int32) % 5, (64, 1))
    y = (x + 1).astype(np.int64) % 5
    model.fit(x, y, np.ones(x.shape, np.int32), epochs=20, batch=16)
    assert float(model.log_probability(x, y)[:, 1:].mean()) > -0.1
    classes = lm.Classes(np.arange(lm.IDS) % 300)
    assert np.allclose(np.bincount(classes.of, weights=np.exp(classes.share)), 1)


def test_fitting_step_is_adam():
    """One step over windows with ids that repeat and places that don't count, against the step written out; it runs over one row."""
    rng = np.random.default_rng(12)
    x, y = rng.integers(0, 9, (6, lm.WINDOW)).astype(np.int32), rng.integers(0, lm.OWN, (6, lm.WINDOW))
    valid = (rng.random(x.shape) < 0.7).astype(np.int32)
    model = lm.Attention()
    before = {k: v.copy() for k, v in model.p.items()}
    g = model.gradient(x, y, valid)
    lone = [model.gradient(x[i : i + 1], y[i : i + 1], valid[i : i + 1]) for i in range(6)]
    for k, v in g.items():
        assert np.allclose(v, sum(o[k] * n for o, n in zip(lone, valid.sum(1), strict=True)) / valid.sum(), rtol=1e-3, atol=1e-6), k
    model.fit(x, y, valid, epochs=1, rate=0.01)
    assert all(np.shares_memory(v, model.p["embed"].base) for v in model.p.values())
    for k, v in model.p.items():
        assert v.dtype == np.float32 and np.allclose(v, before[k] - 0.01 * g[k] / (np.abs(g[k]) + 1e-8), atol=2e-4), k


def test_windows_score_each_id_once():
    counts = np.ones(lm.IDS)
    model, classes = lm.Attention(), lm.Classes(counts)
    rng = np.random.default_rng(2)
    sizes = [1, 5, lm.WINDOW, lm.WINDOW + 1, lm.WINDOW + lm.OVERLAP, 400]
    at = np.concatenate(([0], np.cumsum(sizes)))
    ids = rng.integers(0, lm.IDS, at[-1]).astype(np.int32)
    got = lm.Scorer(model, classes).scores(ids, at, batch=3)
    for i, n in enumerate(sizes):
        own, total = ids[at[i] : at[i + 1]], 0.0
        before = np.append(lm.START, own[:-1])
        for k in range(n):
            start = max(0, (k - lm.OVERLAP) // (lm.WINDOW - lm.OVERLAP)) * (lm.WINDOW - lm.OVERLAP)
            start = start if k >= lm.WINDOW else 0
            x = classes.input[before[start : k + 1]][None]
            total += model.log_probability(x, classes.of[own[start : k + 1]][None])[0, -1] + classes.share[own[k]]
        assert math.isclose(got[i], total / math.log(10), rel_tol=1e-3)


def test_context_and_classes_are_whole():
    """Every id has at least 12 ids of context, 144 ids are told apart, and scoring takes the sums of ``forward`` at any size."""
    assert (lm.WINDOW, lm.OVERLAP, lm.OWN, lm.SHARED) == (48, 12, 144, 48)
    rng = np.random.default_rng(5)
    model = lm.Attention()
    for name in ("q", "class"):
        model.p[name] *= np.float32(80)  # scores and logits far beyond 30
    x, y = rng.integers(0, 50, (3, lm.WINDOW)), rng.integers(0, lm.OWN, (3, lm.WINDOW))
    h = (model.p["embed"][x] + model.p["place"]).astype(np.float64)
    a = (h @ model.p["q"]) @ (h @ model.p["k"]).transpose(0, 2, 1) / math.sqrt(lm.WIDTH)
    a = np.where(np.tril(np.ones(a.shape[1:])) > 0, a, -np.inf)
    a = np.exp(a - a.max(axis=2, keepdims=True))
    h = h + (a / a.sum(axis=2, keepdims=True)) @ (h @ model.p["v"]) @ model.p["o"]
    h = h + np.maximum(h @ model.p["in"] + model.p["in_b"], 0) @ model.p["out"]
    logits = h @ model.p["class"] + model.p["class_b"]
    assert np.abs(logits).max() > 35
    top = logits.max(axis=2, keepdims=True)
    want = np.take_along_axis(logits - top, y[:, :, None], 2)[:, :, 0] - np.log(np.exp(logits - top).sum(axis=2))
    assert np.allclose(model.log_probability(x, y), want, rtol=1e-3, atol=1e-2)


def test_every_training_id_is_fitted_whatever_the_tasks(documents, monkeypatch):
    """Windows of the training texts hold every id once, and neither they nor the model depend on the partitions."""
    docs, df = documents
    fold = language.held_out(F.col("doc_id"), 5, 1)
    seen, fitted = [], lm.fitted

    def watched(windows, counts):
        seen.append((sorted((r.key, r.n, bytes(r.payload)) for r in windows.collect()), counts))
        return fitted(windows, counts)

    monkeypatch.setattr(lm, "fitted", watched)
    monkeypatch.setattr(lm, "SHARD", 150)
    scores = []
    for parts in (1, 7):
        rows = lm.score_texts(df, df.where(~fold).repartition(parts), fold).collect()
        scores.append({r.doc_id: r.score for r in rows})
    assert seen[0][0] == seen[1][0] and all(math.isclose(scores[0][i], scores[1][i], rel_tol=1e-4) for i in scores[0])
    library, want = Tokenizer.from_file(lm.VOCABULARY), Counter()
    for i, t in docs:
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            want.update(e for w in (t or "").split() for e in library.encode(w, add_special_tokens=False).ids)
            want[lm.END] += 1
    got = Counter()
    for _, n, payload in seen[0][0]:
        got.update(np.frombuffer(payload, np.uint16)[1 + n :].tolist())
    assert got == want and {i: int(seen[0][1][i]) for i in got} == want


def test_packing_without_ids(spark):
    """Rows that agree in id and text do not meet in one group."""
    docs = spark.createDataFrame([(None, f"text {i % 3}") for i in range(600)], "doc_id long, text string")
    pieces = packing.tokenized_pieces(docs, 64)
    packed = packing.pack(pieces, 64, 40)
    assert check_packing(packed.collect(), 64) <= 1.2 * pieces.agg(F.sum("length")).first()[0] / 64
    groups = packed.withColumn("group", F.shiftright("sequence_id", 24)).groupBy("group").count()
    assert groups.agg(F.max("count")).first()[0] < 120


class Watched:
    """A tokenizer that notes how many texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, add_special_tokens):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=add_special_tokens)


def test_new_words_are_encoded_many_at_a_time():
    rng, library = np.random.default_rng(8), Tokenizer.from_file(packing.VOCABULARY)
    syllables = "tion un ß é Éan the Über çon ñ ÿe A qu".split()
    words = sorted({"".join(syllables[k] for k in rng.integers(0, len(syllables), 7)) for _ in range(3000)})
    ends = np.zeros(library.get_vocab_size(), bool)
    without = Watched(library)
    want = {w.encode(): e.ids for w, e in zip(words, library.encode_batch(words, add_special_tokens=False), strict=True)}
    plain = lambda found: {w: np.frombuffer(x, np.uint32).tolist() for w, x in found}
    assert plain(packing._encoded(without, ends, list(want))) == want and without.texts > len(words)  # no id that ends a word: each on its own
    ends[[i for token, i in library.get_vocab().items() if token.endswith("</w>")]] = True
    many = Watched(library)
    odd = {w.encode(): library.encode(w, add_special_tokens=False).ids for w in "İx ŉa éa a̸ x×y a1b 漢字 don't <|endoftext|>x ªb µ Ǆ".split()}
    assert plain(packing._encoded(many, ends, [*want, *odd])) == want | odd and many.texts < len(words) / 50 + len(odd)


def test_marks_after_letters_are_set_apart():
    texts = ["ünü%%% Don't a—% x÷% x×! AB###", "'s", "é", "!!", "", "Ã%", "a≠b a̸= ñ.5, ß'll"]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    got, at = packing.even_words(data, offsets)
    cut = [got.tobytes()[a:b].decode() for a, b in zip(at, at[1:])]  # noqa: B905
    assert cut == ["ünü %%% don 't a —% x÷% x×! ab ###".replace("a —", "a—"), "'s", "é", "!!", "", "Ã %", "a ≠b a̸= ñ .5, ß 'll"]
    library = Tokenizer.from_file(packing.VOCABULARY)
    assert [e.ids for e in library.encode_batch(cut, add_special_tokens=False)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_context_places_are_left_out_and_the_rest_agrees(monkeypatch):
    """Scores from a place on are those of the whole window; sums with and without the greatest value taken off agree."""
    rng = np.random.default_rng(15)
    model = lm.Attention()
    x, y = rng.integers(0, 50, (5, lm.WINDOW)), rng.integers(0, lm.OWN + lm.SHARED, (5, lm.WINDOW))
    valid = np.arange(lm.WINDOW) >= np.array([0, 12, 12, 40, 48])[:, None]
    whole, g = model.log_probability(x, y), model.gradient(x, y, valid)
    assert whole.shape == x.shape
    assert np.allclose(model.log_probability(x, y, lm.OVERLAP), whole[:, lm.OVERLAP :], rtol=1e-4, atol=1e-5)
    assert np.allclose(model.log_probability(x[:, :20], y[:, :20], 12), whole[:, 12:20], rtol=1e-4, atol=1e-5)
    monkeypatch.setattr(lm, "SAFE", -1)
    assert np.allclose(model.log_probability(x, y, 12), whole[:, 12:], rtol=1e-4, atol=1e-5)
    for k, v in model.gradient(x, y, valid).items():
        assert v.dtype == np.float32 and np.allclose(v, g[k], rtol=1e-3, atol=1e-6), k
    none = model.gradient(x, y, np.zeros(x.shape, bool))
    assert all((v == 0).all() for v in none.values())


def test_fitting_leaves_inputs_alone_that_do_not_occur(monkeypatch):
    rng = np.random.default_rng(16)
    x, y = rng.integers(5, 9, (40, lm.WINDOW)).astype(np.int32), rng.integers(0, lm.OWN, (40, lm.WINDOW))
    model, before, rows = lm.Attention(), lm.Attention().p["embed"], []
    step = lm.Attention.gradient
    monkeypatch.setattr(lm.Attention, "gradient", lambda self, *a: rows.append(len(self.p["embed"])) or step(self, *a))
    model.fit(x, y, np.ones(x.shape, bool), epochs=1)
    assert set(rows) == {4} and model.p["embed"].shape == before.shape  # a step is over what occurs
    changed = np.flatnonzero((model.p["embed"] != before).any(axis=1))
    assert changed.tolist() == [5, 6, 7, 8]


def test_windows_reach_the_fitting_whole(monkeypatch):
    ids = [np.array([lm.START, 7, 8, 9], np.uint16), np.arange(100, 101 + lm.WINDOW, dtype=np.uint16), np.array([3, lm.END], np.uint16)]
    seen = []
    monkeypatch.setattr(lm.Attention, "fit", lambda self, *a, **k: seen.extend(a))
    counts = np.arange(lm.IDS)[::-1].astype(float)
    classes = lm.Classes(counts)
    state = type("State", (), {"value": (lm.Attention().p, counts)})
    table = pa.table({"shard": [0] * 3, "rank": [2, 1, 3], "n": [0, 12, 0], "payload": [v.tobytes() for v in ids]})
    lm._trainer(state, 0, 1)(table.slice(0, 3))
    x, y, valid = seen
    assert x.shape == y.shape == valid.shape == (3, lm.WINDOW) and valid.sum(1).tolist() == [lm.WINDOW - 12, 3, 1]
    for row, k in zip((1, 0, 2), range(3), strict=True):
        n = len(ids[row]) - 1
        assert x[k, :n].tolist() == classes.input[ids[row][:-1]].tolist() and y[k, :n].tolist() == classes.of[ids[row][1:]].tolist()
        assert not x[k, n:].any() and not valid[k, n:].any()


def test_windows_are_stored_once(spark, documents):
    """Of all tables written, one alone holds ids, in parts by the round that sees them."""
    _, df = documents
    fold, folder = language.held_out(F.col("doc_id"), 5, 1), Path(lm.A._shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    lm.score_texts(df, df.where(~fold), fold)
    tables = {p: spark.read.parquet(str(p)) for p in set(folder.iterdir()) - before}
    (at, windows), *other = [t for t in tables.items() if "payload" in t[1].columns]
    assert not other and all(p.name.startswith("round=") for p in at.iterdir() if p.is_dir())
    assert windows.where(F.when(F.col("kind") == 2, lm._round(F.col("key"), lm.ROUNDS)).otherwise(-1) != F.col("round")).count() == 0


@pytest.mark.parametrize("n, passes", [(1200, 2), (1200, 1), (600, 1)])
def test_rounds_see_every_window_once_a_pass(spark, tmp_path, monkeypatch, n, passes):
    def noting(state, k, of):
        def train(table):
            (tmp_path / f"{k}-{table.column('shard')[0]}").write_text(" ".join(map(str, table.column("rank").to_pylist())))
            flat = np.array_split(np.concatenate([v.ravel() for v in state.value[0].values()]), 16)
            return pa.table({"part": pa.array(range(16), pa.int32()), "shard": [table.column("shard")[0].as_py()] * 16, "n": [table.num_rows] * 16, "payload": [v.tobytes() for v in flat]})

        return train

    for name, value in (("_trainer", noting), ("ROUNDS", 3), ("PASSES", passes), ("SHARD", 100)):
        monkeypatch.setattr(lm, name, value)
    keys = spark.range(n).select(F.xxhash64("id").alias("key"), F.lit(0).cast("long").alias("n"), F.lit(b"1234").alias("payload"))
    windows = lm.A.stored(keys.withColumn("round", lm._round(F.col("key"), 3)), "round")
    rounds = min(3, n * passes // 256)
    model = lm.fitted(windows, np.ones(lm.IDS))
    assert all(np.allclose(v, lm.Attention().p[k], atol=1e-6) for k, v in model.p.items())
    seen = sorted((int(f.name.split("-")[0]), int(r)) for f in tmp_path.iterdir() for r in f.read_text().split())
    first = lm._round(F.col("key"), rounds)
    want = [keys.select(F.pmod(first + v, F.lit(rounds)), F.xxhash64("key", F.lit(v))).collect() for v in range(passes)]
    assert seen == sorted(tuple(r) for part in want for r in part)


def test_texts_are_read_once_for_both_scores(spark, documents, monkeypatch):
    """What is left to run reads stored rows only; texts in several rows, empty ones and words no training text has are kept apart."""
    rows = [(1, "a b b new new only"), (1, "a b b new new only"), (2, "a only2"), (3, None), (6, "b c"), (6, "b d"), (7, "A B C"), (8, "")]
    df, fold = spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") == 1
    whole = lm.score_texts(df, df.where(~fold), fold)
    monkeypatch.setattr(lm, "FREQUENT", 1)
    apart = lm.score_texts(df, df.where(~fold), fold)
    plain = lambda found: sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 9)) for r in found.collect())
    assert plain(whole) == plain(apart) and [x[:3] for x in plain(apart)] == [(1, 7, 4), (1, 7, 4), (2, 3, 3), (3, 1, 1), (6, 3, 3), (6, 3, 3), (7, 4, 4), (8, 1, 1)]
    assert "MapInArrow" not in apart._jdf.queryExecution().toString()
