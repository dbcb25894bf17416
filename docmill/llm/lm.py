"""Language-model scoring: a causal self-attention model in numpy on subword ids, beside a unigram word model.

The text is lower-cased and split into words; the words' subword ids, then one end, are the tokens of the model.
The model is one attention layer and one small feed-forward layer.  It predicts the class of the next id (the most
frequent ids are classes of their own, the others share classes); within its class an id has its share of all
training texts.  Both parts are normalised, so the score is the log10 probability of the text.

Fitting uses every id of every training text, in the windows that scoring would cut.  Windows are dealt by hash to
rounds and, within a round, to shards of about ``SHARD`` windows.  In a round every shard starts from the same
parameters and takes its own Adam steps in some task; their mean, weighted by windows, starts the next round.  Every
window is seen ``PASSES`` times, however many there are.  Windows are stored once, where they are cut, by the round
that sees them first, so a round reads its own; tables too small for all rounds read their few windows in each.
The number of shards follows from the number of windows alone, so the model does not depend on how many tasks read or fit.

Scoring cuts a text into windows that overlap: the first window scores all its ids, each later one those after the
overlap, so every id is scored once, with at least the overlap as context.  Windows of many texts make one batch.

The word model needs the count of every word of every text.  The most frequent words (at most ``FREQUENT``) go to
the tasks; texts send their other words through a shuffle to the table of counts, one row per text and word.  Each text
is read once for both scores, and its row is kept with those words.

Defined cases: a null or empty text is its end token alone; rows that repeat are scored alike; rows with null id are
left out; without training texts all scores come from an untrained model and n_known is 0.  Words are counted by a
64-bit hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import arrays as A
from docmill.llm.packing import token_ids, word_ids

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
IDS, START, END = 49_408, 49_406, 49_407
ROUNDS, SHARD = 8, 4096
PASSES = 1
#: Parts of the parameters that are averaged on their own.
PARTS = 16
FREQUENT = 1 << 19
WINDOW, OVERLAP = 48, 12
INPUTS, OWN, SHARED, WIDTH, HIDDEN = 4096, 144, 48, 16, 32
#: Values whose exponentials, and sums of them, stay far within float32.
SAFE = 60


class Classes:
    """Classes of ids and each id's share of its class, from the counts of all ids."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        mass = np.cumsum(counts[order][OWN:] + 0.5)
        self.of = np.empty(IDS, np.int32)
        self.of[order[:OWN]] = np.arange(OWN)
        self.of[order[OWN:]] = OWN + np.minimum(SHARED - 1, mass * SHARED / mass[-1]).astype(np.int32)
        total = np.bincount(self.of, weights=counts + 0.5, minlength=OWN + SHARED)
        self.share = np.log((counts + 0.5) / total[self.of])
        self.input = np.full(IDS, INPUTS, np.int32)
        self.input[order[:INPUTS]] = np.arange(INPUTS)


def windows_of(ids: np.ndarray) -> np.ndarray:
    """Starts of the windows over a text's ids."""
    return np.arange(0, max(1, len(ids) - OVERLAP), WINDOW - OVERLAP)


def _safe(m: np.ndarray) -> bool:
    """No value's exponential needs the greatest value taken off first."""
    return m.max(initial=0) <= SAFE and m.min(initial=0) >= -SAFE


class Attention:
    """One causal self-attention layer, a feed-forward layer and class probabilities; float32 throughout."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        init = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        n = OWN + SHARED
        self.p = {
            "embed": (r.standard_normal((INPUTS + 1, WIDTH)) * 0.3).astype(np.float32), "place": (r.standard_normal((WINDOW, WIDTH)) * 0.1).astype(np.float32),
            "q": init(WIDTH, WIDTH), "k": init(WIDTH, WIDTH), "v": init(WIDTH, WIDTH), "o": init(WIDTH, WIDTH) * np.float32(0.5),
            "in": init(WIDTH, HIDDEN), "in_b": np.zeros(HIDDEN, np.float32), "out": init(HIDDEN, WIDTH) * np.float32(0.5),
            "class": init(WIDTH, n) * np.float32(0.5), "class_b": np.zeros(n, np.float32),
        }
        self.seen = np.tri(WINDOW, dtype=np.float32)

    def _weights(self, q: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Attention of the last places ``q`` to all places ``k``, each row up to a factor."""
        a = q @ k.transpose(0, 2, 1)
        seen = self.seen[k.shape[1] - q.shape[1] : k.shape[1], : k.shape[1]]
        if not _safe(a):
            a += (seen - 1) * np.float32(1e9)
            a -= a.max(axis=2, keepdims=True)
            return np.exp(a, out=a)
        np.exp(a, out=a)
        a *= seen
        return a

    def _logits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of ``h`` with a column of ones, and the class logits of each row, up to a shift."""
        m = np.concatenate((self.p["class"], self.p["class_b"][None]))
        h = np.concatenate((h, np.ones((len(h), 1), np.float32)), axis=1)
        d = h @ m
        if not _safe(d):
            d -= d.max(axis=1, keepdims=True)
        return h, d

    def log_probability(self, x: np.ndarray, y: np.ndarray, skip: int = 0) -> np.ndarray:
        """Natural log of the probability of class y at every place from ``skip`` on."""
        p, (n, length), w = self.p, x.shape, WIDTH
        h = p["embed"][x]
        h += p["place"][:length]
        kv = (h.reshape(-1, w) @ np.concatenate((p["k"], p["v"]), axis=1)).reshape(n, length, 2 * w)
        h = np.ascontiguousarray(h[:, skip:]).reshape(-1, w)
        a = self._weights((h @ (p["q"] * np.float32(w**-0.5))).reshape(n, length - skip, w), kv[:, :, :w])
        c = (a @ kv[:, :, w:]).reshape(-1, w)
        c /= (a @ np.ones(length, np.float32)).reshape(-1, 1)
        h += c @ p["o"]
        z = h @ p["in"]
        z += p["in_b"]
        np.maximum(z, 0, out=z)
        h += z @ p["out"]
        _, logits = self._logits(h)
        at = logits[np.arange(len(h)), y[:, skip:].ravel()]
        np.exp(logits, out=logits)
        return (at - np.log(logits @ np.ones(logits.shape[1], np.float32))).reshape(n, length - skip)

    def gradient(self, x: np.ndarray, y: np.ndarray, valid: np.ndarray) -> dict[str, np.ndarray]:
        """The gradient of the mean loss over valid places.

        All places are rows of flat products.  What follows the attention is computed for valid places only, and rows of
        softmax are scaled where they are narrow, in the products on both sides of them.
        """
        p, (n, length), w = self.p, x.shape, WIDTH
        split = lambda m: m.reshape(n, length, -1)
        root, rows = np.float32(w**-0.5), np.flatnonzero(valid)
        h = split(p["embed"][x.ravel()])
        h += p["place"][:length]
        h = h.reshape(-1, w)
        mix = np.concatenate((p["q"] * root, p["k"], p["v"]), axis=1)
        qkv = split(h @ mix)
        qh, kh, vh = qkv[:, :, :w], qkv[:, :, w : 2 * w], qkv[:, :, 2 * w :]
        a = self._weights(qh, kh)
        total = (a @ np.ones(length, np.float32))[:, :, None]
        c = a @ vh
        c /= total
        own = c.reshape(-1, w)[rows]
        h1 = own @ p["o"]
        h1 += h[rows]
        z = h1 @ p["in"]
        z += p["in_b"]
        np.maximum(z, 0, out=z)
        h2 = z @ p["out"]
        h2 += h1
        h2, d = self._logits(h2)
        np.exp(d, out=d)
        per = d @ np.ones(OWN + SHARED, np.float32)
        d[np.arange(len(rows)), y.ravel()[rows]] -= per
        scale = (np.float32(1 / max(1, len(rows))) / per)[:, None]
        h2 *= scale
        of = (d.T @ h2).T
        g = {"class": of[:w], "class_b": of[w]}
        d2 = d @ np.ascontiguousarray(p["class"].T)
        d2 *= scale
        g["out"] = z.T @ d2
        dz = d2 @ p["out"].T
        dz *= z > 0
        g["in"], g["in_b"] = h1.T @ dz, np.ones(len(rows), np.float32) @ dz
        d2 += dz @ p["in"].T
        g["o"] = own.T @ d2
        dc = np.zeros_like(h)
        dc[rows] = d2 @ p["o"].T
        dc = split(dc)
        dc /= total
        dqkv = np.empty_like(qkv)
        np.matmul(a.transpose(0, 2, 1), dc, out=dqkv[:, :, 2 * w :])
        da = dc @ vh.transpose(0, 2, 1)
        da -= np.einsum("ijk,ijk->ij", dc, c)[:, :, None]  # the sum of da * a over a row
        da *= a
        np.matmul(da, kh, out=dqkv[:, :, :w])
        np.matmul(da.transpose(0, 2, 1), qh, out=dqkv[:, :, w : 2 * w])
        dqkv = dqkv.reshape(-1, 3 * w)
        g["q"], g["k"], g["v"] = np.split((dqkv.T @ h).T, 3, axis=1)
        g["q"] = g["q"] * root
        dh = dqkv @ mix.T
        dh[rows] += d2
        g["place"] = np.zeros_like(p["place"])
        g["place"][:length] = split(dh).sum(axis=0)
        cells = (x.reshape(-1, 1) * w + np.arange(w)).ravel()
        g["embed"] = np.bincount(cells, weights=dh.ravel(), minlength=p["embed"].size).astype(np.float32).reshape(-1, w)
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, valid: np.ndarray, epochs: float = 3, batch: int = 32, rate: float = 2e-2, seed: int = 11, part: int = 0, parts: int = 1) -> None:
        """Adam over shuffled windows; the rate falls to nothing over ``parts`` calls, of which this is number ``part``."""
        r, embed = np.random.default_rng(seed), self.p["embed"]
        # inputs that do not occur have no gradient and stay as they are; all other parameters are in one row, so that a step is a few passes over it
        occurs = np.zeros(len(embed), bool)
        occurs[x.ravel()] = True
        used, x = np.flatnonzero(occurs), (np.cumsum(occurs) - 1)[x]
        self.p["embed"] = embed[used]
        flat = self._in_a_row()
        m, v2, change, scale = (np.zeros_like(flat) for _ in range(4))
        steps = math.ceil(epochs * len(x) / batch)
        order = np.concatenate([r.permutation(len(x)) for _ in range(int(epochs) + 1)]) if len(x) else np.zeros(0, int)
        for t in range(1, steps + 1):
            at = order[(t - 1) * batch : t * batch]
            step = rate * (1 - (part + (t - 1) / steps) / parts)
            of = self.gradient(x[at], y[at], valid[at])
            g = np.concatenate([of[k].ravel() for k in self.p])
            # m and v2 are sums, a tenth and a fiftieth of which are the means
            m *= 0.9
            m += g
            v2 *= 0.98
            v2 += np.multiply(g, g, out=g)
            root = math.sqrt(0.02 / (1 - 0.98**t))
            np.sqrt(v2, out=scale)
            scale += 1e-8 / root
            np.multiply(m, 0.1 * step / (1 - 0.9**t) / root, out=change)
            flat -= np.divide(change, scale, out=change)
        embed = embed.copy()
        embed[used] = self.p["embed"]
        self.p["embed"] = embed
        self._in_a_row()

    def _in_a_row(self) -> np.ndarray:
        """All parameters in one row; from now on they are parts of it."""
        flat, at = np.concatenate([v.ravel() for v in self.p.values()]), 0
        for k, v in self.p.items():
            self.p[k], at = flat[at : at + v.size].reshape(v.shape), at + v.size
        return flat


def _ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids in a row, each with its end, and where each text starts."""
    parts = [np.frombuffer(t + END.to_bytes(4, "little"), np.uint32) for t in texts]
    return np.concatenate(parts).astype(np.int32), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


class Scorer:
    """Scores texts with a fitted model."""

    def __init__(self, model: Attention, classes: Classes):
        self.model, self.classes = model, classes

    def scores(self, ids: np.ndarray, at: np.ndarray, batch: int = 64) -> np.ndarray:
        """Log10 probability of every text of a row of ids."""
        starts, ends, of = [], [], []
        for i in range(len(at) - 1):
            s = windows_of(ids[at[i] : at[i + 1]]) + at[i]
            starts.append(s)
            ends.append(np.full(len(s), at[i + 1]))
            of.append(np.full(len(s), i))
        starts, ends, of = np.concatenate(starts), np.concatenate(ends), np.concatenate(of)
        before = np.append(START, ids[:-1])
        before[at[:-1]] = START
        x, y = self.classes.input[before], self.classes.of[ids]
        total = np.bincount(np.repeat(np.arange(len(at) - 1), np.diff(at)), weights=self.classes.share[ids], minlength=len(at) - 1)
        lengths, first = np.minimum(WINDOW, ends - starts), starts == at[of]
        for skip, these in ((0, np.flatnonzero(first)), (OVERLAP, np.flatnonzero(~first))):
            these = these[np.argsort(lengths[these], kind="stable")]  # windows of like length make a batch
            for k in range(0, len(these), batch):
                w = these[k : k + batch]
                length = int(lengths[w].max())
                place = np.minimum(starts[w][:, None] + np.arange(length), len(ids) - 1)
                score = self.model.log_probability(x[place], y[place], skip)
                score *= np.arange(skip, length) < lengths[w][:, None]
                total += np.bincount(of[w], weights=score.sum(axis=1), minlength=len(at) - 1)
        return total / np.log(10)


def _stream(parts: list[bytes], of: np.ndarray, doc: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The start, the ids and the end of every text in a row, and where each text starts; word k of text ``doc[k]`` has the ids ``parts[of[k]]``."""
    flat = np.frombuffer(b"".join(parts), np.uint32)
    size = np.array([len(p) // 4 for p in parts], np.int64)
    first, n = (np.cumsum(size) - size)[of], size[of]
    ids = flat[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    at = np.concatenate(([0], np.cumsum(np.bincount(doc, weights=n, minlength=n_texts).astype(np.int64) + 2)))
    stream = np.empty(at[-1], np.uint16)
    inner = np.ones(at[-1], bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    stream[at[:-1]], stream[at[1:] - 1], stream[inner] = START, END, ids
    return stream, at


def _windows(stream: np.ndarray, at: np.ndarray, doc_ids: np.ndarray) -> pa.RecordBatch:
    """The windows that scoring cuts, each with the id before it, keyed by a hash of the text's id and the place."""
    begin = [windows_of(range(k)) for k in (np.diff(at) - 1).tolist()]
    of = np.repeat(np.arange(len(begin)), [len(b) for b in begin])
    begin = np.concatenate(begin)
    size = np.minimum(WINDOW, at[of + 1] - 1 - at[of] - begin) + 1
    ends = np.cumsum(size)
    data = stream[np.repeat(at[of] + begin - (ends - size), size) + np.arange(ends[-1])]
    payload = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.append(0, 2 * ends).astype(np.int32)), pa.py_buffer(data)])
    key = A.mix(A.mix(doc_ids[of] + A.STEP) + begin.astype(np.uint64)).view(np.int64)
    return _rows(2, key, np.where(begin > 0, OVERLAP, 0), payload)


def _trainer(state, k: int, rounds: int):
    """One shard's steps in round ``k``: the parameters after them, in parts."""
    kept = []  # the classes, for all shards of a task

    def train(table: pa.Table) -> pa.Table:
        parameters, all_counts = state.value
        if not kept:
            kept.append(Classes(all_counts))
        own, classes = Attention(), kept[0]
        own.p = {name: v.copy() for name, v in parameters.items()}
        table = table.sort_by([("rank", "ascending"), ("payload", "ascending")])
        data, at = A.text_buffers(table.column("payload"))
        ids, first, size = data.view(np.uint16), at[:-1] // 2, np.diff(at) // 2 - 1
        place = np.arange(WINDOW)
        inside = place < size[:, None]
        place = np.where(inside, first[:, None] + place, 0)
        x, y = (np.where(inside, of[ids[place + k]], 0) for k, of in enumerate((classes.input, classes.of)))
        valid = inside & (np.arange(WINDOW) >= table.column("n").to_numpy()[:, None])
        own.fit(x, y.astype(np.int64), valid, epochs=1, part=k, parts=rounds)
        flat = np.array_split(np.concatenate([own.p[name].ravel() for name in own.p]), PARTS)
        return pa.table({"part": pa.array(range(PARTS), pa.int32()), "shard": [table.column("shard")[0].as_py()] * PARTS, "n": [table.num_rows] * PARTS, "payload": [v.tobytes() for v in flat]})

    return train


def _round(key, rounds: int):
    """The round that sees a window first."""
    return F.pmod(F.xxhash64(F.xxhash64(key, F.lit(0)), F.lit(3)), F.lit(rounds)).cast("int")


def fitted(windows: DataFrame, counts: np.ndarray) -> Attention:
    """The model after all rounds over ``windows``: a key, the number of ids that are context only, the ids, and ``_round(key, ROUNDS)``.

    The table should be stored in parts by that round.
    """
    context = windows.sparkSession.sparkContext
    model, n = Attention(), windows.count()
    if not n:
        return model
    visits = n * PASSES
    rounds = int(min(ROUNDS, max(1, visits // 256)))
    shards = max(1, round(visits / (rounds * SHARD)))
    first = F.col("round") if rounds == ROUNDS else _round(F.col("key"), rounds)
    for k in range(rounds):
        state = context.broadcast((model.p, counts))
        visits = [windows.where(first == (k - v) % rounds).withColumn("rank", F.xxhash64("key", F.lit(v))) for v in range(PASSES)]
        now = reduce(DataFrame.unionAll, visits).withColumn("shard", F.pmod(F.xxhash64("rank", F.lit(2)), F.lit(shards))).select("shard", "rank", "n", "payload")
        found = now.groupBy("shard").applyInArrow(_trainer(state, k, rounds), "part int, shard long, n long, payload binary")
        mean = {r.part: np.frombuffer(r.payload, np.float32) for r in found.groupBy("part").applyInArrow(_mean, "part int, payload binary").collect()}
        if mean:
            flat, at = np.concatenate([mean[i] for i in range(PARTS)]), 0
            for name, v in model.p.items():
                model.p[name] = flat[at : at + v.size].reshape(v.shape)
                at += v.size
        state.unpersist()
    return model


def _mean(table: pa.Table) -> pa.Table:
    """The mean of one part of the parameters over the shards, weighted by windows; added in the shards' order."""
    table = table.sort_by("shard")
    n, total = table.column("n").to_numpy(), 0.0
    for weight, payload in zip(n.tolist(), table.column("payload"), strict=True):
        total = total + weight / n.sum() * np.frombuffer(payload.as_py(), np.float32).astype(np.float64)
    return pa.table({"part": table.column("part")[:1], "payload": [total.astype(np.float32).tobytes()]})


def score_texts(docs: DataFrame, train: DataFrame, held_out) -> DataFrame:
    """Word-model and attention-model scores of all ``docs``, learnt from the rows of ``train``."""
    spark = docs.sparkSession
    tidy = lambda d: d.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    docs, train = tidy(docs), tidy(train)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kind 0: a word and its count; kind 1: an id and its count; kind 2: a window by its hash, and its ids that an earlier window has."""
        counts, words_seen = np.zeros(IDS), []
        for rows, data, offsets in A.slices(batches):
            starts, ends, doc = A.words(data, offsets)
            h, first, of, n = np.unique(A.word_hashes(data, starts, ends, lower=True), return_index=True, return_inverse=True, return_counts=True)
            words_seen.append((h, n))
            if sum(len(x) for x, _ in words_seen) > 500_000:
                words_seen = [_merged(words_seen)]
                if len(words_seen[0][0]) > 1_000_000:
                    yield _rows(0, words_seen[0][0].astype(np.int64), words_seen[0][1])
                    words_seen = []
            raw = A.LOWER[data].tobytes()
            distinct = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            known = word_ids(distinct, VOCABULARY)
            stream, at = _stream([known[w] for w in distinct], of, doc, rows.num_rows)
            counts += np.bincount(np.delete(stream, at[:-1]), minlength=IDS)
            yield _windows(stream, at, rows.column("doc_id").to_numpy().astype(np.uint64))
        if words_seen:
            h, n = _merged(words_seen)
            yield _rows(0, h.astype(np.int64), n)
        at = np.flatnonzero(counts)
        yield _rows(1, at, counts[at].astype(np.int64))

    found = train.mapInArrow(gather, "kind int, key long, n long, payload binary")
    found = A.stored(found.withColumn("round", F.when(F.col("kind") == 2, _round(F.col("key"), ROUNDS)).otherwise(-1)), "round")
    words = A.stored(found.where("round = -1 and kind = 0").groupBy("key").agg(F.sum("n").alias("n")))
    n_docs = train.count()
    totals = words.agg(F.sum("n"), F.count("*")).first()
    n_train, distinct = (totals[0] or 0) + n_docs, totals[1] + (1 if n_docs else 0)
    base = n_train + 0.5 * (distinct + 1)

    counts = np.zeros(IDS)
    for r in found.where("round = -1 and kind = 1").groupBy("key").agg(F.sum("n").alias("n")).collect():
        counts[r.key] = r.n
    model = fitted(found.where("round >= 0").select("key", "n", "payload", "round"), counts)

    top = words.orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
    top = top.sort_by("key")
    frequent = spark.sparkContext.broadcast((top.column("key").to_numpy().copy(), top.column("n").to_numpy().copy()))
    scorer = spark.sparkContext.broadcast((model.p, counts))
    end_part = float(np.log10((n_docs + 0.5) / base))
    row_key = F.xxhash64("doc_id", "text")

    def looked_up(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, n = frequent.value
        if not len(keys):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        distinct, of = np.unique(h, return_inverse=True)  # sorted ones are found faster
        at = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
        return (keys[at] == distinct)[of], n[at][of]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parameters, all_counts = scorer.value
        own = Attention()
        own.p = parameters
        judge = Scorer(own, Classes(all_counts))
        for rows, data, offsets in A.slices(batches):
            starts, ends, doc = A.words(data, offsets)
            h = A.word_hashes(data, starts, ends, lower=True).astype(np.int64)
            known, n = looked_up(h)
            size = rows.num_rows
            n_words = np.bincount(doc, minlength=size)
            part = np.bincount(doc[known], weights=np.log10((n[known] + 0.5) / base), minlength=size).astype(np.float64)
            n_known = np.bincount(doc[known], minlength=size)
            scores = [judge.scores(*_ids(texts)) for _, texts in token_ids([rows], VOCABULARY)]
            order = np.lexsort((h[~known], doc[~known]))
            h, doc = h[~known][order], doc[~known][order]
            at = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)])
            first = pa.array(np.searchsorted(doc[at], np.arange(size + 1)).astype(np.int32))
            others = [pa.ListArray.from_arrays(first, pa.array(x)) for x in (h[at], np.diff(np.append(at, len(h))))]
            yield pa.record_batch(
                [rows.column("doc_id"), rows.column("key"), pa.array(n_words + 1), pa.array(n_known), pa.array(part), pa.array(np.concatenate(scores)), *others],
                names=["doc_id", "key", "n_tokens", "n_known", "part", "score", "word", "k"],
            )

    keyed = docs.withColumn("key", row_key)
    scored = A.stored(keyed.mapInArrow(score, "doc_id long, key long, n_tokens long, n_known long, part double, score double, word array<long>, k array<long>"))
    others = scored.select("key", F.explode(F.arrays_zip("word", "k")).alias("other")).select("key", "other.*").join(words.toDF("word", "n"), "word")
    others = others.groupBy("word", "key", "k", "n").count()  # rows that repeat
    more = others.groupBy("key").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10((F.col("n") + 0.5) / base)).alias("more_part"))
    out = scored.drop("word", "k").join(more, "key", "left")
    n_known = F.col("n_known") + F.coalesce("more", F.lit(0)) + (1 if n_docs else 0)
    known_part = F.col("part") + F.coalesce("more_part", F.lit(0.0)) + (end_part if n_docs else 0.0)
    unknown = (F.col("n_tokens") - n_known) * float(np.log10(0.5 / base))
    return out.select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        n_known.cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (known_part + unknown).alias("base_score"),
        "score",
    )


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and their summed counts."""
    h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    at = A.heads(h)
    return h[at], np.add.reduceat(n, at)


def _rows(kind: int, key: np.ndarray, n: np.ndarray, payload: pa.Array | None = None) -> pa.RecordBatch:
    payload = payload if payload is not None else pa.nulls(len(key), pa.binary())
    return pa.record_batch([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(n), payload], names=["kind", "key", "n", "payload"])
