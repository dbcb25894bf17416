"""Substring dedup, exact dedup and the Jaccard join against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from docmill.llm import arrays, exact, graph, jaccard, repeats

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    raw = (text or "").encode()
    return WORD.findall(raw.lower() if lower else raw)


def cut_repeats(rows, window):
    least, out = {}, Counter()
    rows = [(i, words(t)) for i, t in rows if i is not None]
    for i, w in rows:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(i, least.get(key, i))
    for i, w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[(i, len(w), sum(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("window,block", [(50, 25), (20, 10), (20, 7)])
def test_repeats(documents, window, block):
    rows, df = documents
    found = repeats.find_repeats(df, window, block).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == cut_repeats(rows, window)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in found)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in found)


def test_repeats_odd(odd, odd_rows, none):
    found = repeats.find_repeats(odd).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == cut_repeats(odd_rows, 50)
    assert repeats.find_repeats(none).count() == 0
    with pytest.raises(ValueError):
        repeats.find_repeats(odd, 30, 25)


def equal_groups(rows):
    groups, out = defaultdict(list), Counter()
    for i, t in rows:
        groups[t or ""].append(i)
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            alone = len(ids) == 1
            out[(i, i if alone else keep, len(ids), i is not None and i == (i if alone else keep), hashlib.sha256(t.encode()).hexdigest())] += 1
    return out


def test_exact(documents, odd, odd_rows, none):
    rows, df = documents
    for table, want in ((df, rows), (odd, odd_rows)):
        got = exact.exact_groups(table).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == equal_groups(want)
    assert exact.exact_groups(none).count() == 0


def test_chunks_join_up(spark, documents):
    from pyspark.sql import functions as F

    _, df = documents
    assert df.where(F.array_join(exact.chunks(F.col("text"), 16, 64), "") != F.col("text")).count() == 0


def test_doubtful_hashes(spark, odd, odd_rows, monkeypatch):
    """Where one hash stands for several contents, the content's digest takes part."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact.F, "xxhash64", lambda c: F.length(c).cast("long"))
    rows = [r for r in odd_rows if r[0] is not None] + [(20, "cd"), (21, "ef"), (22, "cd")]
    got = exact.exact_groups(odd.sparkSession.createDataFrame(rows, "doc_id long, text string")).collect()
    monkeypatch.undo()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == equal_groups(rows)


def linked_components(rows, n=5):
    sets, parent = defaultdict(list), {}
    for i, t in rows:
        if i is not None:
            w = words(t, True)
            sets[i].append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    parent = {i: i for i in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    flat = [(i, s) for i in sorted(sets) for s in sets[i] if s]
    for x, (i, a) in enumerate(flat):
        for j, b in flat[:x]:
            if 100 * len(a & b) >= 75 * len(a | b) and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return Counter((i, len(s), root(i) if s else i) for i in sets for s in sets[i])


def test_jaccard(documents, odd, odd_rows, none):
    rows, df = documents
    for table, want in ((df, rows), (odd, odd_rows)):
        got = jaccard.jaccard_classes(table).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == linked_components(want)
    assert jaccard.jaccard_classes(none).count() == 0


def test_jaccard_chains_and_borders(spark):
    """Chains of edits, sets at the very border, small sets of all sizes and a passage in many texts."""
    rng = np.random.default_rng(5)
    rows, passage = [], [f"p{i}" for i in range(40)]
    for f in range(25):
        base = [f"f{f}w{i}" for i in range(int(rng.integers(5, 90)))]
        for v in range(8):
            rows.append((len(rows), " ".join(base)))
            base = base.copy()
            base[int(rng.integers(len(base)))] = f"new{f}_{v}"
            if v % 3 == 2:
                base = base[: max(3, len(base) - 2)]
    for k in range(40):
        rows.append((len(rows), " ".join([*(f"a{k}_{i}" for i in range(k)), *passage])))
    for k in range(1, 16):
        rows += [(len(rows), " ".join(f"s{i}" for i in range(k))), (len(rows) + 1, " ".join(f"S{i}" for i in range(k + 1)))]
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == linked_components(rows)


@pytest.mark.parametrize("cold, block", [(6, 512), (2, 7)])
def test_jaccard_in_large_groups(spark, monkeypatch, cold, block):
    """Passages that many texts share beside own words, and near copies of one text around the threshold."""
    monkeypatch.setattr(jaccard, "COLD", cold)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(7)
    passage, base, rows = [f"p{i}" for i in range(60)], [f"b{i}" for i in range(150)], []
    for k in range(60):
        own = [f"o{k}_{i}" for i in range(int(rng.integers(0, 120)))]
        at = int(rng.integers(len(own) + 1))
        rows.append([*own[:at], *passage, *own[at:]])
    for k in range(70):
        copy = base.copy()
        for i in rng.choice(len(base), int(rng.integers(0, 9)), replace=False):
            copy[i] = f"e{k}_{i}"
        rows.append(copy[: int(rng.integers(135, 151))])
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = linked_components(rows)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert len({c for _, _, c in want}) > 10


def pairs_at_the_border(rng, rounds):
    """Two sets that just reach the threshold, of all sizes."""
    for _ in range(rounds):
        a = int(rng.integers(1, 120))
        x = rng.integers(0, 2**63, a).astype(np.uint64)
        b = int(rng.integers(a, 4 * a // 3 + 1))
        common = -(-3 * (a + b) // 7)
        if common <= a:
            yield np.sort(x), np.sort(np.append(x[:common], rng.integers(0, 2**63, b - common).astype(np.uint64)))


def test_signatures_lose_no_pair():
    """Of any two sets that reach the threshold, each shares all but as many parts as they can differ in members."""
    for x, y in pairs_at_the_border(np.random.default_rng(9), 400):
        sig, owner, up, kind = jaccard.signatures(np.concatenate([x, y]), np.repeat([0, 1], [len(x), len(y)]))
        mine, other = set(sig[owner == 0].tolist()), set(sig[owner == 1].tolist())
        if len(x) == len(y) and (x == y).all():
            continue
        assert mine & other, (len(x), len(y))
        if max(len(x), len(y)) <= jaccard.SMALL:
            assert set(sig[(owner == 0) & (kind == jaccard.ALL)].tolist()) & set(sig[(owner == 1) & (kind == jaccard.DELETION)].tolist())
            continue
        agree = False
        for u in (0, 1):
            for v in (0, 1):
                p, q = (set(sig[(owner == w) & (up == k) & (kind == jaccard.PART)].tolist()) for w, k in ((0, u), (1, v)))
                if p & q:
                    agree |= len(p & q) >= len(p) - jaccard.most_different(np.array([len(x)]), u)[0] and len(p & q) >= len(q) - jaccard.most_different(np.array([len(y)]), v)[0]
        assert agree, (len(x), len(y))


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(11)
    for x, y in pairs_at_the_border(rng, 300):
        found = int(jaccard.distance(*jaccard.folded([jaccard.parity(x), jaccard.parity(y)])))
        assert found <= len(np.setxor1d(x, y))
    x, y = rng.integers(0, 2**63, 300).astype(np.uint64), rng.integers(0, 2**63, 320).astype(np.uint64)
    assert 7 * int(jaccard.distance(*jaccard.folded([jaccard.parity(x * np.uint64(2)), jaccard.parity(y * np.uint64(2))]))) > 620


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (101, 100), (7, 300), (500, 500)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 300: 0, 100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("most", [5, 1000])
def test_components_in_rounds(spark, monkeypatch, most):
    """Chains, stars and single edges in any order, in many tasks and in one."""
    monkeypatch.setattr(graph, "EDGES", most)
    rng = np.random.default_rng(3)
    names = rng.permutation(1000).tolist()
    edges = [(names[i], names[i + 1]) for i in range(60)] + [(names[100], names[i]) for i in range(101, 140)] + [(names[i], names[i + 1]) for i in range(200, 240, 2)]
    want = {names[i]: min(part) for part in (names[:61], names[100:140], *(names[i : i + 2] for i in range(200, 240, 2))) for i in map(names.index, part)}
    rng.shuffle(edges)
    assert dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect()) == want


def test_few_edges_take_few_tasks(spark):
    """Rounds over a small table don't grow with the number of shuffle partitions."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long").coalesce(1)
    held = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    context = spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup("few-edges", "")
        assert {r.component for r in graph.components(edges).collect()} == {0}
        tracker = context.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("few-edges") for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert 0 < tasks < 61


def test_words_and_messages():
    texts = ["a b\tc", "", "  dd", "e", None, "\x0b f\x1cg h"]
    import pyarrow as pa

    data, offsets = arrays.text_buffers(pa.array(texts))
    s, e, doc = arrays.words(data, offsets)
    assert [(d, data[x:y].tobytes()) for x, y, d in zip(s, e, doc.tolist())] == [
        (i, w) for i, t in enumerate(texts) for w in words(t)
    ]
    h = arrays.word_hashes(data, s, e, chunk=2)
    assert len(set(h.tolist())) == len(h) and (h == arrays.word_hashes(data, s, e)).all()
    assert [len(x) for x in arrays.unpack(arrays.pack(h, s.astype(np.int32), h[:0]))] == [len(h), len(h), 0]
    assert (arrays.unpack(arrays.pack(h, s))[0] == h).all()
    w = arrays.windows(np.arange(50, dtype=np.uint64) % np.uint64(7), 5)
    assert len(w) == 46 and w[0] == w[7] and len(set(w.tolist())) == 7
