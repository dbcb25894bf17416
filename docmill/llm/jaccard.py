"""N-gram Jaccard join: documents whose word-shingle sets overlap by 3/4 or more are linked, exactly.

Two sets of sizes a <= b that reach the threshold have b <= 4a/3 and differ in at most D = (a + b) / 7 members.

Universe partition.  Sizes fall into bands that double.  Each band cuts the universe of shingles into segments by
hash; a set's part in a segment is one signature, and a set sends the signatures of all its T parts that are not empty.
Of two partners at most D parts of either differ, so T - D or more agree.  A set also enters the next band if a partner
can lie there.

Cost-based allocation.  A signature that more than ``COLD`` classes share (a common line or passage) would cost the
square of their number.  After all signatures have been counted, a set may do without its shared ones if the others are
more than D: then it agrees with every partner in one of the others.  So a pair is lost only if neither set can do
without, and the groups of shared signatures keep just those sets.  The number of segments is the one that leaves sets
at both ends of a band enough parts to spare at the least number of signatures.

One-deletion neighbourhoods.  Sets of up to ``SMALL`` members take the whole set and each set without one member as
signatures; two of them that reach the threshold differ in one member at most, so one's whole is the other's deletion.

Candidates.  Equal sets are one class.  All pairs of a group of up to ``COLD`` classes are candidates.  Of a larger group
the pivot is the class with most shared signatures, that is, the least edited of a group of copies.  Each class
is first verified with the pivot it shares most signatures with, then with its other pivots if it is
not in their component yet.  Pairs of a group are verified where that leaves the group in several components.  So no link is lost, and a group of copies
costs about as many pairs as it has members.

Verification.  Candidates of unfitting sizes go at once.  Then sketches of the two sets are compared, a bit for each range of
hashes that says whether the set has an odd number of members there; they differ in no more bits than the sets in
members.  Only what passes is compared on the full sets.

Skew: equal sets and equal signatures of a slice of text are joined there, and one entry stands for them.

Defined cases: null or blank text has no shingles and no links; fewer words than the shingle size make one shingle
of all words; rows with null id are left out; rows that repeat an id count as one document; other columns are ignored,
whatever their names.  Words, sets and classes
are compared by 64-bit hashes, of which verification uses 48 bits within a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm import arrays as A
from docmill.llm.graph import components

SMALL = 6
#: Up to so many classes with one signature are all compared with one another.
COLD = 6
#: Members of a large group that one task compares with as many others.
BLOCK = 512
ENTRY = "bucket int, kind int, payload binary"
FOUND = "kind int, sig long, slice long, row int, key long, n int, up int, spare int"
MEMBER, ENTRIES, ROW = 0, 1, 2
#: A signature is a part of a set, a small set without one member, or all of a small set.
PART, DELETION, ALL = 0, 1, 2
MANY = 8
U = np.uint64
STEP = U(0x2545F4914F6CDD1D)


def segment_count(high: np.ndarray) -> np.ndarray:
    """Segments of a band of sizes up to ``high``: with so many a set of any size in it has a seventh of its parts or more to spare."""
    return 3 * high // 5 + 2


def bands(size: np.ndarray) -> np.ndarray:
    """Number of the band of each size of ``SMALL`` or more."""
    return np.floor(np.log2(np.maximum(size, SMALL) / SMALL + 1e-12)).astype(int)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as 64-bit hashes, sorted within the text, and the text's number beside each."""
    starts, ends, doc = A.words(data, offsets)
    h = A.word_hashes(data, starts, ends, lower=True)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    w = A.windows(h, n)
    inside = doc[: len(w)] == doc[n - 1 :][: len(w)]
    tokens, of = [w[inside]], [doc[: len(w)][inside]]
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        if len(short):
            tokens.append(A.windows(h, k)[first[short]] + U(k))
            of.append(short)
    tokens, of = np.concatenate(tokens), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    tokens, of = tokens[order], of[order]
    at = A.heads(of).tolist()
    for s, e in zip(at, [*at[1:], len(of)]):  # noqa: B905
        tokens[s:e].sort()
    new = np.append(True, (tokens[1:] != tokens[:-1]) | (of[1:] != of[:-1]))[: len(tokens)]
    return tokens[new], of[new]


def set_keys(tokens: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each text that has shingles, its set's size, and one hash of the whole set."""
    at = A.heads(of)
    if not len(at):
        return at, at, np.zeros(0, U)
    size = np.diff(np.append(at, len(of)))
    total = np.add.reduceat(A.mix(tokens), at)
    other = np.bitwise_xor.reduceat(A.mix(tokens ^ A.BASE), at)
    return of[at], size, A.mix(total + A.mix(other + A.mix(size.astype(U))))


def signatures(tokens: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, ...]:
    """Signatures of the sets (see above), the number of the text of each, whether it is of the next band, and what it is: ``PART``, ``DELETION`` or ``ALL``."""
    doc, size, _ = set_keys(tokens, of)
    if not len(doc):
        return np.zeros(0, U), doc, np.zeros(0, np.int8), np.zeros(0, np.int8)
    begin = A.heads(of)
    sigs, owner, ups, kinds = [], [], [], []
    part = A.mix(tokens ^ STEP)
    for s, d, n in zip(begin[size <= SMALL].tolist(), doc[size <= SMALL].tolist(), size[size <= SMALL].tolist(), strict=True):
        if n > 2:  # smaller sets have no partners but their equals
            whole = part[s : s + n].sum(dtype=U)
            sigs.append(A.mix(np.append(whole - part[s : s + n], whole)))
            owner.append(np.full(n + 1, d))
            ups.append(np.zeros(n + 1, np.int8))
            kinds.append(np.append(np.full(n, DELETION, np.int8), np.int8(ALL)))
    band = bands(size)
    for up in (0, 1):
        low = SMALL * 2 ** (band + up)
        high = 2 * low - 1
        take = (size >= SMALL) & (np.minimum(high, 4 * size // 3) >= low)
        if not take.any():
            continue
        m = segment_count(high[take]).astype(U)
        which = np.repeat(take, size)
        set_no = np.repeat(np.arange(len(m)), size[take])
        key = (set_no << 32) | (tokens[which] % m[set_no]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = A.heads(key)
        value, key = np.add.reduceat(part[which][order], at), key[at]
        set_no = key >> 32
        label = (low[take][set_no].astype(U) << U(32)) + (key & 0xFFFFFFFF).astype(U)
        sigs.append(A.mix(value + A.mix(label)))
        owner.append(doc[take][set_no])
        ups.append(np.full(len(set_no), up, np.int8))
        kinds.append(np.full(len(set_no), PART, np.int8))
    if not sigs:
        return np.zeros(0, U), doc[:0], np.zeros(0, np.int8), np.zeros(0, np.int8)
    return tuple(np.concatenate(x) for x in (sigs, owner, ups, kinds))


def most_different(size: np.ndarray, up: int) -> np.ndarray:
    """In how many members a set can differ from a partner of its own band, or of the next one."""
    return (size + np.minimum(2 * SMALL * 2 ** (bands(size) + up) - 1, 4 * size // 3)) // 7


def sketch_bits(size: int) -> int:
    """Bits of a set's sketch: four for each member that the largest set of its band has."""
    return max(6, (8 * SMALL << int(bands(np.array([size]))[0])).bit_length())


def parity(tokens: np.ndarray) -> bytes:
    """For each range of hashes whether it holds an odd number of the set's members."""
    bits = sketch_bits(len(tokens))
    odd = np.bincount((tokens >> U(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches of one length, that of the shortest, as rows of 64-bit words."""
    least = min(map(len, sketches))
    out = np.empty((len(sketches), least), np.uint8)
    for i, x in enumerate(sketches):
        x = np.frombuffer(x, np.uint8)
        if len(x) > least:
            odd = np.unpackbits(x, bitorder="little").reshape(least * 8, -1).sum(1) & 1
            x = np.packbits(odd.astype(np.uint8), bitorder="little")
        out[i] = x
    return out.view(np.uint64)


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A lower bound of the number of members in which sets differ: ranges of which one has an odd and the other an even number."""
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)


def packed_set(tokens: np.ndarray) -> bytes:
    """A sorted set as byte planes of the upper 48 bits of its hashes."""
    return (tokens >> U(16)).view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def unpacked_set(value) -> np.ndarray:
    planes = np.frombuffer(value, np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :6] = planes.T
    return out.view(U).ravel()


def jaccard_classes(docs: DataFrame, n: int = 5) -> DataFrame:
    """One row per document: size of its set, its component's smallest id, and its class of equal sets."""
    spark = docs.sparkSession
    buckets = A.bucket_count(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in A.slices(batches):
            tokens, of = shingle_sets(data, offsets, n)
            doc, size, key = set_keys(tokens, of)
            at = np.append(A.heads(of), len(of))
            sizes, keys, counts = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, U), [None] * rows.num_rows
            sizes[doc], keys[doc] = size, key
            for i, d in enumerate(doc.tolist()):
                counts[d] = parity(tokens[at[i] : at[i + 1]])
            yield pa.record_batch(
                [rows.column("doc_id"), pa.array(sizes), pa.array(keys.astype(np.int64)), pa.array(counts, pa.binary())], names=["doc_id", "n_shingles", "key", "counts"]
            )

    found_sets = A.stored(docs.mapInArrow(summarize, "doc_id long, n_shingles long, key long, counts binary"))
    sets = found_sets.drop("counts")
    classes = sets.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in A.slices(batches):
            tokens, of = shingle_sets(data, offsets, n)
            doc, size, key = set_keys(tokens, of)
            _, one = np.unique(key, return_index=True)
            mine = np.zeros(rows.num_rows, bool)
            mine[doc[one]] = True
            keys, sizes = np.zeros(rows.num_rows, U), np.zeros(rows.num_rows, np.int32)
            keys[doc], sizes[doc] = key, size
            sig, owner, up, kind = signatures(tokens[mine[of]], of[mine[of]])
            if not len(sig):
                continue
            # the slice's name comes from what is in it, in order
            name = A.mix(np.add.reduce(A.mix(keys + np.arange(len(keys), dtype=U)), keepdims=True))[0]
            # parts beyond those in which a partner can differ
            spare = [(np.bincount(owner[(up == u) & (kind == PART)], minlength=len(keys)) - most_different(sizes.astype(np.int64), u)).astype(np.int32) for u in (0, 1)]
            out = [(int(name % U(buckets)), ROW, A.pack(name[None], keys[mine], sizes[mine], np.flatnonzero(mine).astype(np.uint16), spare[0][mine], spare[1][mine]))]
            order = np.lexsort((owner, sig))
            sig, owner, up, kind = sig[order], owner[order].astype(np.uint16), up[order], kind[order]
            at = A.heads(sig)
            length = np.diff(np.append(at, len(sig)))
            head = np.zeros(len(sig), bool)
            head[at] = True
            # members of a signature's group in this slice beside the first
            flags = (up + 2 * kind).astype(np.uint8)
            if not head.all():
                out.append((int((name >> U(32)) % U(buckets)), MEMBER, A.pack(name[None], sig[~head], owner[~head], flags[~head])))
            flags[at] += (MANY * (length > 1)).astype(np.uint8)
            bucket = ((sig[at] >> U(32)) % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for b, (s, o, f) in A.by_bucket(bucket[order], (sig[at] & U(0xFFFFFFFF)).astype(np.uint32)[order], owner[at][order], flags[at][order]):
                by = np.argsort(s, kind="stable")
                odd = np.flatnonzero(f[by])  # most have no flag
                out.append((b, ENTRIES, A.pack(name[None], s[by], o[by], odd.astype(np.uint32), f[by][odd])))
            cols = list(zip(*out, strict=True))
            yield pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["bucket", "kind", "payload"])

    def match(bucket: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Members of signatures with two classes or more, and the rows that signatures name."""
        out = []

        def put(kind: int, **columns: np.ndarray) -> None:
            m = len(next(iter(columns.values())))
            out.append([np.full(m, kind, np.int32)] + [columns.get(c, np.zeros(m, np.int64)) for c in ("sig", "slice", "row", "key", "n", "up", "spare")])

        sig, name, row, flag = [], [], [], []
        for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist(), strict=True):
            values = A.unpack(payload)
            here = values[0].view(np.int64)
            if kind == ROW:
                for up in (0, 1):
                    put(ROW, slice=np.repeat(here, len(values[1])), row=values[3], key=values[1].view(np.int64), n=values[2], up=np.full(len(values[1]), up), spare=values[4 + up])
            elif kind == MEMBER:
                full = _group((values[1] >> U(32)) % U(buckets), values[1])
                put(MEMBER, sig=full, slice=np.repeat(here, len(full)), row=values[2], up=values[3])
            else:
                sig.append(values[1].astype(U))
                name.append(np.repeat(here, len(values[1])))
                row.append(values[2])
                f = np.zeros(len(values[1]), np.uint8)
                f[values[3]] = values[4]
                flag.append(f)
        if sig:
            sig, name, row, flag = (np.concatenate(x) for x in (sig, name, row, flag))
            order = np.argsort(sig, kind="stable")
            s = sig[order]
            same = s[1:] == s[:-1]
            shared = np.append(False, same) | np.append(same, False) | (flag[order] >= MANY)
            keep = order[shared]
            put(MEMBER, sig=_group(np.full(len(keep), bucket[0].as_py(), U), sig[keep]), slice=name[keep], row=row[keep], up=flag[keep] & (MANY - 1))
        names = ["kind", "sig", "slice", "row", "key", "n", "up", "spare"]
        types = [np.int32, np.int64, np.int64, np.int32, np.int64, np.int32, np.int32, np.int32]
        return pa.table({c: np.concatenate([o[i] for o in out] or [np.zeros(0)]).astype(t) for i, (c, t) in enumerate(zip(names, types, strict=True))})

    found = A.stored(docs.mapInArrow(sign, ENTRY).groupBy("bucket").applyInArrow(match, FOUND))
    # flags of a member: the lowest bit for the next band, then what the signature is
    member = found.where(F.col("kind") == MEMBER).select("sig", "slice", "row", F.col("up").bitwiseAND(1).alias("up"), F.shiftright("up", 1).alias("what"))
    named = found.where(F.col("kind") == ROW).select("slice", "row", "up", "key", "n", "spare").distinct()
    member = A.stored(member.join(named, ["slice", "row", "up"]).select("sig", "key", "up", "n", "spare", "what").distinct())
    total = member.where(F.col("what") == PART).groupBy("sig").agg(F.count("*").alias("g"))

    usual, less, whole = (member.where(F.col("what") == k) for k in (PART, DELETION, ALL))
    near = lambda a, b: 3 * F.greatest(a, b) <= 4 * F.least(a, b)
    # the whole of one small set is another's set without one member
    pairs = whole.select("sig", F.col("key").alias("a")).join(less.select("sig", F.col("key").alias("b")), "sig").where("a <> b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # groups of few classes: every pair
    few = usual.join(total.where(F.col("g") <= COLD).select("sig"), "sig")
    lists = few.groupBy("sig").agg(F.collect_set(F.struct("key", "n")).alias("m"))
    cold = lists.select(F.explode("m").alias("x"), "m").select("x", F.explode(F.filter("m", lambda y: y["key"] > F.col("x.key"))).alias("y"))
    cold = cold.where(near(F.col("x.n"), F.col("y.n"))).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
    pairs = A.stored(pairs.union(cold).distinct())
    # groups of many: only of classes that cannot do without them
    hot = A.stored(usual.join(total.where(F.col("g") > COLD).select("sig"), "sig").select("sig", "key", "up", "n", "spare"))
    held = hot.groupBy("key", "up", "spare").agg(F.count("*").alias("held"))
    needy = held.where("held >= spare").select("key", "up", "held")
    group = A.stored(hot.join(needy, ["key", "up"]).select("sig", "key", "up", "n", "spare", "held"))
    pivot = group.groupBy("sig").agg(F.max(F.struct("held", "key", "n")).alias("p")).select("sig", F.col("p.key").alias("a"), F.col("p.n").alias("size_a"))
    spokes = group.select("sig", F.col("key").alias("b"), F.col("n").alias("size_b")).join(pivot, "sig").where("a <> b").where(near(F.col("size_a"), F.col("size_b")))
    spokes = A.stored(spokes.groupBy("a", "b").count())

    sketch = found_sets.where("n_shingles > 0").join(classes.select("key", F.col("rep").alias("doc_id")), ["key", "doc_id"]).dropDuplicates(["key"])
    sketch = A.stored(sketch.select("key", F.col("n_shingles").alias("n"), "counts"))

    def maybe(pairs: DataFrame) -> DataFrame:
        """Pairs whose histograms allow a link."""

        def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fits = [7 * int(distance(*folded([x, y]))) <= a + b for x, y, a, b in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "n_a", "n_b")), strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

        sized = pairs.join(sketch.toDF("a", "n_a", "x"), "a").join(sketch.toDF("b", "n_b", "y"), "b")
        return sized.select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(close, "a long, b long")

    hubs = A.stored(maybe(spokes.select("a", "b")).join(spokes, ["a", "b"]))
    pairs = A.stored(maybe(pairs))
    likely = pairs.union(hubs.select("a", "b"))
    involved = likely.select("a").union(likely.select("b")).union(group.select("key")).toDF("key").distinct()
    texts = docs.join(involved.join(classes, "key").select("key", F.col("rep").alias("doc_id")), "doc_id")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in A.slices(batches):
            tokens, of = shingle_sets(data, offsets, n)
            doc, _, key = set_keys(tokens, of)
            at = np.append(A.heads(of), len(of))
            right = rows.column("key").to_numpy().view(U)[doc] == key  # of rows that share an id
            sets = [packed_set(tokens[at[i] : at[i + 1]]) for i in np.flatnonzero(right)]
            yield pa.record_batch([pa.array(key[right].astype(np.int64)), pa.array(sets, pa.binary())], names=["key", "set"])

    members = A.stored(texts.mapInArrow(full, "key long, set binary"))

    def linked(pairs: DataFrame) -> DataFrame:
        left, right = members.toDF("a", "set_a"), members.toDF("b", "set_b")

        def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                    x, y = unpacked_set(x.as_buffer()), unpacked_set(y.as_buffer())
                    joined = np.concatenate((x, y))
                    joined.sort()
                    both = int((joined[1:] == joined[:-1]).sum())
                    keep.append(100 * both >= 75 * (len(x) + len(y) - both))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return pairs.join(right, "b").join(left, "a").select("a", "b", "set_a", "set_b").mapInArrow(overlap, "a long, b long")

    def grouped(links: DataFrame, before: DataFrame | None = None) -> DataFrame:
        """Components by the links and by those found before."""
        node = classes.select("key", "rep")
        edges = links.join(node.toDF("a", "u"), "a").join(node.toDF("b", "v"), "b").select("u", "v")
        return components(edges if before is None else edges.union(before))

    # first each class with the pivot it shares most signatures with, then other pivots where that left them apart
    first = hubs.groupBy("b").agg(F.max_by("a", F.struct("count", "a")).alias("a")).select("a", "b")
    groups = grouped(linked(pairs.union(first).distinct()))

    def labelled(groups: DataFrame) -> DataFrame:
        node = classes.join(group.select("key").distinct(), "key").join(groups, F.col("rep") == F.col("node"), "left")
        return A.stored(node.select("key", F.coalesce("component", "rep").alias("component")))

    ends = labelled(groups)
    apart = hubs.select("a", "b").join(ends.toDF("a", "left"), "a").join(ends.toDF("b", "right"), "b").where("left <> right")
    apart = A.stored(apart.select("a", "b").join(first, ["a", "b"], "left_anti"))
    if not apart.isEmpty():
        groups = grouped(linked(apart), groups)
        ends = labelled(groups)
    # Then, in groups that are not one component yet, the pairs across components.  Two classes that are not in a small
    # group together share at least ``spare`` of their signatures held here, so one of the rarest ``held - spare + 1``.
    rarity = group.groupBy("sig").agg(F.count("*").alias("g"))
    order = Window.partitionBy("key", "up").orderBy("g", "sig")
    rarest = group.join(rarity, "sig").withColumn("place", F.row_number().over(order)).where("place <= held - spare + 1")
    inside = rarest.select("sig", "key", "n").join(ends, "key")
    open_groups = inside.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("sig")
    inside = inside.join(open_groups, "sig").join(sketch.select("key", "counts"), "key")
    # blocks of about BLOCK members, each met with each block of its group, itself included
    blocks = rarest.groupBy("sig").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    inside = inside.join(blocks, "sig").withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    met = inside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("sig", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "key", "n", "component", "counts")

    def compare(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Pairs of two blocks, or within one, that are in two components and whose sizes and sketches allow a link."""
        key, size, component, mine = (table.column(c).to_numpy() for c in ("key", "n", "component", "mine"))
        order = np.lexsort((key, size))
        key, size, component, mine = key[order], size[order].astype(np.int64), component[order], mine[order]
        bits = folded(table.column("counts").take(pa.array(order)).to_pylist())
        two = group[1].as_py() != group[2].as_py()
        out = [np.zeros((2, 0), np.int64)]
        for i, end in enumerate(np.searchsorted(size, 4 * size // 3, side="right").tolist()):
            j = i + 1 + np.flatnonzero((component[i + 1 : end] != component[i]) & ((mine[i + 1 : end] != mine[i]) | (not two)))
            j = j[7 * distance(bits[j], bits[i]) <= size[j] + size[i]]
            if len(j):
                out.append(np.stack([np.minimum(key[j], key[i]), np.maximum(key[j], key[i])]))
        a, b = np.concatenate(out, axis=1)
        return pa.table({"a": a, "b": b})

    more = met.groupBy("sig", "low", "high").applyInArrow(compare, "a long, b long").distinct()
    more = A.stored(maybe(more.join(pairs, ["a", "b"], "left_anti")))
    if not more.isEmpty():
        groups = grouped(linked(more), groups)
    out = sets.join(classes.select("key", "rep"), "key", "left").join(groups, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "rep"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.when(F.col("n_shingles") > 0, F.col("rep")).alias("class_id"))


def _group(bucket: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Number of a signature's group: its bucket and 32 bits."""
    return ((bucket << U(32)) | (sig & U(0xFFFFFFFF))).astype(np.int64)
