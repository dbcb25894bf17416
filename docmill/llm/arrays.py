"""Texts as numpy arrays inside tasks: slices of Arrow batches, words, hashes, and packed messages between tasks.

A message is one binary cell that holds several arrays.  Tasks send one message per slice and bucket instead of
one row per word, so the shuffle moves few, dense rows; a bucket is a range of hash values.
"""

from __future__ import annotations

import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
STEP = np.array([0xD6E8FEB86659FD93], np.uint64)  # an array, since scalars warn when they wrap
SLICE_BYTES = 2 << 20


def bucket_count(spark: SparkSession) -> int:
    """Several buckets for each shuffle partition, so the setting that scales the job scales them too."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each text starts (one more for the end); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    arr = column.cast(pa.large_binary()).fill_null(b"")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = arr.buffers()
    offsets = np.frombuffer(bufs[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES, most_rows: int = 1 << 14) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of whole rows with about ``limit`` bytes of text and at most ``most_rows`` rows each: rows, bytes, offsets."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            rows = batch.slice(at, min(end, at + most_rows) - at)
            yield rows, *text_buffers(rows.column(text))
            at += rows.num_rows
        release_memory()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word, a run of bytes that are no ASCII white space."""
    word = ~SPACE[data]
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    starts[offsets[:-1][full]] = word[offsets[:-1][full]]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    ends[offsets[1:][full] - 1] = word[offsets[1:][full] - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, chunk: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word's bytes; worked off in runs of words of about ``chunk`` bytes."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + chunk)))
        s, e = starts[at:stop], ends[at:stop]
        part = data[s[0] : e[-1]]
        coef = (LOWER[part] if lower else part).astype(np.uint64) + np.uint64(1)
        coef[SPACE[part]] = 0
        s = s - s[0]
        lens = np.diff(np.append(s, len(part)))
        k = np.arange(len(part)) - np.repeat(s, lens)
        powers = np.cumprod(np.full(int(lens.max()), BASE))
        # a word may be followed at once by the next text's word, so its own length belongs to the hash
        out[at:stop] = mix(np.add.reduceat(coef * powers[k], s) + (e - starts[at:stop]).astype(np.uint64) * STEP)
        at = stop
    return out


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` hashes, in order."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, have, run, k, power = None, 0, h, 1, STEP
    while n:
        if n & 1:
            if out is None:
                out = run
            else:
                m = len(h) - have - k + 1
                out = out[:m] * power + run[have : have + m]
            have += k
        n >>= 1
        if n:
            m = len(h) - 2 * k + 1
            run = run[:m] * power + run[k : k + m]
            power = power * power
            k *= 2
    return mix(out)


def characters(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, mapped by ``table`` where it reaches, and the number of the text of each."""
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    low = chars < len(table)
    chars = np.where(low, table[np.where(low, chars, 0)], chars)
    return chars, np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(at))


def character_table(letters_only: bool) -> np.ndarray:
    """Lower case for the first 65,536 code points; white space (and, if asked for, all but letters) becomes a space."""
    table = np.arange(1 << 16, dtype=np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        low = c.lower()
        if c.isspace() or (letters_only and not c.isalpha()):
            table[i] = 32
        elif len(low) == 1:
            table[i] = ord(low)
    return table


def ngrams(chars: np.ndarray, doc: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams that lie within one text, and the number of the text of each."""
    m = len(chars) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), doc[:0]
    h = np.full(m, n, np.uint32)
    for k in range(n):
        h = (h ^ chars[k : k + m]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    inside = doc[:m] == doc[n - 1 :]
    return (h >> np.uint32(32 - bits))[inside].astype(np.int64), doc[:m][inside]


def heads(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal values start in sorted values."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one binary value, byte plane after byte plane, so that compression finds the even high bytes."""
    parts = [np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), len(a)))], np.int64).tobytes()]
    for a in arrays:
        parts.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return b"".join(parts)


def unpack(value: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(value, np.int64, 1)[0])
    head = np.frombuffer(value, np.int64, 2 * n, 8)
    out, at = [], 8 + 16 * n
    for kind, length in head.reshape(n, 2):
        dtype = np.dtype(chr(kind))
        planes = np.frombuffer(value, np.uint8, int(length) * dtype.itemsize, at).reshape(dtype.itemsize, int(length))
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype))
        at += planes.size
    return out


def by_bucket(bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The arrays cut up by sorted bucket numbers."""
    at = heads(bucket)
    for s, e in zip(at, [*at[1:], len(bucket)]):  # noqa: B905
        yield int(bucket[s]), [a[s:e] for a in arrays]


def task_cache(owner: str, name: str) -> dict:
    """A dict that lives as long as the Python worker, shared by the tasks it runs one after the other.

    Workers serve one operator after another; what another owner left goes, so that caches don't add up.
    """
    home = sys.modules.setdefault("_corpus_task_cache", types.ModuleType("_corpus_task_cache")).__dict__
    if home.get("owner") != owner:
        home["owner"], home["caches"] = owner, {}
    return home["caches"].setdefault(name, {})


def release_memory() -> None:
    """Hand freed memory back to the system; workers are kept between tasks and share the executor with the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def _shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset a temporary one, in local mode only, as in tests."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, *by: str) -> DataFrame:
    """Write a table to the shared folder, in parts by ``by``, and read it back: like a checkpoint, but columnar and compressed."""
    path = f"{_shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
