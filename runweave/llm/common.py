"""Helpers that several operators share: written tables, safe column names, words and their hashes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.session import new_run_dir

#: A word is a run of bytes other than these.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: The same as a regular expression for Spark and DuckDB.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Texts are hashed together up to so many bytes; a longer text is cut at spaces.
CHUNK_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.random.default_rng(20240229).integers(0, 1 << 63, (4, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES = np.random.default_rng(7).integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


#: Bytes of an Arrow batch that Python functions get while a table is written.
BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES):
    """Arrow batches of so many bytes for what runs inside; the session's own value comes back after it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, label: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The rows of `df`, stored below the shared folder: the lineage ends there and no executor holds it."""
    path = new_run_dir(df.sparkSession, label)
    with small_batches(df.sparkSession, batch_bytes):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(run: Callable) -> Callable:
    """The same function of batches, which hands memory back at the end of its task: workers live on between tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library than that of Linux
        pass


def lower_ascii(column):
    """A-Z in lower case, every other character as it is."""
    return F.translate(column, UPPER, LOWER)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n of an odd number modulo 2^64, and those of its inverse."""
    got = _POWERS.get((base, lane))
    if got is None or len(got[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        odd = int(_ODD[base, lane])
        out = []
        for b in (odd, pow(odd, -1, 1 << 64)):
            row = np.full(size, b, np.uint64)
            row[0] = 1
            out.append(np.multiply.accumulate(row))
        got = (out[0], out[1])
        if n <= 4 * CHUNK_BYTES:
            _POWERS[base, lane] = got
    return got


class Words:
    """Words of some texts, end to end: `first[i]:first[i + 1]` are those of text i."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        if lower:
            self.data = _LOWER[self.data]
        space = _SPACE[self.data]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        self.start, self.end = edge[::2], edge[1::2]
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.start, at)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hashes(self, lane: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; lanes are independent."""
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(self.start):
            low = int(self.start[at])
            stop = max(at + 1, int(np.searchsorted(self.end, low + CHUNK_BYTES, "right")))
            high = int(self.end[stop - 1])
            power, back = _powers(0, lane, high - low)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_BYTES[lane][self.data[low:high]] * power[: high - low], out=sums[1:])
            s, e = self.start[at:stop] - low, self.end[at:stop] - low
            out[at:stop] = mix((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64) * _ODD[2, lane])
            at = stop
        return out

    def text(self, words: np.ndarray) -> bytes:
        """The named words joined by one space."""
        if not len(words):
            return b""
        size = self.end[words] - self.start[words] + 1
        shift = np.repeat(self.start[words] - (np.cumsum(size) - size), size)
        out = self.data[np.minimum(np.arange(len(shift)) + shift, len(self.data) - 1)]
        out[np.cumsum(size) - 1] = 0x20
        return out[:-1].tobytes()


class Spans:
    """Hashes of any run of words, from running sums of the words' hashes."""

    def __init__(self, words: np.ndarray, lane: int = 0):
        self.power, self.back = _powers(1, lane, len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.power[: len(words)], out=self.sums[1:])
        self.odd = _ODD[3, lane]

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mix((self.sums[high] - self.sums[low]) * self.back[low] + (high - low).astype(np.uint64) * self.odd)

    def grams(self, k: int) -> np.ndarray:
        low = np.arange(max(0, len(self.sums) - k))
        return self(low, low + k)


def slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """`best` (np.minimum, np.maximum) of each run of `width` values."""
    if len(values) < width:
        return values[:0]
    size = 1
    while size * 2 <= width:
        values = best(values[:-size], values[size:])
        size *= 2
    return best(values[: len(values) - (width - size)], values[width - size:]) if size < width else values


def chunks(sizes: list[int], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to about `most`; a larger row is alone."""
    low = total = 0
    for i, size in enumerate(sizes):
        if i > low and total + size > most:
            yield low, i
            low, total = i, 0
        total += size
    if low < len(sizes):
        yield low, len(sizes)


def texts_of(column) -> list[bytes]:
    """UTF-8 of an Arrow string column; null is the empty text."""
    return [b"" if x is None else x for x in column.cast("binary").to_pylist()]


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
