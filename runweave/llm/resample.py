"""Importance resampling towards a target collection, ranked by a distributed LSD radix sort.

1. Features are the runs of 1 to `GRAM` consecutive words, hashed to `BUCKETS` buckets by CRC-32. Two tables of counts
   are made over all documents and over all target texts; the logarithm of the ratio of their smoothed shares is the gain
   of a bucket. The gains are one array of fixed size that travels with the scoring function.
2. A document's weight is the sum of the gains of its features. Its score is the weight with Gumbel noise made from its
   key, so that the highest scores are a sample without replacement by importance.
3. The places of the highest scores come from a least-significant-digit radix sort over the composite key (score falling,
   document key rising). One pass is a stable counting sort by one digit: rows are counted for each block and digit, sums
   over smaller digits and earlier blocks are the offsets, and offset plus place within block and digit is the
   destination. A block is a range of `BLOCK_ROWS` places of the pass before, so blocks are equal whatever the keys are;
   digits in which all rows agree need no pass. Every pass is written, so a lost executor costs a part of one pass.

Only the counts of digits (2 ^ `DIGIT_BITS` at most) and of buckets go through the driver.

The key is an integer column. A null key is hashed as empty text and comes before all others. Null and empty texts have
no features, weight 0 and fewer words than are needed, so they are not drawn. Rows that repeat are scored each on its own
and have ranks next to each other. Words longer than `STEPS` bytes and texts of any length are hashed whole, a text in
parts of `CHUNK_BYTES`. An empty table gives an empty one; without target texts all gains follow from the documents alone.
Further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runweave.llm.common import texts_of, written

BUCKETS, GRAM, SEED = 10_000, 3, 42
#: Documents with fewer words are not drawn; of the others so many in a hundred are.
LEAST_WORDS, PERCENT = 20, 5
#: Bits of a digit, rows of a block.
DIGIT_BITS, BLOCK_ROWS = 12, 1 << 18
#: Texts are hashed together up to so many bytes; a longer one is hashed in parts.
CHUNK_BYTES = 1 << 20
#: Words up to so many bytes are hashed step by step together, longer ones each on its own.
STEPS = 64

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _step_table() -> np.ndarray:
    """The CRC-32 register after one byte, for each byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_STEP = _step_table()


def _append_zero(c: np.ndarray) -> np.ndarray:
    return _STEP[c & 0xFF] ^ (c >> np.uint32(8))


def _shift_tables() -> np.ndarray:
    """`[n, k, b]`: byte b at place k of a checksum, moved on by n further bytes."""
    now = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    out = [now]
    for _ in range(STEPS):
        now = _append_zero(now)
        out.append(now)
    return np.stack(out)


_SHIFT = _shift_tables()
_BYTES_OF = np.arange(4, dtype=np.uint32) * 8


def shifted(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Checksums moved on by so many bytes each: what they add to the checksum of a longer text."""
    out = crc.copy()
    left = by.copy()
    while len(at := np.flatnonzero(left)):
        n, c = np.minimum(left[at], STEPS), out[at]
        out[at] = _SHIFT[n, 0, c & 0xFF] ^ _SHIFT[n, 1, (c >> 8) & 0xFF] ^ _SHIFT[n, 2, (c >> 16) & 0xFF] ^ _SHIFT[n, 3, c >> 24]
        left[at] -= n
    return out


def spaced(crc: np.ndarray) -> np.ndarray:
    """Checksums with one space added."""
    c = ~crc
    return ~(_STEP[(c ^ np.uint32(0x20)) & 0xFF] ^ (c >> np.uint32(8)))


def word_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, size in bytes and CRC-32 of each word; `data` is in lower case."""
    edge = np.flatnonzero(np.diff(_WORD[data], prepend=False, append=False))
    start, size = edge[::2], edge[1::2] - edge[::2]
    crc = np.empty(len(start), np.uint32)
    by_size = np.argsort(-np.minimum(size, STEPS + 1), kind="stable")
    long = int(np.count_nonzero(size > STEPS))
    for i in by_size[:long]:
        crc[i] = zlib.crc32(data[start[i]:start[i] + size[i]])
    short = by_size[long:]
    c, at, falling = np.full(len(short), 0xFFFFFFFF, np.uint32), start[short], -size[short]
    for j in range(int(size[short[0]]) if len(short) else 0):
        n = int(np.searchsorted(falling, -j, "left"))  # words with more than j bytes come first
        c[:n] = _STEP[(c[:n] ^ data[at[:n] + j]) & 0xFF] ^ (c[:n] >> np.uint32(8))
    crc[short] = ~c
    return start, size, crc


def runs(crc: np.ndarray, size: np.ndarray, row: np.ndarray, known: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and CRC-32 of each run of 1 to `GRAM` words, runs of one length together; those that end within the first
    `known` words are left out."""
    now = crc
    for k in range(GRAM):
        if k:
            now = shifted(spaced(now[:-1]), size[k:]) ^ crc[k:]
        low = max(0, known - k)
        inside = row[low:len(row) - k] == row[low + k:]
        yield row[low:len(row) - k][inside], now[low:][inside]
        if len(now) < 2:
            return


def features(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For parts of the texts: the first row, how many words each row has in it, and row and bucket of its features."""

    def part(data: np.ndarray, begin: np.ndarray, first: int, before: tuple):
        start, size, crc = word_sums(data)
        row = np.searchsorted(begin, start, "right") - 1
        n_words = np.bincount(row, minlength=len(begin))
        size, crc = np.concatenate([before[0], size]), np.concatenate([before[1], crc])
        row = np.concatenate([np.zeros(len(before[0]), row.dtype), row])
        found = list(runs(crc, size, row, len(before[0]))) if len(crc) else []
        rows = np.concatenate([r for r, _ in found]) if found else np.zeros(0, np.int64)
        buckets = np.concatenate([c for _, c in found]) % BUCKETS if found else np.zeros(0, np.uint32)
        keep = max(0, len(crc) - GRAM + 1)
        return (first, n_words, rows, buckets), (size[keep:], crc[keep:])

    none = (np.zeros(0, np.int64), np.zeros(0, np.uint32))
    at = 0
    while at < len(texts):
        if len(texts[at]) > CHUNK_BYTES:
            data, low, before = _LOWER[np.frombuffer(texts[at], np.uint8)], 0, none
            while low < len(data):
                high = min(len(data), low + CHUNK_BYTES)
                gap = np.flatnonzero(~_WORD[data[low:high]]) if high < len(data) else ()
                if len(gap):  # a word longer than a part stays whole
                    high = low + int(gap[-1]) + 1
                elif high < len(data):
                    gap = np.flatnonzero(~_WORD[data[high:]])
                    high = high + int(gap[0]) if len(gap) else len(data)
                out, before = part(data[low:high], np.zeros(1, np.int64), at, before)
                yield out
                low = high
            at += 1
            continue
        stop, room = at, 0
        while stop < len(texts) and room + len(texts[stop]) <= CHUNK_BYTES:
            room += len(texts[stop]) + 1
            stop += 1
        if stop == at:
            stop += 1
        data = _LOWER[np.frombuffer(b" ".join(texts[at:stop]), np.uint8)]
        begin = np.cumsum([0, *(len(t) + 1 for t in texts[at:stop - 1])])
        yield part(data, begin, at, none)[0]
        at = stop


def bucket_counts(docs: DataFrame, text: str) -> dict[int, int]:
    """How many features fall into each bucket, over all rows; one array for each task before they are summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, _, buckets in features(texts_of(batch.column(0))):
                total += np.bincount(buckets, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    counted = docs.select(docs[text]).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r["bucket"]: r["n"] for r in counted.collect()}


def gains(corpus: dict[int, int], target: dict[int, int]) -> list[int]:
    """The gain of every bucket, in thousandths of a natural logarithm, rounded down."""
    all_corpus, all_target = float(sum(corpus.values()) + BUCKETS), float(sum(target.values()) + BUCKETS)
    return [math.floor(1000 * math.log(float(target.get(b, 0) + 1) * all_corpus / (float(corpus.get(b, 0) + 1) * all_target)))
            for b in range(BUCKETS)]


def noise(key: int | None, seed: int = SEED) -> int:
    drawn = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((drawn + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: Sequence[int], key: str, text: str, seed: int = SEED) -> DataFrame:
    """Key, `n_words`, `n_features`, `weight` and `score` of every row."""
    table = np.array(gain, np.float64)  # integers and their sums are exact

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words, sizes, weights = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for first, n_words, rows, buckets in features(texts_of(batch.column(1))):
                here = slice(first, first + len(n_words))
                words[here] += n_words
                sizes[here] += np.bincount(rows, minlength=len(n_words))
                weights[here] += np.bincount(rows, table[buckets], minlength=len(n_words)).astype(np.int64)
            drawn = np.array([noise(k, seed) for k in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, sizes, weights, weights + drawn))],
                                             names=["key", "n_words", "n_features", "weight", "score"])

    return docs.select(docs[key].cast("long").alias("key"), docs[text]).mapInArrow(
        score, "key long, n_words long, n_features long, weight long, score long")


def _digits(table: DataFrame, keys: Sequence[str], bits: int) -> list[Column]:
    """The digits of the composite key, least significant first, without those in which all rows agree."""
    ends = table.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in keys for f in (F.min, F.max)]).first()
    parts = []
    for c in reversed(keys):
        low, high = ends[f"min_{c}"], ends[f"max_{c}"]
        if low is None or low == high:
            continue
        narrow = high - low < 1 << 63
        value = F.col(c) - F.lit(low) if narrow else F.col(c).bitwiseXOR(F.lit(-1 << 63))
        width = (high - low).bit_length() if narrow else 64
        parts += [F.shiftrightunsigned(value, i).bitwiseAND(F.lit((1 << bits) - 1)).cast("int") for i in range(0, width, bits)]
    return parts


def radix_places(rows: DataFrame, keys: Sequence[str], digit_bits: int = DIGIT_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`rows` with `at`, the place (from 0) of each in the rising order of the integer columns `keys`, of which none is
    null; rows with equal keys keep the order in which they were written."""
    table = written(rows, "unsorted")
    digits = _digits(table, keys, digit_bits)
    # A number for each row of the written files; its upper half names the task, which is the first block.
    table = table.withColumn("at", F.monotonically_increasing_id())
    block = F.shiftright("at", 33)
    if not digits:  # no row, or equal keys only: one more pass by a digit that is 0 makes the places dense
        digits = [F.lit(0)]
    for number, digit in enumerate(digits):
        dealt = table.withColumn("_block", block).withColumn("_digit", digit)
        counts = written(dealt.groupBy("_block", "_digit").agg(F.count("*").alias("_n")), "counts")
        totals = sorted((r["_digit"], r["n"]) for r in counts.groupBy("_digit").agg(F.sum("_n").alias("n")).collect())
        starts, below = [], 0
        for d, n in totals:
            starts.append((d, below))
            below += n
        start = F.broadcast(table.sparkSession.createDataFrame(starts, "_digit int, _start long"))
        earlier = Window.partitionBy("_digit").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.join(start, "_digit").select(
            "_block", "_digit", (F.col("_start") + F.coalesce(F.sum("_n").over(earlier), F.lit(0))).alias("_offset"))
        local = F.row_number().over(Window.partitionBy("_block", "_digit").orderBy("at")) - 1
        placed = dealt.withColumn("_local", local).join(offsets, ["_block", "_digit"])
        table = written(placed.withColumn("at", F.col("_offset") + F.col("_local")).select(*rows.columns, "at"), f"pass{number}")
        block = F.floor(F.col("at") / F.lit(block_rows))
    return table


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
             percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, digit_bits: int = DIGIT_BITS,
             block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Key, `n_words`, `n_features`, `weight`, `score` and `rank` (from 1; null for what is not drawn) of every row."""
    gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    rows = written(scored(docs, gain, key, text, seed), "scored")
    able = rows.filter(F.col("n_words") >= least_words)
    wanted = percent * able.count() // 100
    ordered = radix_places(
        able.withColumn("_falling", F.bitwise_not("score")).withColumn("_key", F.coalesce("key", F.lit(-1 << 63))),
        ["_falling", "_key"], digit_bits, block_rows)
    rank = F.when(F.col("at") < wanted, F.col("at") + 1)
    names = ["key", "n_words", "n_features", "weight", "score"]
    rest = rows.filter(F.col("n_words") < least_words).select(*names, F.lit(None).cast("long").alias("rank"))
    return ordered.select(*names, rank.alias("rank")).unionByName(rest).withColumnRenamed("key", key)


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return resample(docs, target)


QUERIES = {"op11_importance_resampling": op11_importance_resampling}
ORACLE: dict[str, str] = {}
