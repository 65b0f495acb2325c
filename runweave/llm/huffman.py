"""Token ids in files: canonical, length-limited Huffman codes from global counts.

`write_ids` encodes texts, counts every id of the corpus, derives one code book and writes documents in ascending order
of their key: folders `shard=N` of block rows, each a few whole documents, and a folder `codebook`. A block can be
decoded alone; a bit offset is kept for every `CHECKPOINT` ids, so all stretches of a block are decoded side by side by
table lookups. `read_ids` reads those files only.

Null texts are empty and have the end id only. Rows that repeat a key follow each other, ordered by their codes; a null
key comes first. An empty table writes an empty code book and no blocks. Only key and text are read, so further columns
and their names do not matter. Long texts are encoded whole; a document is never split over blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runweave.llm.common import chunks, released, written
from runweave.llm.tokens import encoder_of

#: Longest code in bits; 7 more must fit into a 32-bit window.
LIMIT = 20
#: Ids between two kept bit offsets.
CHECKPOINT = 512
#: A block is closed when it has so many ids, a shard is meant to have so many.
BLOCK_IDS, SHARD_IDS = 1 << 16, 1 << 23
#: Bytes of text encoded in one go.
ENCODED = 1 << 21
#: Ids coded or decoded in one go.
STRETCH = 1 << 19


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits, by package and merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit into codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    row, flags = leaves, []
    for _ in range(limit):
        flags.append(None)
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1) if flags[:-1] else row[:0]
        both = np.concatenate([leaves, pairs])
        rank = np.argsort(both, kind="stable")
        row, flags[-1] = both[rank], rank < len(leaves)
    take, out = 2 * len(leaves) - 2, np.zeros(len(leaves), np.uint8)
    for leaf in reversed(flags):
        own = int(leaf[:take].sum())
        out[:own] += 1
        take = 2 * (take - own)
    lengths[order] = out
    return lengths


class Codes:
    """Canonical codes and the decoding table of given lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        self.most = int(lengths.max(initial=1))
        sizes = np.int64(1) << (self.most - self.lengths[order])
        self.codes = np.zeros(len(lengths), np.int64)
        self.codes[order] = (np.cumsum(sizes) - sizes) >> (self.most - self.lengths[order])
        # Id and length of its code in one number.
        self.table = np.zeros(1 << self.most, np.int32)
        self.table[: sizes.sum()] = np.repeat(((order << 5) | self.lengths[order]).astype(np.int32), sizes)

    def encode(self, rows: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
        """For each row of ids its bits, padded to bytes, and the bit offsets of every `CHECKPOINT`th id."""
        ids = np.concatenate(rows) if rows else np.empty(0, np.int64)
        size = np.array([len(r) for r in rows], np.int64)
        if not len(ids):
            return [(b"", b"") for _ in rows]
        bits = self.lengths[ids]
        total = np.concatenate([[0], np.cumsum(bits)])
        first = np.cumsum(size) - size
        begin = total[first]
        room = (total[first + size] - begin + 7) >> 3
        base = np.cumsum(room) - room
        offset = total[:-1] + np.repeat(base * 8 - begin, size)
        word = offset >> 5
        value = self.codes[ids].astype(np.uint64) << (64 - bits - (offset & 31)).astype(np.uint64)
        group = np.flatnonzero(np.diff(word, prepend=-1))
        out = np.zeros(int(word[-1]) + 2, np.uint64)
        out[word[group]] += np.add.reduceat(value >> np.uint64(32), group)
        out[word[group] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), group)
        data = out.astype(">u4").tobytes()
        return [(data[b:b + n], (offset[f:f + s:CHECKPOINT] - 8 * b).astype("<u4").tobytes())
                for b, n, f, s in zip(base.tolist(), room.tolist(), first.tolist(), size.tolist(), strict=True)]

    def decode(self, payload: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Ids of stretches that start at these bits and have these many ids, end to end."""
        data = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
        window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        order = np.argsort(-size, kind="stable")
        at, left = start[order].astype(np.int64), size[order]
        put = (np.cumsum(size) - size)[order]
        out = np.empty(int(size.sum()), np.int32)
        keep, shift = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), "left"), np.uint32(32 - self.most)
        for step, live in enumerate(keep):
            bit = at[:live]
            found = self.table[(window[bit >> 3] << (bit & 7).astype(np.uint32)) >> shift]
            out[put[:live] + step] = found >> 5
            at[:live] += found & 31
        return out


def encode_texts(docs: DataFrame, path: str, end_id: int, key: str, text: str) -> DataFrame:
    """Key, number of ids and packed ids of every text, with the end id. Each task adds one row with `n_tokens` -1: how often
    it has seen each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        end = np.array([end_id], encoder.dtype).tobytes()
        total = np.zeros(max(encoder.size, end_id + 1), np.int64)
        for batch in batches:
            text = batch.column("text")
            for low, high in chunks(pc.fill_null(pc.binary_length(text), 0).to_pylist(), ENCODED):
                texts = [t or "" for t in text.slice(low, high - low).to_pylist()]
                packed = [ids + end for ids in encoder.encode(texts)]
                total += np.bincount(np.frombuffer(b"".join(packed), encoder.dtype), minlength=len(total))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(low, high - low),
                     pa.array([len(p) // encoder.dtype.itemsize for p in packed], pa.int64()),
                     pa.array(packed, pa.binary())], names=["key", "n_tokens", "ids"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1], pa.int64()),
                                          pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["key", "n_tokens", "ids"])

    return docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text")).mapInArrow(
        released(run), "key long, n_tokens long, ids binary")


def count_ids(ids: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs, from the tasks' counts; as many rows as the vocabulary has are collected."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                total += np.frombuffer(packed, "<i8")
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(total[used])], names=["id", "n"])

    counts = np.zeros(size, np.int64)
    told = ids.filter("n_tokens < 0").select("ids").mapInArrow(run, "id long, n long")
    for row in told.groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    return counts


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> None:
    """Encode every text and write its ids below `folder`."""
    spark = docs.sparkSession
    encoder = encoder_of(tokenizer)
    size, dtype = max(encoder.size, end_id + 1), encoder.dtype.str
    coded_texts = written(encode_texts(docs, tokenizer, end_id, key, text), "ids")
    counts = count_ids(coded_texts, size)
    ids = coded_texts.filter("n_tokens >= 0")
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id long, bits int").coalesce(1).write.parquet(
        f"{folder}/codebook")
    shards = int(max(spark.sparkContext.defaultParallelism, counts.sum() // SHARD_IDS))
    splits = ids.approxQuantile("key", [i / shards for i in range(1, shards)], 0.1 / shards) if shards > 1 else []
    cuts = np.unique(np.array(splits or [], np.float64)).astype(np.int64)

    def coded(batches):
        codes = Codes(lengths)
        for batch in batches:
            packed = batch.column("ids").to_pylist()
            for low, high in chunks([len(p) for p in packed], STRETCH):
                got = codes.encode([np.frombuffer(p, dtype) for p in packed[low:high]])
                keys = batch.column("key").slice(low, high - low)
                at = np.searchsorted(cuts, keys.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), "right")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at, pa.int32()), keys, batch.column("n_tokens").slice(low, high - low),
                     pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.binary())],
                    names=["shard", "key", "n_tokens", "payload", "offsets"])

    def blocked(batches):
        shard, number, rows, room = None, 0, [], 0

        def block():
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int64()), pa.array([columns[0]], pa.list_(pa.int64())),
                 pa.array([columns[1]], pa.list_(pa.int64())), pa.array([b"".join(columns[2])], pa.binary()),
                 pa.array([[len(p) for p in columns[2]]], pa.list_(pa.int64())),
                 pa.array([b"".join(columns[3])], pa.binary())],
                names=["shard", "block", "keys", "n_tokens", "payload", "n_bytes", "offsets"])

        for batch in batches:
            for at, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "key", "n_tokens", "payload", "offsets")),
                                strict=True):
                if rows and (at != shard or room + row[1] > BLOCK_IDS):
                    yield block()
                    number, rows, room = (0 if at != shard else number + 1), [], 0
                elif at != shard:
                    number = 0
                shard = at
                rows.append(row)
                room += row[1]
        if rows:
            yield block()

    dealt = ids.mapInArrow(released(coded), "shard int, key long, n_tokens long, payload binary, offsets binary").repartition(
        shards, "shard").sortWithinPartitions("shard", "key", "n_tokens", "payload")
    dealt.mapInArrow(
        released(blocked), "shard int, block long, keys array<long>, n_tokens array<long>, payload binary, n_bytes array<long>, offsets binary"
    ).write.partitionBy("shard").parquet(f"{folder}/blocks")


BLOCKS = ("block long, keys array<long>, n_tokens array<long>, payload binary, n_bytes array<long>, offsets binary, "
          "shard int")


def read_ids(spark: SparkSession, folder: str, key: str = "doc_id", checksum: bool = False) -> DataFrame:
    """From the files alone, for each document: key, `start` (ids before it), `n_tokens`, `ids` packed as unsigned 32 bit,
    or with `checksum` their unsigned CRC-32 as `ids_crc32`."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    book = {r["id"]: r["bits"] for r in spark.read.schema("id long, bits int").parquet(f"{folder}/codebook").collect()}
    lengths = np.zeros(max(book, default=0) + 1, np.uint8)
    lengths[list(book)] = list(book.values())
    given, kind = ("ids_crc32", "long") if checksum else ("ids", "binary")

    def run(batches):
        codes = Codes(lengths)
        names = ("start", "keys", "n_tokens", "payload", "n_bytes", "offsets")
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
            for low, high in chunks([sum(r[2]) for r in rows], STRETCH):
                part = rows[low:high]
                size = np.array([n for r in part for n in r[2]], np.int64)
                room = np.array([n for r in part for n in r[4]], np.int64)
                stretches = -(-size // CHECKPOINT)
                offset = np.frombuffer(b"".join(r[5] for r in part), "<u4").astype(np.int64)
                begin = np.repeat((np.cumsum(room) - room) * 8, stretches) + offset
                most = np.full(len(offset), CHECKPOINT, np.int64)
                last = np.cumsum(stretches) - 1
                most[last] = size - (stretches - 1) * CHECKPOINT
                ids = codes.decode(b"".join(r[3] for r in part), begin, most).astype("<u4").tobytes()
                at = np.concatenate([[0], np.cumsum(size)]) * 4
                each = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for r in part for k in r[1]], pa.int64()),
                     pa.array([r[0] + int(s) for r in part for s in np.cumsum([0, *r[2][:-1]])], pa.int64()), pa.array(size),
                     pa.array(map(zlib.crc32, each), pa.int64()) if checksum else pa.array(each, pa.binary())],
                    names=["key", "start", "n_tokens", given])

    size = blocks.select("shard", "block", F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)").alias("n"))
    shards = size.groupBy("shard").agg(F.sum("n").alias("n"))
    # One row for each shard meets in one task.
    begin = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("_shard_start"))
    inside = size.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("_in"))
    starts = written(inside.join(begin, "shard").select("shard", "block", (F.col("_shard_start") + F.col("_in")).alias("start")), "starts")
    # Joined to the blocks before they are decoded: coded ids are what may be shuffled.
    placed = blocks.join(starts, ["shard", "block"]).select("start", "keys", "n_tokens", "payload", "n_bytes", "offsets")
    return placed.mapInArrow(released(run), f"key long, start long, n_tokens long, {given} {kind}").withColumnRenamed("key", key)


def op4_huffman_ids(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from runweave.session import new_run_dir

    folder = new_run_dir(spark, "huffman")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_ids(spark, folder, checksum=True)


QUERIES = {"op4_huffman_ids": op4_huffman_ids}
ORACLE: dict[str, str] = {}
