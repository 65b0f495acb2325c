"""BPE by a table of distinct words: texts are split in Spark, each distinct word is encoded once, ids return by position.

1. Texts are gathered into blocks of about `BLOCK_CHARS`; a block has its distinct words and, for each document, the
   numbers of its words in order. Words go to buckets by a hash, one row for each block and bucket; so a word that is in
   every text travels once for each block, not once for each place.
2. In a bucket each distinct word is encoded once by the library. The result is written, with the distinct ids of each row.
3. The distinct ids of a block are joined to the vocabulary, a table of id and piece of fixed size.
4. Ids and pieces go back to their blocks, where the numbers of step 1 place them.

There are enough buckets for the size of the input: `BUCKET_CHARS` of text each, and no fewer than shuffle partitions.

Words and numbers are made by one pass each over the texts, so that neither is stored; the rows must come in one order,
as they do from files. A block is named by a hash of its
rows; should the passes cut the input differently, a block lacks its words and the job stops.

A "word" is what stands between two cuts of `tokens.cut_pieces`. Null texts are empty and have no ids. Rows that repeat
are encoded each, an empty table gives an empty one, a text of any length lies in one block. Further columns are not
read here; join them by key.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.llm.common import release, released, written
from runweave.llm.tokens import Encoder, byte_of_character, cut_pieces

BLOCK_CHARS, BUCKET_CHARS = 12 << 20, 32 << 20
CUT = ("block long, bucket int, first long, keys array<long>, sizes array<long>, payload binary")
_CUT = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("first", pa.int64()), ("keys", pa.list_(pa.int64())),
                  ("sizes", pa.list_(pa.int64())), ("payload", pa.binary())])


def pack(values: list[bytes]) -> bytes:
    """Byte strings as one compressed string."""
    sizes = np.array([len(values), *map(len, values)], "<u4").tobytes()
    return zstandard.compress(sizes + b"".join(values), 1)


def unpack(payload: bytes) -> list[bytes]:
    data = zstandard.decompress(payload)
    n = int.from_bytes(data[:4], "little")
    at = np.concatenate([[0], np.cumsum(np.frombuffer(data, "<u4", n, 4).astype(np.int64))]) + 4 * (n + 1)
    return [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def vocabulary(spark: SparkSession, tokenizer: Encoder) -> DataFrame:
    """`id` and `piece`, the bytes that it stands for, of every id."""
    known, library = byte_of_character(), tokenizer.tokenizer
    names = [library.id_to_token(i) or "" for i in range(tokenizer.size)]
    pieces = [bytes(known[c] for c in t) if all(c in known for c in t) else t.encode() for t in names]
    return spark.createDataFrame(pa.table({"id": pa.array(range(len(pieces)), pa.int32()), "piece": pa.array(pieces, pa.binary())}))


def cut_texts(docs: DataFrame, buckets: int, key: str, text: str, places: bool) -> DataFrame:
    """Of each block its distinct words, a row for each bucket, or (`places`) the numbers of its words, in one row."""

    def block(keys: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
        name = hashlib.blake2b(repr(keys).encode(), digest_size=8)
        for t in texts:
            name.update(t.encode())
        number = int.from_bytes(name.digest(), "little", signed=True)
        pieces, start = cut_pieces(texts)
        sizes = np.diff(start).tolist()
        found = pieces.dictionary_encode()
        words = found.dictionary.to_pylist()
        bucket = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % buckets
        by_bucket = np.argsort(bucket, kind="stable")
        if places:
            place = np.empty(len(words), np.uint32)
            place[by_bucket] = np.arange(len(words), dtype=np.uint32)
            row = place[found.indices.to_numpy()]
            out = [{"block": number, "first": len(words), "keys": keys, "sizes": sizes,
                    "payload": zstandard.compress(row.astype("<u4").tobytes(), 3)}]
        else:
            edges = np.flatnonzero(np.diff(bucket[by_bucket], prepend=-1)).tolist() + [len(words)]
            out = [{"block": number, "bucket": int(bucket[by_bucket[a]]), "first": a, "payload": pack([words[i] for i in by_bucket[a:b]])}
                   for a, b in zip(edges, edges[1:], strict=False)]
        yield pa.RecordBatch.from_pylist(out, _CUT)

    def run(batches):
        keys: list = []
        texts: list[str] = []
        room = 0
        for batch in batches:
            for name, value in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                value = value.as_py() or ""
                if keys and room + len(value) > BLOCK_CHARS:
                    yield from block(keys, texts)
                    keys, texts, room = [], [], 0
                keys.append(name)
                texts.append(value)
                room += len(value)
        if keys:
            yield from block(keys, texts)

    return docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text")).mapInArrow(released(run), CUT)


def encode_words(words: DataFrame, tokenizer: str, buckets: int) -> DataFrame:
    """Block, first, the packed ids of each row's words and, as `used`, which ids these are; each distinct word of a bucket
    is encoded once."""

    def run(batches):
        encoder = Encoder(tokenizer, 0)
        now, known = None, {}
        for batch in batches:
            for bucket, block, first, payload in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "first", "payload")),
                                                     strict=True):
                if bucket != now:
                    now, known = bucket, {}
                row = unpack(payload)
                new = [w for w in row if w not in known]
                known.update(zip(new, encoder.distinct(new), strict=True))
                ids = [known[w] for w in row]
                used = np.unique(np.frombuffer(b"".join(ids), encoder.dtype)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([first], pa.int64()), pa.array([pack(ids)], pa.binary()),
                     pa.array([used], pa.list_(pa.int32()))], names=["block", "first", "ids", "used"])

    dealt = words.select("bucket", "block", "first", "payload").repartition(buckets, "bucket")
    return dealt.sortWithinPartitions("bucket", "block").mapInArrow(released(run), "block long, first long, ids binary, used array<int>")


def coded_blocks(docs: DataFrame, tokenizer: str, key: str, text: str, buckets: int | None) -> tuple[DataFrame, np.dtype]:
    """All that a block needs to give its texts back: rows of ids of its words, one with the places of these words, and
    one with the pieces of its ids."""
    spark = docs.sparkSession
    encoder = Encoder(tokenizer, 0)
    if buckets is None:
        chars = docs.agg(F.sum(F.length(docs[text]))).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // BUCKET_CHARS))
    coded = written(encode_words(cut_texts(docs, buckets, key, text, False), tokenizer, buckets), "coded")
    places = cut_texts(docs, buckets, key, text, True).select("block", "first", F.col("payload").alias("ids"), "keys", "sizes")
    # The vocabulary is the same table whatever the input is.
    # One list for each block, at most as long as the vocabulary, so rows grow with the blocks and not with the buckets.
    used = coded.groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list("used"))).alias("used"))
    known = used.select("block", F.explode("used").alias("id")).join(F.broadcast(vocabulary(spark, encoder)), "id")
    pieces = known.groupBy("block").agg(F.collect_list("id").alias("piece_ids"), F.collect_list("piece").alias("pieces"))
    rows = coded.drop("used").unionByName(places, True).unionByName(pieces, True)
    return rows, encoder.dtype


def texts_of_block(table: pa.Table, dtype: np.dtype):
    """Key, ids (unsigned 32 bit, little-endian) and decoded bytes of every text of a block."""
    ids: list[bytes] = []
    places: list[dict] = []
    piece: dict[int, bytes] = {}
    for row in table.sort_by("first").to_pylist():
        if row["pieces"] is not None:
            piece.update(zip(row["piece_ids"], row["pieces"], strict=True))
        elif row["keys"] is not None:
            places.append(row)
        elif row["first"] == len(ids):  # a block that is there twice has equal words
            ids += unpack(row["ids"])
    words = [b"".join([piece[i] for i in np.frombuffer(w, dtype).tolist()]) for w in ids]
    for row in places:
        if row["first"] != len(ids):
            raise RuntimeError("the two passes over the texts have cut them into different blocks")
        order, at = np.frombuffer(zstandard.decompress(row["ids"]), "<u4"), 0
        for name, size in zip(row["keys"], row["sizes"], strict=True):
            mine = order[at:at + size].tolist()
            at += size
            yield name, np.frombuffer(b"".join([ids[i] for i in mine]), dtype).astype("<u4"), b"".join([words[i] for i in mine])


def encode_decode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """Key, `n_tokens`, `ids` (unsigned 32 bit, little-endian, one after the other) and `decoded` text of every row."""
    rows, dtype = coded_blocks(docs, tokenizer, key, text, buckets)

    def assemble(table: pa.Table) -> pa.Table:
        out = list(texts_of_block(table, dtype))
        return pa.table({"key": pa.array([k for k, _, _ in out], pa.int64()), "n_tokens": pa.array([len(i) for _, i, _ in out], pa.int64()),
                         "ids": pa.array([i.tobytes() for _, i, _ in out], pa.binary()),
                         "decoded": pa.array([d.decode("utf-8", "replace") for _, _, d in out], pa.string())})

    # A group is one block, of bounded size.
    found = rows.groupBy("block").applyInArrow(assemble, "key long, n_tokens long, ids binary, decoded string")
    return found.withColumnRenamed("key", key)


def encode_digests(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """Key, `n_tokens` and the digests of `digests`, made where a block is put together and written."""
    rows, dtype = coded_blocks(docs, tokenizer, key, text, buckets)

    def assemble(table: pa.Table) -> pa.Table:
        names: list[bytes] = []
        out = []
        for name, ids, decoded in texts_of_block(table, dtype):
            if len(ids) and ids.max() >= len(names):
                names = [b"%d" % i for i in range(int(ids.max()) + 1)]
            told = b",".join([names[i] for i in ids.tolist()])
            plain = decoded.decode("utf-8", "replace").encode()
            out.append((name, len(ids), hashlib.sha256(told).hexdigest(), hashlib.sha256(plain).hexdigest()))
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        done = pa.table({"key": pa.array(columns[0], pa.int64()), "n_tokens": pa.array(columns[1], pa.int64()),
                         "ids_sha256": pa.array(columns[2], pa.string()), "decoded_sha256": pa.array(columns[3], pa.string())})
        release()
        return done

    found = rows.groupBy("block").applyInArrow(assemble, "key long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return written(found, "digests").withColumnRenamed("key", key)


def digests(encoded: DataFrame) -> DataFrame:
    """`ids` replaced by the SHA-256 of the decimal ids joined by commas, `decoded` by that of its bytes."""
    rest = [f for f in encoded.schema if f.name not in ("ids", "decoded")]

    def run(batches):
        names: list[bytes] = []
        for batch in batches:
            out = []
            for packed in batch.column("ids").to_pylist():
                ids = np.frombuffer(packed, "<u4")
                if len(ids) and ids.max() >= len(names):
                    names = [b"%d" % i for i in range(int(ids.max()) + 1)]
                out.append(hashlib.sha256(b",".join([names[i] for i in ids.tolist()])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in rest), pa.array(out, pa.string()),
                 pa.array([hashlib.sha256(t.encode()).hexdigest() for t in batch.column("decoded").to_pylist()], pa.string())],
                names=[*(f.name for f in rest), "ids_sha256", "decoded_sha256"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "ids_sha256 string, decoded_sha256 string"])
    return encoded.mapInArrow(run, schema)


def op6_word_table(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op6_word_table": op6_word_table}
ORACLE: dict[str, str] = {}
