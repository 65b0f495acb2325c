"""Exact top-k inner products in three phases with a uniform threshold.

The dimensions of the vectors are cut into `LISTS` groups; a candidate's score is the sum of its partial scores, one
from each list. Candidates lie in blocks, and every block of queries visits every block of candidates.

1. Gather: each block sends, for each query and list, its k best partial scores with the exact sums of those rows. The
   k-th best sum over all blocks is a safe cutoff: k rows reach it.
2. Broadcast the cutoff: it travels with its query. A row that reaches the cutoff has, in at least one list, a partial
   score of cutoff / lists or more, so those rows are sufficient; ties are among them.
3. Resolve: the missing partial scores of these rows alone are added up, and what reaches the cutoff competes.

Products are summed as 64-bit floats. Where a block's numbers are too large for these to be exact, the cutoff is lowered and
the bounds are widened by the greatest error, and phase 3 adds up what is left as whole numbers of any length. A score
beyond a long is given as the nearest long, and such scores tie.

Vectors that are null or hold null, NaN or infinite components take no part. Shorter vectors count as if filled up with
zeros. Equal rows (key and vector) count once; different vectors under one key are candidates each, never for a query of
the same key. Ties go to the smaller key. With fewer than k candidates all are returned, an empty table gives an empty
one. Rows without a key take no part. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runweave.llm.common import written

LISTS = 2
#: Rows in a block of candidates and of queries, and queries of a block that are multiplied at a time.
BLOCK_ROWS, QUERY_ROWS, PART_ROWS = 8192, 1024, 128
#: Types of packed vectors, by their bytes.
KINDS = (np.int16, np.int32, np.float64)
#: Whole numbers below this are exact as doubles; larger doubles are whole.
EXACT, LONG = 2.0**53, 2**63


def integers(vector: Column, factor: int) -> Column:
    """Components times the factor, rounded down, as doubles; null if a component is null or the product not finite."""
    wide = F.transform(vector, lambda x: x.cast("double") * factor)
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(wide, lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)))


def _small(numbers: np.ndarray) -> np.ndarray:
    """Whole numbers in the shortest of `KINDS` that holds all of them."""
    low, high = numbers.min(initial=0.0), numbers.max(initial=0.0)
    return numbers.astype(next((t for t in KINDS[:-1] if np.iinfo(t).min <= low and high <= np.iinfo(t).max), KINDS[-1]))


def packed(rows: DataFrame, block: Column, width: int, extra: str = "") -> DataFrame:
    """One row for each block: keys, vectors in as few bytes as are exact and perhaps cutoffs."""

    def pack(table: pa.Table) -> pa.Table:
        vectors = np.zeros((table.num_rows, width))
        for i, v in enumerate(table.column("v").to_pylist()):
            vectors[i, :len(v)] = v
        columns = {"block": [table.column("block")[0].as_py()], "keys": [table.column("key").to_numpy().tobytes()],
                   "vectors": [_small(vectors).tobytes()]}
        if extra:
            columns[extra] = [table.column(extra).to_numpy().astype(np.float64).tobytes()]
        return pa.table(columns, schema=pa.schema([("block", pa.int64())] + [(c, pa.binary()) for c in list(columns)[1:]]))

    schema = "block long, keys binary, vectors binary" + (f", {extra} binary" if extra else "")
    return rows.withColumn("block", block).groupBy("block").applyInArrow(pack, schema)


def met(candidates: DataFrame, queries: DataFrame, groups: int) -> DataFrame:
    """Each block of queries beside each block of candidates, by an equal join on groups of the candidates' blocks.

    Both sides are dealt out: Spark's estimate does not know that each block of queries comes `groups` times, and would have
    the driver collect and send all of them while the queries alone are few.
    """
    sent = queries.drop("block").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    renamed = sent.select("block", *[F.col(c).alias(f"q_{c}") for c in sent.columns if c != "block"])
    grouped = candidates.withColumn("block", F.pmod("block", F.lit(groups)))
    return grouped.join(renamed.hint("merge"), "block").drop("block")


def _vectors(data: pa.Buffer, rows: int, width: int) -> np.ndarray:
    kind = next(t for t in KINDS if data.size == rows * width * np.dtype(t).itemsize)
    return np.frombuffer(data, kind).reshape(rows, width).astype(np.float64)


def _parts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Keys and vectors of candidates beside those of a few queries, with the cutoffs of these if they were sent."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_buffer() for name in batch.schema.names}
            keys, asks = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["q_keys"], np.int64)
            vectors, wanted = _vectors(row["vectors"], len(keys), width), _vectors(row["q_vectors"], len(asks), width)
            more = [np.frombuffer(row["q_cutoff"])] if "q_cutoff" in row else []
            for low in range(0, len(asks), PART_ROWS):
                yield keys, vectors, *(x[low:low + PART_ROWS] for x in (asks, wanted, *more))


def _error(vectors: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """How far each query's sums may be from the exact ones, for all candidates of a block; 0 where all sums are exact."""
    width = vectors.shape[1]
    most = np.abs(wanted).max(axis=1, initial=0.0) * np.abs(vectors).max(initial=0.0) * width
    return np.where(most < EXACT, 0.0, most * (width + LISTS + 2) * 2.0**-51)


def _exact(x: np.ndarray, y: np.ndarray) -> int:
    total = sum(int(a) * int(b) for a, b in zip(x.tolist(), y.tolist(), strict=True))
    return max(-LONG, min(LONG - 1, total))


def top_k(df: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", factor: int = 256,
          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`query_id`, `rank` (from 1), key and `score` of the k highest integer inner products of each query row."""
    rows = written(df.select(F.col(key).cast("long").alias("key"), integers(df[vector], factor).alias("v"), queries.alias("asks"))
                   .filter("key is not null and v is not null").dropDuplicates(["key", "v"]), "vectors")
    width, total, asking = rows.agg(F.max(F.size("v")), F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    width = max(width or 1, LISTS)
    blocks, asked = max(1, -(-total // block_rows)), max(1, -(-asking // QUERY_ROWS))
    # Queries are sent once for each group: as many bytes as all candidates have, or what the cores need.
    groups = min(blocks, max(total // max(1, asking), 2 * df.sparkSession.sparkContext.defaultParallelism))
    edges = [width * i // LISTS for i in range(LISTS + 1)]
    candidates = written(packed(rows, F.pmod(F.xxhash64("key", "v"), F.lit(blocks)), width), "candidates")
    ask = rows.filter("asks").withColumn("ask", F.xxhash64("key", "v"))

    def partial(vectors, wanted):
        return [wanted[:, a:b] @ vectors[:, a:b].T for a, b in zip(edges, edges[1:], strict=False)]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, vectors, asks, wanted in _parts(batches, width):
            parts = partial(vectors, wanted)
            own = asks[:, None] == keys[None, :]
            best: list[set] = [set() for _ in asks]
            for part in parts:
                part = np.where(own, -np.inf, part)
                for i, top in enumerate(np.argpartition(-part, min(k, len(keys)) - 1, axis=1)[:, :k]):
                    best[i].update(j for j in top.tolist() if not own[i, j])
            found = [(i, j) for i, js in enumerate(best) for j in js]
            at = np.array(found, np.int64).reshape(-1, 2)
            total = sum(p[at[:, 0], at[:, 1]] for p in parts) if found else np.empty(0)
            total = np.nan_to_num(total - _error(vectors, wanted)[at[:, 0]], nan=-np.inf, posinf=float(LONG), neginf=-np.inf)
            order = np.lexsort((-total, at[:, 0]))
            at, total = at[order], total[order]
            first = np.arange(len(at)) - np.searchsorted(at[:, 0], at[:, 0]) < k
            yield pa.RecordBatch.from_arrays([pa.array(asks[at[first, 0]]), pa.array(total[first])], names=["key", "sum"])

    everyone = packed(ask.select("key", "v", "ask"), F.pmod(F.col("ask"), F.lit(asked)), width)
    sums = met(candidates, everyone, groups).mapInArrow(gather, "key long, sum double")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("sum")))
    cutoff = sums.withColumn("_at", place).filter(F.col("_at") == k).select("key", F.col("sum").alias("cutoff"))
    told = written(ask.join(cutoff, "key", "left").na.fill(float("-inf"), ["cutoff"]).select("key", "v", "ask", "cutoff"), "cutoffs")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, vectors, asks, wanted, limit in _parts(batches, width):
            # Scores beyond a long tie, so no cutoff lies there.
            limit = np.minimum(limit, LONG * (1 - 2.0**-52))
            limit = np.where(limit <= -LONG * (1 - 2.0**-52), -np.inf, limit)
            error = _error(vectors, wanted)
            parts = partial(vectors, wanted)
            enough = np.zeros(parts[0].shape, bool)
            for part in parts:
                enough |= ~(part < (limit / LISTS - error)[:, None])
            q, c = np.nonzero(enough)
            total = sum(p[q, c] for p in parts)
            stay = ~(total < (limit - error)[q]) & (asks[q] != keys[c])
            q, c, total = q[stay], c[stay], total[stay]
            whole = error[q] == 0
            score = np.where(whole, total, 0).astype(np.int64)
            score[~whole] = [_exact(wanted[i], vectors[j]) for i, j in zip(q[~whole], c[~whole], strict=True)]
            order = np.lexsort((keys[c], ~score, q))
            q, c, score = q[order], c[order], score[order]
            first = np.arange(len(q)) - np.searchsorted(q, q) < k
            yield pa.RecordBatch.from_arrays(
                [pa.array(asks[q[first]]), pa.array(keys[c[first]]), pa.array(score[first])],
                names=["query_id", "key", "score"])

    asked_blocks = packed(told, F.pmod(F.col("ask"), F.lit(asked)), width, "cutoff")
    found = met(candidates, asked_blocks, groups).mapInArrow(resolve, "query_id long, key long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("key").alias(key), "score")


def op10_topk_threshold(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 50 == 0)


QUERIES = {"op10_topk_threshold": op10_topk_threshold}
ORACLE = {"op10_topk_threshold": """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5"""}
