"""Quality classifier by compression: how much shorter is a text with a dictionary of good text than with one of bad?

Two zstandard dictionaries are trained on labelled text, one for each class. Every text is cut into pieces of
`PIECE_BYTES`, each piece is compressed with both. Of the summed sizes, (bad - good) / (bad + good) is the difference and
log((good + bad) / 2 bytes) the density, which tells repetition from speech. Labelled documents that did not go into the
dictionaries calibrate them: a logistic curve over both, fitted by Newton steps, gives the probability of a good text.

Bounds, as parameters: `documents` labelled rows of each class are taken, in the order of a hash, half of them for the
dictionaries, half for the curve; `pieces` pieces of each class reach the driver. Scoring covers whole texts of any
length. Null and empty texts have difference and density 0 and are scored by the curve. Without labelled rows every score
is 0.5. Rows that repeat are scored each; further columns pass through, those named like a result give way to it; labels,
language, source and key are never looked at by a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.llm.common import texts_of

#: Bytes compressed at a time; short enough that the dictionary decides, not what the text repeats of itself.
PIECE_BYTES = 512
LEVEL, DICTIONARY_BYTES = 3, 1 << 18


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, float, float]  # of the difference, the density and 1


def pieces_of(text: bytes) -> list[bytes]:
    return [text[i:i + PIECE_BYTES] for i in range(0, len(text), PIECE_BYTES)]


def dictionary(content: bytes):
    if not content:
        return None
    found = zstandard.ZstdCompressionDict(content)
    found.precompute_compress(level=LEVEL)
    return found


class Differ:
    """Difference and density of a text."""

    def __init__(self, good: bytes, bad: bytes):
        self.both = [zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary(content), write_content_size=False,
                                              write_checksum=False, write_dict_id=False) for content in (good, bad)]

    def __call__(self, text: bytes) -> tuple[float, float]:
        good = bad = 0
        for piece in pieces_of(text):
            good += len(self.both[0].compress(piece))
            bad += len(self.both[1].compress(piece))
        return (bad - good) / (bad + good or 1), math.log((good + bad + 1) / (2 * len(text) + 1))


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary with its tables of literals; of too few samples to train on, their own bytes."""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 100, ridge: float = 1e-3) -> tuple[float, float, float]:
    """Weights of a logistic curve over two columns and 1; targets are smoothed, so that separable classes keep it finite."""
    good, bad = int((y == 1).sum()), int((y == 0).sum())
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    design = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.array([0.0, 0.0, math.log((good + 1) / (bad + 1))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (p - target) + ridge * w
        curve = design.T @ (design * (p * (1 - p))[:, None]) + ridge * np.eye(3)
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 2 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    a, b = w[:2] / scale
    return float(a), float(b), float(w[2] - a * mean[0] - b * mean[1])


def differences(docs: DataFrame, good: bytes, bad: bytes, text: str) -> DataFrame:
    """`docs` with `_difference` and `_density` of each text instead of the text."""
    rest = [f for f in docs.schema if f.name != text]
    names = [*(f.name for f in rest), "_difference", "_density"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        differ = Differ(good, bad)
        for batch in batches:
            out = np.array([differ(t) for t in texts_of(batch.column(0))], np.float64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out[:, 0]), pa.array(out[:, 1])], names=names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "_difference double, _density double"])
    return docs.select(text, *(f.name for f in rest)).mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        documents: int = 4000, pieces: int = 8000) -> Model:
    """Learn from `labels` (key and a label 0 or 1); rows to hold out are left out of it by the caller."""
    order = F.xxhash64(F.col(key), F.lit(11))
    known = labels.filter(labels[label].isin(0, 1)).groupBy(key).agg(F.min(label).alias("_label"))
    chosen = None
    for value in (0, 1):
        # At most `documents` keys of each class, so the broadcast is bounded.
        part = known.filter(F.col("_label") == value).orderBy(order, key).limit(documents)
        chosen = part if chosen is None else chosen.union(part)
    # Not the same hash as above: any half of the chosen rows.
    chosen = chosen.withColumn("_half", F.pmod(F.xxhash64(F.col(key), F.lit(5)), F.lit(2)))
    rows = docs.select(key, F.col(text).alias("_text")).join(F.broadcast(chosen), key).select("_text", "_label", "_half")

    def cut(batches):
        for batch in batches:
            found = [(piece, y) for t, y in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True)
                     for piece in pieces_of(t)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.binary()), pa.array([y for _, y in found], pa.int32())],
                                             names=["piece", "y"])

    cuts = rows.filter("_half = 0").select("_text", F.col("_label").cast("int").alias("y")).mapInArrow(cut, "piece binary, y int")
    samples = [[bytes(r["piece"]) for r in cuts.filter(cuts.y == y).orderBy(F.xxhash64("piece"), "piece").limit(pieces).collect()]
               for y in (0, 1)]
    bad, good = (build_dictionary(s) for s in samples)
    got = differences(rows.filter("_half = 1").select("_text", F.col("_label").cast("int").alias("y")), good, bad, "_text").collect()
    x = np.array([(r["_difference"], r["_density"]) for r in got])
    return Model(good, bad, fit_curve(x, np.array([r["y"] for r in got])) if got else (0.0, 0.0, 0.0))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns `keep` of `docs`, `score` (0 to 1, higher is better) and `predicted` (1 from the threshold on)."""
    kept = [c for c in keep if c not in ("score", "predicted")]
    # Selected twice under two names, so that a kept text stays.
    found = differences(docs.select(*kept, F.col(text).alias("_judged")), model.good, model.bad, "_judged")
    a, b, c = model.weights
    height = F.greatest(F.lit(-700.0), a * F.col("_difference") + b * F.col("_density") + c)
    rated = found.withColumn("score", 1 / (1 + F.exp(-height))).drop("_difference", "_density")
    return rated.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(key: str = "doc_id"):
    """Rows that are never learned from: crc32 of the key as text is divisible by 5."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def learned(spark, docs: DataFrame, sf_dir: str) -> Model:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return fit(docs, labels.filter(~held_out()))


def op8_compression_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rated = score(docs, learned(spark, docs, sf_dir), keep=("doc_id",))
    return rated.select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op8_compression_quality": op8_compression_quality}
ORACLE: dict[str, str] = {}
