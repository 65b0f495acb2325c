"""A training corpus from `documents`, in stages; each stage is one operator of `runweave.llm`.

A stage takes the documents that its predecessor kept, as `(spark, docs, sf_dir)`, and returns documents with the same
columns; the last one adds what training reads. `run` writes each stage's rows as Parquet to the shared folder and reads
them back, so a lost executor costs a stage at most the work of its own tasks.

Columns beyond those of `documents` pass through every stage unless they have the name of a result, which replaces
them. Null and empty texts are kept by the stages that remove text or copies, and by the first where its curve says so.
Rows that repeat a key are all kept or all dropped by the second stage's choice of one document for each group of equal
texts; rows without a key stay there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.llm import jaccard, mixing, quality, substring, wordtable
from runweave.llm.common import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the compression classifier, learned from the labels, rejects."""
    rated = quality.score(docs, quality.learned(spark, docs, sf_dir), keep=tuple(docs.columns))
    return rated.filter("predicted = 1").select(*docs.columns)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    copies = jaccard.groups(docs).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(written(copies, "copies"), "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut; a text without any stays as it is."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    # Under another name, since the operator replaces columns named like its results.
    held = docs.select("doc_id", "text", *[F.col(c).alias(f"held_{c}") for c in rest], F.col("text").alias("held_text"),
                       F.col("n_chars").alias("held_n_chars"))
    cut = substring.deduplicate(held, keep=[f"held_{c}" for c in (*rest, "text", "n_chars")])
    changed = F.col("n_removed") > 0
    values = {"doc_id": F.col("doc_id"), "text": F.when(changed, F.col("kept")).otherwise(F.col("held_text")),
              "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("held_n_chars"))}
    return cut.select(*[values.get(c, F.col(f"held_{c}")).alias(c) for c in docs.columns])


def sample_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents so that sources, languages and topics have their target weights."""
    return mixing.mix(docs).filter("kept").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add `n_tokens`, `ids_sha256` and `decoded_sha256` of the byte-level BPE."""
    import public_tokenizers

    coded = wordtable.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))
    names = ("n_tokens", "ids_sha256", "decoded_sha256")
    kept = [c for c in docs.columns if c not in names]
    # Rows that repeat a key have equal texts here or get each other's codes; one row of codes for each key and text.
    by = coded.dropDuplicates(["doc_id", "decoded_sha256"]).select(F.col("doc_id").alias("_id"), *names)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("decoded_sha256"))
    told = docs.select(*kept).withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return told.join(by, same).select(*kept, *names)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_group),
    ("substring dedup", cut_repeats),
    ("mixing sources to target weights", sample_mixture),
    ("BPE encoding and decoding", encode),
]

#: The classifier's score, made of compressed sizes, has no SQL; `tests/llm/test_pipeline.py` holds the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
