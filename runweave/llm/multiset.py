"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions only.

A text is a multiset of passages: its paragraphs, cut further at sentence ends. A passage is hashed to a vector of
`LANES` elements, each a signed 16-bit number; a document's fingerprint is the sum of those vectors modulo 2^32, in
hexadecimal. Between steps lanes are signed 32-bit integers. So the order of passages does not matter, and a fingerprint
follows an edit without the rest of the text: `combine` adds or takes away the fingerprint of what was inserted or deleted.

Equal multisets have equal fingerprints. The scalar product of two sums estimates how much two multisets share, so
their cosine, cut at 0, is the likeness: 1 for equal fingerprints, and 0 if only one is empty. Hashes are not keyed;
the fingerprint is not meant against forged texts.

Null texts are empty: the sum of nothing, all zeros. Equal rows get equal results. Texts under one key are each
fingerprinted; as the "next document" such a key stands for the one with the smallest SHA-256. A null key sorts after
the others. One document alone follows itself. Further columns are not read. Long texts are hashed whole.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runweave.llm.common import written

LANES = 64
#: Ends of paragraphs and of sentences.
CUT = r"\n+|(?<=[.!?]) +"
_MODULUS = 1 << 32
#: A number modulo 2^32 as a 32-bit integer.
WRAP = "cast(pmod({} + 2147483648L, 4294967296L) - 2147483648L as int)"


def passages(text: Column) -> Column:
    return F.filter(F.split(text, CUT), lambda p: p != "")


def sums(df: DataFrame, texts: dict[str, str], *by: str) -> DataFrame:
    """`by`, `copies` (rows with this `by`, whose texts are equal) and for each name in `texts` the lanes of that column:
    one row for each passage, summed in the task that has it. A passage adds at most 2^15 to a lane, so a sum stays
    below 2^63; what the copies of a text add up to is divided by their number."""
    def piece(which: int, passage: Column) -> Column:
        return F.struct(F.lit(which).alias("which"), passage.alias("passage"))

    mark = F.array(piece(-1, F.lit("")))  # one for each row, also of an empty text
    pieces = [F.transform(passages(F.col(c)), partial(piece, i)) for i, c in enumerate(texts.values())]
    rows = df.select(*by, F.explode(F.concat(mark, *pieces)).alias("_p")).select(*by, "_p.which", "_p.passage")
    rows = rows.select(*by, "which", F.xxhash64("passage").alias("_a"), F.xxhash64("passage", F.lit(1)).alias("_b"))
    rows = rows.select(*by, "which", *[F.xxhash64("_a", "_b", F.lit(i)).alias(f"_h{i}") for i in range(LANES // 4)])
    elements = [F.shiftrightunsigned(f"_h{i}", 16 * j).bitwiseAND(F.lit(0xFFFF)) - 32768 for i in range(LANES // 4) for j in range(4)]
    # Each text has its own row of sums, few enough columns for generated code, and a document's rows are where it is.
    own = rows.groupBy(*by, "which").agg(F.count("*").alias("_rows"), *[F.sum(x).alias(f"_{i}") for i, x in enumerate(elements)])
    own = own.select(*by, "which", "_rows", F.array(*[f"_{i}" for i in range(LANES)]).alias("_lanes"))
    copies = F.max(F.when(F.col("which") == -1, F.col("_rows"))).alias("copies")
    summed = own.groupBy(*by).agg(copies, *[F.first(F.when(F.col("which") == n, F.col("_lanes")), True).alias(f"_{n}") for n in range(len(texts))])
    lanes = {name: F.expr(f"transform(coalesce(_{n}, array_repeat(0L, {LANES})), x -> {WRAP.format('x div copies')})")
             for n, name in enumerate(texts)}
    return summed.select(*by, "copies", *[x.alias(name) for name, x in lanes.items()])


def hexadecimal(lanes: Column) -> Column:
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(F.pmod(x.cast("long"), F.lit(_MODULUS)))), 8, "0")), "")


def combine(lanes: Column, other: Column, sign: int = 1) -> Column:
    """Lanes after passages with the lanes `other` were added (sign 1) or taken away (-1)."""
    half = F.lit(_MODULUS // 2)
    return F.zip_with(lanes, other, lambda x, y: (F.pmod(x.cast("long") + sign * y.cast("long") + half, F.lit(_MODULUS)) - half).cast("int"))


def _centred(lanes: Column) -> Column:
    return lanes.cast("array<double>")


def _product(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda total, p: total + p)


def likeness(lanes: Column, other: Column) -> Column:
    """1 for equal fingerprints, else the cosine of the two sums, from 0 to 1."""
    x, y = _centred(lanes), _centred(other)
    size = F.sqrt(_product(x, x)) * F.sqrt(_product(y, y))
    cosine = F.when(size > 0, _product(x, y) / size).otherwise(0.0)
    return F.when(lanes == other, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def with_lanes(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the lanes of a text, joined by its SHA-256; a null text is empty."""
    named = df.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumn("_sha", digest(F.col("_text")))
    found = sums(named, {"lanes": "_text"}, "_sha").select(F.col("_sha").alias("_of"), F.col("lanes").alias(name))
    return named.join(found, F.col("_sha") == F.col("_of")).drop("_text", "_sha", "_of")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and fingerprint of every text."""
    found = with_lanes(docs.select(docs[key].alias("key"), docs[text].alias("text")), "text", "lanes")
    return found.select(F.col("key").alias(key), hexadecimal(F.col("lanes")).alias("fingerprint"))


def followers(sizes: DataFrame) -> DataFrame:
    """`key`, `need`, `after`: for each key the next one, descending, the last followed by the first. The sort is
    distributed; numbers from its partitions link neighbours, and one row for each partition links partitions."""
    ranked = written(sizes.orderBy(F.desc_nulls_last("key")).withColumn("at", F.monotonically_increasing_id()), "ranked")
    parts = ranked.groupBy(F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    every = Window.orderBy("part")  # one row for each partition of the sort
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = parts.select(F.col("last").alias("at"), F.coalesce(F.lead("first").over(every), F.min("first").over(whole)).alias("jump"))
    linked = ranked.join(ends, "at", "left").select("key", "need", F.coalesce("jump", F.col("at") + 1).alias("at"))
    return linked.join(ranked.select("at", F.col("key").alias("after")), "at").select("key", "need", "after")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of the text with its last third replaced by the start of the next document,
    with likenesses to it and to that document."""
    def named(column: Column) -> Column:
        """Never null, so that plain joins keep null keys and what was joined by it is grouped where it is."""
        return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))

    base = docs.select(named(docs[key]).alias("k"), docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
    base = base.withColumn("sha", digest(F.col("text")))
    after = followers(docs.groupBy(docs[key].alias("key")).agg(F.max(F.length(F.coalesce(docs[text], F.lit("")))).alias("need")))
    # The same columns by the same key as below: Spark shuffles the texts once.
    other = base.join(after.select(named(F.col("key")).alias("to"), "need", named(F.col("after")).alias("k2")), F.col("k") == F.col("k2"))
    sent = other.groupBy("to").agg(F.min(F.struct("sha", F.expr("substring(text, 1, need div 3)").alias("prefix"), "key")).alias("n"))
    rows = base.join(sent, F.col("k") == F.col("to")).select(
        "k", "key", "sha", "text", F.length("text").cast("long").alias("n_chars"), named(F.col("n.key")).alias("next_k"),
        F.col("n.sha").alias("next_sha"),
        F.concat(F.expr("substring(text, 1, cast(length(text) - length(text) div 3 as int))"),
                 F.expr("substring(n.prefix, 1, cast(length(text) div 3 as int))")).alias("edited"))
    by = ("k", "key", "sha", "n_chars", "next_k", "next_sha", "edited_sha")
    both = sums(rows.withColumn("edited_sha", digest(F.col("edited"))), {"lanes": "text", "edited_lanes": "edited"}, *by)
    both = written(both, "lanes")
    following = both.select(F.col("k").alias("_k"), F.col("sha").alias("_sha"), F.col("lanes").alias("next_lanes"))
    rows = both.join(following, (F.col("next_k") == F.col("_k")) & (F.col("next_sha") == F.col("_sha")))
    rows = rows.select(F.col("key").alias(key), "n_chars", F.col("edited_sha").alias("edited_sha256"),
                       hexadecimal(F.col("lanes")).alias("fingerprint"), hexadecimal(F.col("edited_lanes")).alias("edited_fingerprint"),
                       likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
                       likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"), "copies")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("_copy", "copies")


def op3_multiset_fingerprint(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_multiset_fingerprint": op3_multiset_fingerprint}
ORACLE: dict[str, str] = {}
