"""Substring deduplication over a compacted de Bruijn graph of token k-mers.

A passage repeats if `window` consecutive words of a document also start in a document with a smaller key. All its words
go, except in the document with the smallest key.

1. Of the k-mers (`GRAM` words) in each window the one with the smallest hash is a vertex; two windows with the same words
   choose the same. The edge to the next vertex of a document is the run of words that ends with it, so vertices and edges
   spell the whole text, with about one vertex for every 18 words.
2. Vertices of two or more documents are repeated, found by an aggregate over all of them that also keeps the smallest key
   (the source). If all documents go on from a vertex in the same way to both sides, it does not branch. A join brings this
   back to each document, and neighbours that do not branch are compacted to one path: all documents of one vertex hold
   the whole path, so the path is repeated as a whole and its source decides.
3. A window is within its path, and decided with it, unless its vertex branches or the window reaches over the path's
   ends. Those windows are taken in stretches, neighbours with the same vertex, up to `STRETCH`. Stretches with the same words have the same
   windows, so a stretch that a document with a smaller key has too is repeated as a whole: by 128 bits over its words, an
   aggregate for the smallest key, and a join back. Only in the document with the smallest key of each stretch the windows are
   compared one by one, in the same way; of a group of copies that is one.

Texts are hashed in full, nothing is sampled from the result: every window has its vertex. Vertices meet by 64 bits;
should two k-mers collide, the vertex branches and its windows are compared.

Null texts are empty. Paths and removed runs belong to a row, named by its key and a 64-bit hash of its whole text; equal
rows are taken once and all get the result. Rows with the same key do not remove words from each other; rows without a
key lose nothing and take nothing. Texts shorter than a window keep all words. An empty table gives an empty one. Further columns pass
through if named; those named like a result give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runweave.llm.common import Spans, Words, chunks, mix, signed, slide, texts_of, written

WINDOW, GRAM = 50, 16
#: Windows in a stretch that is compared as a whole.
STRETCH = 8
#: Places of a stretch in a text: from the first to the last of a run.
RUNS = "array<struct<first: int, last: int>>"
SMALL = np.uint64(0x9E3779B97F4A7C15)


class Vertices:
    """Vertices of some texts: place in all words, text, and the run of words that both edges span."""

    def __init__(self, words: Words, window: int):
        self.gram = gram = min(GRAM, window)
        self.width = window - gram + 1
        self.spans = Spans(words.hashes())
        doc, total = words.doc, len(words.doc)
        if total < window:
            self.grams = self.low = np.empty(0, np.uint64)
            self.at = self.doc = self.left = self.right = np.empty(0, np.int64)
            return
        self.grams = np.maximum(self.spans.grams(gram), np.uint64(1))
        self.low = slide(self.grams, self.width, np.minimum).copy()
        self.low[doc[: total - window + 1] != doc[window - 1:]] = 0
        pad = np.zeros(self.width - 1, np.uint64)
        self.at = np.flatnonzero(slide(np.concatenate([pad, self.low, pad]), self.width, np.maximum) == self.grams)
        self.doc = doc[self.at]
        same = self.doc[1:] == self.doc[:-1]
        self.left, self.right = words.first[self.doc].copy(), words.first[self.doc + 1].copy()
        self.left[1:][same] = self.at[:-1][same]
        self.right[:-1][same] = self.at[1:][same] + gram

    def around(self, words: Words) -> np.ndarray:
        """Hash of both edges, with the vertex's place in them and whether they are ends of the text."""
        ends = (self.left == words.first[self.doc]) * 2 + (self.right == words.first[self.doc + 1])
        place = ((self.at - self.left) * 4 + ends).astype(np.uint64)
        return mix(self.spans(self.left, self.right) + place * SMALL)


def _named(batch: pa.RecordBatch):
    """Keys, hashes (`id`) and texts of a batch, in parts that are hashed together."""
    texts = texts_of(batch.column("text"))
    keys, ids = batch.column("key").to_pylist(), batch.column("id").to_pylist()
    for low, high in chunks([len(t) for t in texts]):
        yield low, keys[low:high], ids[low:high], Words(texts[low:high])


def vertices(docs: DataFrame, window: int, places: bool) -> DataFrame:
    """Vertex, key and id of the row, and either the edges' hash or its place, packed with the lengths of the edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, keys, ids, words in _named(batch):
                found = Vertices(words, window)
                if places:
                    inside = found.at - words.first[found.doc]
                    last = inside << 16 | (found.at - found.left) << 8 | (found.right - found.at)
                else:
                    last = signed(found.around(words))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(found.grams[found.at])), pa.array(np.array(keys, np.int64)[found.doc]),
                     pa.array(np.array(ids, np.int64)[found.doc]), pa.array(last)], names=["vertex", "key", "id", "last"])

    return docs.filter("key is not null").select("key", "id", "text").mapInArrow(run, "vertex long, key long, id long, last long")


def paths(docs: DataFrame, window: int) -> DataFrame:
    """Compacted repeated paths in each row (`key`, `id`), written: words from `low` to `high`, `plain` if it does not branch (else
    a single vertex), the `source` and the places `at` of its vertices."""
    gram = min(GRAM, window)
    repeated = vertices(docs, window, places=False).groupBy("vertex").agg(
        F.min("key").alias("source"), F.max("key").alias("_most"), (F.min("last") == F.max("last")).alias("plain"))
    # A table of its own: an aggregate in the same stage would keep Spark from splitting a hot vertex in the join.
    repeated = written(repeated.filter("source < _most").drop("_most"), "vertices")
    here = vertices(docs, window, places=True).join(repeated, "vertex").select(
        "key", "id", "source", "plain", F.shiftright("last", 16).cast("int").alias("at"),
        F.expr("cast((last >> 8) & 255 as int)").alias("left"), F.expr("cast(last & 255 as int)").alias("right"))
    order = Window.partitionBy("key", "id").orderBy("at")
    # Equal rows have the same vertices at the same places: each is taken once, so that no place ties with itself.
    here = here.withColumn("_before", F.lag("at").over(order)).filter("_before is null or _before < at").drop("_before")
    goes_on = F.col("plain") & F.lag("plain").over(order) & (F.lag(F.expr(f"at + right - {gram}")).over(order) == F.col("at"))
    path = F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(order)
    # Grouped by row and path: as many vertices at most as the text has.
    return written(here.withColumn("path", path).groupBy("key", "id", "path").agg(
        F.min(F.expr("at - left")).alias("low"), F.max(F.expr("at + right")).alias("high"), F.first("plain").alias("plain"),
        F.min("source").alias("source"), F.collect_list("at").alias("at")).drop("path"), "paths")


def open_stretches(docs: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """Stretches of windows that their paths do not decide, written, once for each row: 128 bits (`s1`, `s2`) over the words of
    each, its places `at`, its number of windows and the 128 bits of each window (`w1`, `w2`) in their order."""
    by_row = found.groupBy(F.col("key").alias("_key"), F.col("id").alias("_id")).agg(
        F.collect_list(F.struct("low", "high", "plain", "at")).alias("paths"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.filter(batch.column("paths").is_valid())
            listed = mine.column("paths").to_pylist()
            for row, keys, ids, words in _named(mine):
                known = Vertices(words, window)
                at, low, high, plain = [], [], [], []
                for i, each in enumerate(listed[row:row + len(keys)]):
                    first = int(words.first[i])
                    for p in each:
                        at += [first + a for a in p["at"]]
                        low += [first + p["low"]] * len(p["at"])
                        high += [first + p["high"]] * len(p["at"])
                        plain += [p["plain"]] * len(p["at"])
                place = np.array(at, np.int64)
                start = place[:, None] - np.arange(known.width)[None, :]
                fits = (start >= 0) & (start < len(known.low))
                own = fits & (known.low[np.where(fits, start, 0)] == known.grams[place][:, None]) if len(known.low) else fits & False
                inside = np.array(plain, bool)[:, None] & (start >= np.array(low, np.int64)[:, None]) & (
                    start + window <= np.array(high, np.int64)[:, None])
                rows, ahead = np.nonzero(own & ~inside)
                begin, which = np.unique(start[rows, ahead], return_index=True)
                ahead = ahead[which]
                doc = words.doc[begin] if len(begin) else begin
                second = Spans(words.hashes(1), 1)
                # A stretch goes on as long as the next window follows and has the same vertex, `STRETCH` windows at most: it is cut
                # at fixed distances before the vertex, so that an edit nearby leaves the other stretches as they are.
                new = np.ones(len(begin), bool)
                new[1:] = (np.diff(begin) != 1) | (np.diff(ahead) != -1) | (np.diff(ahead // STRETCH) != 0)
                first = np.flatnonzero(new)
                edge = np.append(first, len(begin))
                low, high = begin[first], begin[edge[1:] - 1] + window
                mine, s1, s2 = doc[first], known.spans(low, high), second(low, high)
                # A stretch that a text repeats is one row, with its places as runs of at most a window between neighbours.
                order = np.lexsort((low, s2, s1, mine))
                other = np.ones(len(order), bool)
                other[1:] = (np.diff(mine[order]) != 0) | (s1[order][1:] != s1[order][:-1]) | (s2[order][1:] != s2[order][:-1])
                place = (low - words.first[mine])[order].astype(np.int32)
                far = other.copy()
                far[1:] |= np.diff(place) > window
                head, runs = np.flatnonzero(other), np.flatnonzero(far)
                at = pa.StructArray.from_arrays([pa.array(place[runs]), pa.array(place[np.append(runs[1:], len(order))[:len(runs)] - 1])], names=["first", "last"])
                kept = order[head]
                n = np.diff(edge)[kept]
                bound = np.concatenate([[0], np.cumsum(n)])
                pick = begin[np.repeat(first[kept] - bound[:-1], n) + np.arange(bound[-1])]
                both = [pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(signed(hashed(pick, pick + window))))
                        for hashed in (known.spans, second)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(s1[kept])), pa.array(signed(s2[kept])), pa.array(np.array(keys, np.int64)[mine[kept]]),
                     pa.array(np.array(ids, np.int64)[mine[kept]]),
                     pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(runs, head), len(runs)).astype(np.int32)), at),
                     pa.array(n.astype(np.int32)), *both], names=["s1", "s2", "key", "id", "at", "n", "w1", "w2"])

    rows = docs.join(by_row, same_row(docs), "left").drop("_key", "_id")
    return written(rows.mapInArrow(run, f"s1 long, s2 long, key long, id long, at {RUNS}, n int, w1 array<long>, w2 array<long>"), "stretches")


def earlier(rows: DataFrame, by: list[str]) -> DataFrame:
    """The smallest key (`source`) of what more than one key has."""
    return rows.groupBy(*by).agg(F.min("key").alias("source"), F.max("key").alias("_most")).filter("source < _most").drop("_most")


def same_row(docs: DataFrame) -> Column:
    return (docs["key"] == F.col("_key")) & (docs["id"] == F.col("_id"))


def deduplicate(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text",
                keep: Sequence[str] = ()) -> DataFrame:
    """Key, `n_words`, `n_removed`, `removed` (runs of words as [from, to)), `kept` (words joined by one space) and the
    columns `keep` of every row."""
    if not 2 <= window <= 200:
        raise ValueError(f"a window has 2 to 200 words, not {window}")
    rest = [c for c in keep if c not in (key, "n_words", "n_removed", "removed", "kept")]
    base = docs.select(docs[key].cast("long").alias("key"), F.xxhash64(docs[text]).alias("id"), docs[text].alias("text"),
                       *[docs[c].alias(f"keep_{c}") for c in rest])
    found = paths(base, window)
    stretches = open_stretches(base, found, window)
    shared = stretches.join(written(earlier(stretches, ["s1", "s2"]), "shared"), ["s1", "s2"], "left")
    whole = shared.filter("source < key").select("key", "id", F.explode("at").alias("x"), "n").select(
        "key", "id", F.col("x.first").alias("low"), F.expr(f"x.last + n - 1 + {window}").alias("high"))
    # Whoever has a window has it in a stretch, and the smallest key of that stretch has it too.
    each = shared.filter("source is null or source = key").select("key", "id", "at", F.posexplode(F.arrays_zip("w1", "w2")).alias("i", "w"))
    each = written(each.select("w.w1", "w.w2", "key", "id", "at", "i"), "windows")
    singles = each.join(earlier(each, ["w1", "w2"]), ["w1", "w2"]).filter("source < key").select(
        "key", "id", F.explode("at").alias("x"), "i").select(
        "key", "id", F.expr("x.first + i").alias("low"), F.expr(f"x.last + i + {window}").alias("high"))
    gone = found.filter(f"plain and source < key and high - low >= {window}").select("key", "id", "low", "high").unionByName(whole).unionByName(singles)
    # Grouped by row, as a set because equal rows have equal runs: as many at most as the text has words.
    by_row = gone.groupBy(F.col("key").alias("_key"), F.col("id").alias("_id")).agg(F.collect_set(F.struct("low", "high")).alias("runs"))
    schema = base.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs").to_pylist()
            for row, keys, _, words in _named(batch):
                edge = np.zeros(len(words.doc) + 1, np.int64)
                for i, each in enumerate(runs[row:row + len(keys)]):
                    if each:
                        both = np.array([(r["low"], r["high"]) for r in each], np.int64) + words.first[i]
                        np.add.at(edge, both[:, 0], 1)
                        np.add.at(edge, both[:, 1], -1)
                stays = np.cumsum(edge)[:-1] == 0
                size, out = np.diff(words.first), []
                count = np.concatenate([[0], np.cumsum(stays)])[words.first]
                for i in range(len(keys)):
                    low, high = words.first[i], words.first[i + 1]
                    mine = stays[low:high]
                    edges = (np.flatnonzero(np.diff(mine, prepend=True, append=True))).reshape(-1, 2).tolist() if not mine.all() else []
                    out.append((words.text(low + np.flatnonzero(mine)), edges))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(size, pa.int64()), pa.array(size - np.diff(count), pa.int64()),
                     pa.array([o[1] for o in out], pa.list_(pa.list_(pa.int64()))), pa.array([o[0].decode() for o in out], pa.string()),
                     *(batch.column(f"keep_{c}").slice(row, len(keys)) for c in rest)],
                    names=["key", "n_words", "n_removed", "removed", "kept", *(f"keep_{c}" for c in rest)])

    columns = ["key long", "n_words long", "n_removed long", "removed array<array<long>>", "kept string",
               *(f"`keep_{c}` {schema[f'keep_{c}'].dataType.simpleString()}" for c in rest)]
    rows = base.join(by_row, same_row(base), "left").drop("_key", "_id").mapInArrow(run, ", ".join(columns))
    return rows.withColumnsRenamed({"key": key} | {f"keep_{c}": c for c in rest})


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return deduplicate(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLE: dict[str, str] = {}
