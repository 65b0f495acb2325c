"""Secret scans: base patterns, and formats inferred from what they find.

1. One pass over the texts finds the base spans (assignments to names like `token`, access keys, long hexadecimal runs)
   and all other runs of credential characters, the candidates, with their places. It is written as a table; texts are
   not read again.
2. The values in the base spans, and labelled credentials that are given, teach one automaton for each kind; candidates
   teach one of ordinary runs (`grammar.py`). All distinct values are counted, and from all of a kind come its sizes and its
   usual scores: those that a value gets from the counts of the others.
3. Every candidate is scored. It is a secret of the kind whose automaton makes it likeliest if it is about as likely as
   that kind's own values (no less than all but `TAIL` of them), as long as some of them, and `MARGIN` times as likely as an
   ordinary run is.

Null texts are empty and hold nothing. Texts of any length are searched whole, repeated rows and rows without a key each
on their own; the key may have any type. An empty table gives an empty one, a kind without labelled values finds no more
than its pattern. Further columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runweave.llm.common import texts_of, written
from runweave.llm.grammar import STATES, Automaton, infer, learn

#: Kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS, HEX = re.compile(rb"AKIA[A-Z0-9]+"), re.compile(rb"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: A candidate has so many characters at least.
CANDIDATE = 12
#: Up to so many values of a kind cannot tell each other's scores, they keep their own.
FEW = 5
TAIL, MARGIN = 0.01, 1e6
#: Usual scores are held in steps of one part in so many.
STEPS = 1000

_RUN = np.zeros(256, bool)
_RUN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"+/_.=-"]] = True
SPAN = "array<struct<kind: string, start: long, end: long>>"
VALUE = "array<struct<kind: string, value: string>>"
RUNS = "array<struct<start: long, end: long, value: string>>"


def base_spans(text: bytes, runs: list[tuple[int, int]]) -> Iterator[tuple[str, int, int, int]]:
    """Kind, start, end and where the value starts, in bytes. What is long enough for the two patterns without a name
    lies in a run of credential characters."""
    low = text.lower()
    if any(name in low for name in NAMES):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                yield "assign", m.start(), m.end(), m.start(2)
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        for a, b in runs:
            for m in pattern.finditer(text, a, b):
                if m.end() - m.start() >= LEAST[kind]:
                    yield kind, m.start(), m.end(), m.start()


def runs_of(text: bytes) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(_RUN[np.frombuffer(text, np.uint8)], prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    long = end - start >= CANDIDATE
    return list(zip(start[long].tolist(), end[long].tolist(), strict=True))


def trimmed(text: bytes, a: int, b: int) -> tuple[int, int]:
    """A run without what joins it to the words around: a name before the last `=` that is not at its end, and points."""
    inner = text[a:b].rstrip(b"=")
    a += inner.rfind(b"=") + 1
    while b > a and text[b - 1:b] == b".":
        b -= 1
    return a, b


def places(text: bytes, at: list[int]) -> list[int]:
    """Byte positions as positions of characters."""
    if text.isascii() or not at:
        return at
    inside = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) == 0x80)
    return [p - int(inside[p - 1]) if p else 0 for p in at]


def search(text: bytes) -> tuple[list[dict], list[dict], list[dict]]:
    """Base spans, their values, and candidates that share no character with a base span."""
    runs = runs_of(text)
    base = list(base_spans(text, runs))
    free = []
    for a, b in runs:
        a, b = trimmed(text, a, b)
        if b - a >= CANDIDATE and not any(x < b and a < y for _, x, y, _ in base):
            free.append((a, b))
    found = places(text, [p for _, a, b, _ in base for p in (a, b)] + [p for s in free for p in s])
    pairs = list(zip(found[::2], found[1::2], strict=True))
    return ([{"kind": k, "start": a, "end": b} for (k, *_), (a, b) in zip(base, pairs, strict=False)],
            [{"kind": k, "value": text[v:b].rstrip(b".").decode()} for k, _, b, v in base],
            [{"start": s, "end": e, "value": text[a:b].decode()} for (a, b), (s, e) in zip(free, pairs[len(base):], strict=True)])


def searched(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key, `base` spans, their `labelled` values and the `candidates` of every row."""
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, base {SPAN}, labelled {VALUE}, candidates {RUNS}"
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    value = pa.struct([("kind", pa.string()), ("value", pa.string())])
    run = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [search(t) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([o[i] for o in out], pa.list_(kind)) for i, kind in enumerate((span, value, run)))],
                names=["key", "base", "labelled", "candidates"])

    return rows.mapInArrow(find, schema)


def usual(values: DataFrame, known: Mapping[str, Automaton], sizes: Mapping[str, int], tail: float = TAIL) -> dict[str, float]:
    """For each kind the score for each character that all but `tail` of its values have, rounded down to a step."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, step = batch.column(0).to_pylist(), []
            for kind, value in zip(kinds, batch.column(1).to_pylist(), strict=True):
                score = known[kind].score_without(value) if sizes[kind] > FEW else known[kind].score(value)
                step.append(math.floor(score / (len(value) + 1) * STEPS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(step, pa.int64())], names=["kind", "step"])

    steps = values.filter("kind is not null").select("kind", "value").mapInArrow(scored, "kind string, step long").groupBy("kind", "step").count()
    floor, passed = {}, dict.fromkeys(known, 0)
    for kind, step, n in sorted(map(tuple, steps.collect())):
        passed[kind] += n
        if passed[kind] > int(tail * sizes[kind]):
            floor.setdefault(kind, step / STEPS)
    return floor


class Formats:
    """Automata of the kinds and of ordinary runs, from which score on a kind's values are usual, and their sizes."""

    def __init__(self, kinds: Mapping[str, tuple[Automaton, float, int, int]], ordinary: Automaton, margin: float = MARGIN):
        self.margin = math.log(margin)
        self.ordinary, self.kinds = ordinary, kinds

    @classmethod
    def learned(cls, values: DataFrame, tail: float = TAIL, margin: float = MARGIN, states: int = STATES) -> Formats:
        """From all distinct values of all kinds; those of ordinary runs have none."""
        found = values.groupBy("kind").agg(F.count("*").alias("n"), F.min(F.length("value")).alias("least"), F.max(F.length("value")).alias("most"))
        sizes = {r["kind"]: r for r in found.collect() if r["kind"] is not None}
        known = learn(values, states=states)
        ordinary = known.pop(None, None) or infer([])
        floor = usual(values, known, {k: r["n"] for k, r in sizes.items()}, tail) if known else {}
        return cls({k: (known[k], floor[k], sizes[k]["least"], sizes[k]["most"]) for k in sorted(known)}, ordinary, margin)

    def kind_of(self, value: str) -> tuple[str, float] | None:
        """The likeliest kind of a run and the logarithm of how much likelier than an ordinary run it is."""
        best = None
        for kind, (known, floor, least, most) in self.kinds.items():
            if least <= len(value) <= most and (now := known.score(value)) / (len(value) + 1) >= floor:
                ratio = now - self.ordinary.score(value)
                if ratio >= self.margin and (best is None or ratio > best[1]):
                    best = (kind, ratio)
        return best


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", labelled: DataFrame | None = None, tail: float = TAIL,
         margin: float = MARGIN, states: int = STATES) -> DataFrame:
    """Key, `base` spans (kind, start, end in characters) and `added` ones (also `ratio`, the logarithm of how much
    likelier than an ordinary run). `labelled` holds further credentials as (kind, value); an automaton has no more than
    `states` states."""
    table = written(searched(docs, key, text), "searched")
    values = table.select(F.explode("labelled").alias("x")).select("x.kind", "x.value")
    if labelled is not None:
        values = values.unionByName(labelled.filter("kind is not null and value <> ''").select("kind", "value"))
    runs = table.select(F.explode("candidates").alias("x")).select(F.lit(None).cast("string").alias("kind"), "x.value")
    formats = Formats.learned(written(values.unionByName(runs).distinct(), "values"), tail, margin, states)
    added = "array<struct<kind: string, start: long, end: long, ratio: double>>"
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("ratio", pa.float64())]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, tuple[str, float] | None] = {}
            out = []
            for row in batch.column(2).to_pylist():
                now = []
                for c in row:
                    if c["value"] not in known:
                        known[c["value"]] = formats.kind_of(c["value"])
                    if found := known[c["value"]]:
                        now.append({"kind": f"like_{found[0]}", "start": c["start"], "end": c["end"], "ratio": found[1]})
                out.append(now)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, shape)], names=["key", "base", "added"])

    kind = table.schema["key"].dataType.simpleString()
    return table.select("key", "base", "candidates").mapInArrow(judge, f"key {kind}, base {SPAN}, added {added}").withColumnRenamed("key", key)


def written_spans(spans: Column) -> Column:
    """Spans as kind:start:end, by start, then kind in the order of `KINDS` with others last, joined by commas."""
    def place(s: Column) -> Column:
        number = F.lit(len(KINDS))
        for i, kind in enumerate(KINDS):
            number = F.when(s["kind"] == kind, i).otherwise(number)
        return F.struct(s["start"].alias("start"), number.alias("number"), s["kind"].alias("kind"), s["end"].alias("end"))

    ordered = F.array_sort(F.transform(spans, place))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_secret_grammar(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plain = F.transform("added", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(written_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        written_spans(F.concat("base", plain)).alias("spans"), F.size("added").cast("long").alias("n_added"))


QUERIES = {"op13_secret_grammar": op13_secret_grammar}
ORACLE: dict[str, str] = {}
