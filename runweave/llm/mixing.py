"""Mixing sources to target weights, in DataFrame functions only: iterative proportional fitting.

Documents are summed to cells, one for each combination of the marginals (source, language, topic); a cell weighs the
words of its documents. Raking scales the cells to the target total of each value of the first marginal, then of the
second, the third, and again, `sweeps` times. What a cell weighs then, over what it weighed, is its multiplier; divided
by the largest multiplier it is the probability with which each of its documents is kept. So the kept words have the
target shares in expectation, and whether a document is kept depends on its key and probability alone.

Targets are given for each marginal, as a mapping of values to weights (few values) or a table of value and `weight`
(many); weights are relative. A value without a target has weight 0: its documents are not kept, empty texts neither. A
target whose documents weigh nothing is left out and the others are scaled up; if that leaves none, nothing is kept.
Targets that contradict each other (a source of one language only, wanted more than that language) are met for the last
marginal and as far as the sweeps come for the others. A marginal without given targets has tempered shares: share **
`temper`, scaled to 1; below 1 large sources shrink against small ones.

What is weighed is `n_tokens`: words between white space, or the column `weight` if it is named, which may hold tokens.

Null marginal values are a value of their own. Texts that are null or empty weigh nothing; a cell without weight, none
of whose targets is 0, keeps its documents as if its multiplier were 1. Rows that repeat a key share their decision, a null key counts as empty text.
An empty table gives an empty one. Further columns pass through; those named like a result give way to it.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runweave.llm.common import WORD, written

SWEEPS, TEMPER = 8, 0.95
#: Cells are broadcast to the documents up to so many, beyond it joined by Spark's own choice.
BROADCAST_CELLS = 100_000

#: Topics that the text itself shows, tested in this order.
TOPICS = (("licence", ("Licensed under", "All rights reserved", "License")), ("table", (" | ",)), ("contact", ("@",)))
#: Weights of the registered mixture: half of the words from src0, a tenth from each of five other sources.
MIXTURE = {"source": {"src0": 0.5, "src1": 0.1, "src2": 0.1, "src3": 0.1, "src4": 0.1, "src5": 0.1},
           "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}}
Targets = Mapping[str, "Mapping[str | None, float] | DataFrame"]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic_of(text: Column, topics: Sequence[tuple[str, Sequence[str]]] = TOPICS) -> Column:
    chosen = F.lit("prose")
    for name, signs in reversed(topics):
        found = F.lit(False)
        for sign in signs:
            found = found | F.coalesce(F.contains(text, F.lit(sign)), F.lit(False))
        chosen = F.when(found, name).otherwise(chosen)
    return chosen


def draw(key: Column) -> Column:
    """A number from 0 to 1 that depends on the key alone."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def checked(targets: Targets | None, marginals: Sequence[str]) -> Targets:
    for name, wanted in (targets or {}).items():
        if name not in marginals:
            raise ValueError(f"targets for {name}, which is none of {', '.join(marginals)}")
        if isinstance(wanted, Mapping) and not (all(0 <= w < math.inf for w in wanted.values()) and any(wanted.values())):
            raise ValueError(f"targets for {name} must be finite, not negative and not all 0")
    return targets or {}


def with_targets(cells: DataFrame, targets: Targets) -> DataFrame:
    """Add `_given_<marginal>`, the weight of the cell's value, for each marginal with targets."""
    for name, wanted in targets.items():
        given = f"_given_{name}"
        if isinstance(wanted, Mapping):
            weight = F.lit(0.0)
            for value, w in wanted.items():
                weight = F.when(F.col(name).eqNullSafe(F.lit(value)), float(w)).otherwise(weight)
            cells = cells.withColumn(given, weight)
        else:
            w = wanted["weight"].cast("double")
            good = F.when((w >= 0) & (w < math.inf), w).otherwise(F.raise_error(F.lit(f"a target for {name} is null, negative or not finite")).cast("double"))
            table = wanted.groupBy(wanted[name].alias("_value")).agg(F.sum(good).alias(given))
            cells = cells.join(table, F.col(name).eqNullSafe(F.col("_value")), "left").drop("_value").fillna(0.0, [given])
    return cells


def rake(cells: DataFrame, marginals: Sequence[str], weight: str = "weight", sweeps: int = SWEEPS, temper: float = TEMPER,
         targets: Targets | None = None) -> DataFrame:
    """Add `raked`, the weight after fitting, and `wanted` (no target is 0) to each cell. The windows run over cells, of
    which there are as many as combinations of values, never over documents."""
    targets = checked(targets, marginals)
    total = F.sum(weight).over(Window.partitionBy())
    out = with_targets(cells, targets).withColumn("raked", F.col(weight).cast("double")).withColumn("_total", total.cast("double"))
    for name in marginals:
        own = F.sum(weight).over(Window.partitionBy(name))
        if name in targets:
            goal = F.when(own > 0, F.col(f"_given_{name}"))
        else:
            goal = F.pow(own / F.when(F.col("_total") > 0, F.col("_total")), F.lit(temper))
        # Every value is counted once: its first cell carries its share.
        first = F.row_number().over(Window.partitionBy(name).orderBy(*marginals)) == 1
        out = out.withColumn(f"_own_{name}", F.coalesce(goal, F.lit(0.0))).withColumn(f"_one_{name}", first)
    every = Window.partitionBy()
    for name in marginals:
        sums = F.sum(F.when(F.col(f"_one_{name}"), F.col(f"_own_{name}"))).over(every)
        out = out.withColumn(f"_goal_{name}", F.coalesce(F.col(f"_own_{name}") / F.when(sums > 0, sums) * F.col("_total"), F.lit(0.0)))
    for _ in range(sweeps):
        for name in marginals:
            now = F.sum("raked").over(Window.partitionBy(name))
            out = out.withColumn("raked", F.when(now > 0, F.col("raked") * F.col(f"_goal_{name}") / now).otherwise(0.0))
    wanted = F.lit(True)
    for name in targets:
        wanted = wanted & (F.col(f"_given_{name}") > 0)
    return out.select(*cells.columns, "raked", wanted.alias("wanted"))


def probabilities(docs: DataFrame, marginals: Sequence[str], weight: str, sweeps: int = SWEEPS, temper: float = TEMPER,
                  targets: Targets | None = None) -> DataFrame:
    """Marginals and `probability` of every cell, as a written table."""
    cells = docs.groupBy(*marginals).agg(F.sum(weight).alias("weight"))
    fitted = rake(cells, marginals, sweeps=sweeps, temper=temper, targets=targets)
    fitted = fitted.withColumn("multiplier", F.when(F.col("weight") > 0, F.col("raked") / F.col("weight")).otherwise(F.col("wanted").cast("double")))
    most = F.max(F.when(F.col("weight") > 0, F.col("multiplier"))).over(Window.partitionBy())
    return written(fitted.withColumn("probability", F.least(F.lit(1.0), F.col("multiplier") / F.coalesce(F.when(most > 0, most), F.lit(1.0)))).select(
        *marginals, "weight", "raked", "probability"), "cells")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", marginals: Sequence[str] = ("source", "lang"),
        sweeps: int = SWEEPS, temper: float = TEMPER, targets: Targets | None = None, weight: str | None = None,
        topics: Sequence[tuple[str, Sequence[str]]] = TOPICS) -> DataFrame:
    """`docs` with `topic`, `n_tokens` (words, or the column `weight`), `probability` and `kept`."""
    names = [*marginals, "topic"]
    rest = [c for c in docs.columns if c not in ("topic", "n_tokens", "probability", "kept")]
    size = F.greatest(F.coalesce(F.col(weight).cast("long"), F.lit(0)), F.lit(0)) if weight else n_words(F.col(text))
    rated = docs.withColumn("_topic", topic_of(F.col(text), topics)).withColumn("_words", size).select(
        *rest, F.col("_topic").alias("topic"), F.col("_words").alias("n_tokens"))
    cells = probabilities(rated, names, "n_tokens", sweeps, temper, targets)
    few = cells.select(*[F.col(c).alias(f"_{c}") for c in names], F.col("probability"))
    if cells.count() <= BROADCAST_CELLS:
        few = F.broadcast(few)
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rated.join(few, same).select(*rest, "topic", "n_tokens", "probability", (draw(F.col(key)) < F.col("probability")).alias("kept"))


def op9_rake_mixing(spark, sf_dir: str, targets: Targets | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, targets=targets).select(
        "doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "kept")


def op9_target_mixing(spark, sf_dir: str) -> DataFrame:
    return op9_rake_mixing(spark, sf_dir, MIXTURE)


def oracle(documents: str = "documents", targets: Mapping[str, Mapping[str, float]] | None = None) -> str:
    targets, empty = targets or {}, "1"
    for name, wanted in targets.items():
        named = ", ".join(f"'{value}'" for value, w in wanted.items() if w > 0)
        empty = f"CASE WHEN {name} IN ({named}) THEN {empty} ELSE 0 END"
    names = ("source", "lang", "topic")
    topic = " ".join("WHEN " + " OR ".join(f"contains(coalesce(text, ''), '{s}')" for s in signs) + f" THEN '{name}'"
                     for name, signs in TOPICS)
    steps, last = [], "base"
    for name in names:
        if name in targets:
            given = " ".join(f"WHEN '{value}' THEN {w!r}::DOUBLE" for value, w in targets[name].items())
            steps.append(f"goal_{name} AS (SELECT {name}, own / sum(own) OVER () * (SELECT sum(w) FROM cells) AS goal FROM "
                         f"(SELECT {name}, CASE WHEN sum(w) > 0 THEN CASE {name} {given} ELSE 0 END ELSE 0 END AS own FROM cells GROUP BY {name}))")
            continue
        steps.append(f"goal_{name} AS (SELECT {name}, own / sum(own) OVER () * (SELECT sum(w) FROM cells) AS goal FROM "
                     f"(SELECT {name}, pow(sum(w) / (SELECT sum(w) FROM cells), {TEMPER}) AS own FROM cells GROUP BY {name}))")
    steps.append("base AS (SELECT *, w::DOUBLE AS r FROM cells)")
    for sweep in range(SWEEPS):
        for name in names:
            this = f"s{sweep}_{name}"
            steps.append(f"{this} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, w, CASE WHEN now > 0 THEN r * goal / now ELSE 0 END AS r "
                         f"FROM (SELECT *, sum(r) OVER (PARTITION BY {name}) AS now FROM {last}) c "
                         f"JOIN goal_{name} g ON c.{name} IS NOT DISTINCT FROM g.{name})")
            last = this
    return f"""
WITH rated AS (
  SELECT doc_id, source, lang, CASE {topic} ELSE 'prose' END AS topic,
    coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS n_tokens FROM {documents}),
cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS w FROM rated GROUP BY ALL),
{", ".join(steps)},
scaled AS (SELECT *, CASE WHEN w > 0 THEN r / w ELSE {empty} END AS m FROM {last}),
chances AS (SELECT *, least(1, m / coalesce((SELECT max(m) FROM scaled WHERE w > 0), 1)) AS p FROM scaled)
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(p, 6) AS probability,
  ('0x' || left(md5(coalesce(doc_id::VARCHAR, '')), 8))::BIGINT / 4294967296.0 < p AS kept
FROM rated d JOIN chances c ON d.source IS NOT DISTINCT FROM c.source AND d.lang IS NOT DISTINCT FROM c.lang AND d.topic = c.topic"""


QUERIES = {"op9_rake_mixing": op9_rake_mixing, "op9_target_mixing": op9_target_mixing}
ORACLE = {"op9_rake_mixing": oracle(), "op9_target_mixing": oracle(targets=MIXTURE)}
