"""Order-dependent operators that stay parallel when one key owns most of the rows.

A segmented scan: a window over a whole key sorts that key in one task, which is right for keys of up to `block_rows` rows.
The rows of all heavier keys are cut together into ranges of equal row count, by key and order value, whatever the
distances between order values are. The window runs inside each key's part of a range, and one row for each part, with
what it carries over to the next, goes through a window over the key.

The rules are the same for every key. The order column is an integer. A row without an order value comes first, a null key
is a key. Rows with equal order values are ordered by their other columns (those that can be ordered), so the result
does not depend on how the rows are dealt; rows that share key and order value lie in one range.

The keys are counted by a job of its own when the operator is called, and the heavier ones are written to
the checkpoint folder once, with their range: a range is never computed twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runweave.session import shared_dir

BLOCK_ROWS = 1 << 20
BROADCAST_ROWS = 50_000


def _cut_heavy(df: DataFrame, keys: Sequence[str], order: str, block_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of the keys of up to `block_rows` rows, and the others, if any, with their range as `_block`."""
    hot = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > block_rows)
    rows = hot.agg(F.sum("_n")).first()[0]
    if not rows:
        return df, None
    hot = hot.select(*keys)
    ranges = _join(df, hot, keys, "left_semi").repartitionByRange(max(2, -(-rows // block_rows)), *keys, order)
    shared_dir(df.sparkSession)
    return _join(df, hot, keys, "left_anti"), ranges.withColumn("_block", F.spark_partition_id()).checkpoint()


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which a null key meets a null key."""
    named = right.withColumnsRenamed({key: f"_right_{key}" for key in keys})
    same = reduce(and_, [F.col(key).eqNullSafe(F.col(f"_right_{key}")) for key in keys])
    return left.join(named, same, how).drop(*[f"_right_{key}" for key in keys])


def _integer(df: DataFrame, order: str) -> None:
    kind = df.schema[order].dataType
    if not isinstance(kind, T.IntegralType):
        raise ValueError(f"order column {order!r} must be an integer, not {kind.simpleString()}")


def _can_order(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_can_order(field.dataType) for field in kind)
    if isinstance(kind, T.ArrayType):
        return _can_order(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def _places(df: DataFrame, keys: Sequence[str], order: str) -> list[str]:
    """The columns that place a row within its key: the order column, then every other that can be ordered."""
    return [order, *[f.name for f in df.schema if f.name not in (*keys, order) and _can_order(f.dataType)]]


def number_rows(
    df: DataFrame, keys: Sequence[str], order: str, out: str = "seq", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Number the rows of each key from 1 in `order`."""
    _integer(df, order)
    places = _places(df, keys, order)
    light, heavy = _cut_heavy(df, keys, order, block_rows)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*places))
    numbered = light.select(*df.columns, number.cast("long").alias(out))
    if heavy is None:
        return numbered
    within = Window.partitionBy(*keys, "_block").orderBy(*places)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        heavy.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
        .select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    blocked = (
        heavy.withColumn("_local", F.row_number().over(within))
        .transform(_join, offsets, [*keys, "_block"])
        .select(*df.columns, (F.col("_offset") + F.col("_local")).alias(out))
    )
    return numbered.unionByName(blocked)


def _number_runs(rows: DataFrame, keys: Sequence[str], places: Sequence[str], head: Column) -> DataFrame:
    """Add `_run`, the number of the row's run of one `_label` within `keys`, and `_head` of the run's first row."""
    within = Window.partitionBy(*keys).orderBy(*places)
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("_starts", F.when(F.lag("_label").over(within) == F.col("_label"), 0).otherwise(1))
        .withColumn("_head", F.when(F.col("_starts") == 1, head))
        .withColumn("_run", F.sum("_starts").over(running))
        .withColumn("_head", F.last("_head", ignorenulls=True).over(running))
    )


def consecutive_runs(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    label: Column,
    carry: Sequence[str] = (),
    out: str = "run_no",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Number the runs of consecutive rows that share a label; a null label never merges.

    Adds `out` (1, 2, … per key), `run_start` (order value of the run's first row) and, for each
    column in `carry`, `run_<column>` with its value in the run's first row.
    """
    _integer(df, order)
    places = _places(df, keys, order)
    head = F.struct(F.col(order).alias("run_start"), *[F.col(c).alias(f"run_{c}") for c in carry])
    light, heavy = _cut_heavy(df, keys, order, block_rows)
    numbered = _number_runs(light.withColumn("_label", label), keys, places, head).select(
        *df.columns, F.col("_run").alias(out), "_head.*")
    if heavy is None:
        return numbered

    local = _number_runs(heavy.withColumn("_label", label), [*keys, "_block"], places, head)
    over_blocks = Window.partitionBy(*keys).orderBy("_block")
    before = over_blocks.rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*places)  # a row without an order value counts, and comes first
    # One row per block: does its first run continue the run that closed the block before?
    blocks = (
        local.groupBy(*keys, "_block").agg(
            F.max("_run").alias("_runs"),
            F.min_by("_label", place).alias("_first"),
            F.max_by("_label", place).alias("_last"),
            F.max_by("_head", place).alias("_last_head"),
        )
        .withColumn("_joins", F.when(F.lag("_last").over(over_blocks) == F.col("_first"), 1).otherwise(0))
        .withColumn("_own", F.when((F.col("_runs") > 1) | (F.col("_joins") == 0), F.col("_last_head")))
        .withColumn("_open", F.last("_own", ignorenulls=True).over(over_blocks))
        .withColumn("_inherited", F.when(F.col("_joins") == 1, F.lag("_open").over(over_blocks)))
        .withColumn("_before", F.coalesce(F.sum(F.col("_runs") - F.col("_joins")).over(before), F.lit(0)))
        .select(*keys, "_block", (F.col("_before") - F.col("_joins")).alias("_base"), "_inherited")
    )
    first_run = F.when(F.col("_run") == 1, F.col("_inherited"))
    blocked = (
        _join(local, blocks, [*keys, "_block"])
        .withColumn(out, F.col("_base") + F.col("_run"))
        .withColumn("_head", F.coalesce(first_run, F.col("_head")))
        .select(*df.columns, out, "_head.*")
    )
    return numbered.unionByName(blocked)


def carry_forward(
    df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Replace nulls in `columns` by the last value before them, within `keys` in `order`."""
    _integer(df, order)
    places = _places(df, keys, order)
    light, heavy = _cut_heavy(df, keys, order, block_rows)

    def filled(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        running = Window.partitionBy(*by).orderBy(*places).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumns({c: F.last(c, ignorenulls=True).over(running) for c in columns})

    out = filled(light, keys)
    if heavy is None:
        return out
    place = F.struct(*places)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each block: the last value in it, then the last one of the blocks before.
    last = heavy.groupBy(*keys, "_block").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"_last_{c}") for c in columns])
    carried = last.select(*keys, "_block", *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_from_{c}") for c in columns])
    local = _join(filled(heavy, [*keys, "_block"]), carried, [*keys, "_block"])
    return out.unionByName(local.select(*[F.coalesce(c, f"_from_{c}").alias(c) if c in columns else c for c in df.columns]))


def as_of(
    rows: DataFrame, series: DataFrame, keys: Sequence[str], at: str, series_at: str, value: str, out: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add `out`: `value` of the newest row of `series` with the same keys and a time that is not after the row's.

    Both go through one ordered scan as a union, so nothing is joined by range. Times are timestamps; a row without one gets
    null, and so does a row before the first of the series. Of series rows at one time any may be taken.
    """
    micros = lambda name: F.unix_micros(F.col(name).cast("timestamp"))
    points = series.where(F.col(series_at).isNotNull()).select(*keys, (micros(series_at) * 2).alias("_at"), F.struct(F.col(value).alias("value")).alias("_seen"))
    asking = rows.withColumn("_at", micros(at) * 2 + 1).withColumn("_asks", F.lit(True))
    both = asking.unionByName(points, allowMissingColumns=True)
    found = carry_forward(both, keys, "_at", ["_seen"], block_rows).where("_asks")
    return found.select(*rows.columns, F.when(F.col("_at").isNotNull(), F.col("_seen.value")).alias(out))


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for narrow rows counted to be few; beyond that the join is left to Catalyst.

    Counting runs the input, so this is for checkpoints and other cheap inputs.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread_nulls(key: Column, *unique: Column) -> Column:
    """Join key whose nulls are replaced by distinct values that match nothing, so that rows
    without a key do not all land in one task of an outer join."""
    return F.coalesce(key, F.concat(F.lit("\x00"), F.xxhash64(*unique).cast("string")))
