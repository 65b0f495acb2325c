"""Engine statistics: monitored executions and session counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runweave.operators.ordering import BLOCK_ROWS, as_of

# The two session counters a run is measured by, in centiseconds.
CPU_STAT = "CPU used by this session"
IO_STAT = "user I/O wait time"
SESSION_STATS = (CPU_STAT, IO_STAT)


def sql_monitor_agg(monitor: DataFrame, sql_id=None, sid=None) -> DataFrame:
    """Metrics per execution, microseconds to milliseconds; optionally of one statement or session."""
    if sql_id is not None:
        monitor = monitor.where(F.col("sql_id") == sql_id)
    if sid is not None:
        monitor = monitor.where(F.col("sid") == sid)
    sums = ("elapsed_time", "cpu_time", "user_io_wait_time", "physical_read_bytes")
    total = lambda name: F.coalesce(F.sum(name), F.lit(0))
    # Numbers fold per status first, in a hash aggregate; the text maximum would force a sort of the raw rows.
    per_status = monitor.groupBy("sql_id", "sql_exec_id", "status").agg(
        *[F.sum(name).alias(name) for name in sums], F.max("px_servers_allocated").alias("px_servers_allocated"))
    return per_status.groupBy("sql_id", "sql_exec_id").agg(
        (total("elapsed_time") / 1000.0).alias("duration_ms"),
        (total("cpu_time") / 1000.0).alias("db_cpu_ms"),
        (total("user_io_wait_time") / 1000.0).alias("db_io_ms"),
        F.lit(0).cast("long").alias("io_requests"),
        total("physical_read_bytes").alias("io_bytes"),
        F.coalesce(F.max("px_servers_allocated"), F.lit(0)).alias("parallel_degree"),
        F.max("status").alias("status"),
    )


def session_stats(values: DataFrame, names: DataFrame, wanted=SESSION_STATS) -> DataFrame:
    """Map of statistic name to value per session `sid`, for the wanted names only.

    The names are filtered before the join, and each becomes one aggregate, so the rows of a session
    fold on the map side and no list is collected.
    """
    named = values.join(names.where(F.col("name").isin(*wanted)), "statistic")
    columns = [F.max(F.when(F.col("name") == name, F.col("value"))).alias(f"_{i}") for i, name in enumerate(wanted)]
    entries = F.create_map(*[part for i, name in enumerate(wanted) for part in (F.lit(name), F.col(f"_{i}"))])
    return named.groupBy("sid").agg(*columns).select("sid", F.map_filter(entries, lambda _, v: v.isNotNull()).alias("stats"))


def stat_delta(before: DataFrame, after: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Milliseconds spent between two snapshots in centiseconds; a missing counter is 0.

    Both snapshots go through one aggregate with a sign instead of a full outer join, so they are
    shuffled once and pre-aggregated.
    """
    signed = before.select(*keys, (-F.col(value)).alias("_v")).unionByName(after.select(*keys, F.col(value).alias("_v")))
    return signed.groupBy(*keys).agg((F.coalesce(F.sum("_v"), F.lit(0)) * 10).alias("delta_ms"))


def step_deltas(
    steps: DataFrame, snapshots: DataFrame, keys: Sequence[str] = ("sid",), started: str = "started", ended: str = "ended",
    at: str = "at", stats: str = "stats", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add `db_cpu_ms` and `db_io_ms` of each step from a series of snapshots (`stats`: name to value in centiseconds).

    Each end of a step takes the newest snapshot of its session that is not after it; a counter that is missing there, or a
    snapshot that is, counts 0.
    """
    keys = list(keys)
    values = F.struct(*[F.coalesce(F.try_element_at(stats, F.lit(name)), F.lit(0)).cast("long").alias(f"s{i}") for i, name in enumerate(SESSION_STATS)])
    series = snapshots.select(*keys, at, values.alias("_values"))
    told = as_of(steps, series, keys, started, at, "_values", "_before", block_rows)
    told = as_of(told, series, keys, ended, at, "_values", "_after", block_rows)
    delta = lambda i: (F.coalesce(F.col(f"_after.s{i}"), F.lit(0)) - F.coalesce(F.col(f"_before.s{i}"), F.lit(0))) * 10
    return told.select(*steps.columns, delta(SESSION_STATS.index(CPU_STAT)).alias("db_cpu_ms"), delta(SESSION_STATS.index(IO_STAT)).alias("db_io_ms"))


def duration_backfill(duration_ms: Column, wall_seconds: Column) -> Column:
    """Measured duration, or the wall clock when the engine reported none."""
    return F.when(F.coalesce(duration_ms, F.lit(0.0)) == 0, wall_seconds * 1000.0).otherwise(duration_ms)


def bottleneck(db_cpu_ms: Column, db_io_ms: Column, io_requests: Column, cache_hits: Column) -> Column:
    """`I/O` or `CPU` by time, else by blocks read against blocks found in cache, else `Unknown`."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    cpu, io, reads, hits = zero(db_cpu_ms) / 1000.0, zero(db_io_ms) / 1000.0, zero(io_requests), zero(cache_hits)
    by_share = lambda share: F.when(share > 0.5, "I/O").otherwise("CPU")
    return (
        F.when(cpu + io > 0, by_share(F.try_divide(io, cpu + io)))
        .when((reads > 0) & (hits >= 0), by_share(F.try_divide(reads, reads + hits)))
        .otherwise("Unknown")
    )
