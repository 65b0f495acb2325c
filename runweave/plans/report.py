"""Report tables of a run: one row per task, and series for charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runweave.operators.ordering import BLOCK_ROWS, number_rows
from runweave.plans.monitor import bottleneck

METRICS = {
    "duration_ms": "double", "db_cpu_ms": "double", "db_io_ms": "double",
    "io_requests": "long", "cache_hits": "long", "parallel_degree": "int",
}


def safe_name(name: Column) -> Column:
    """Letters, digits, dot, underscore, dash and blank of a task name."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}._\- ]", "")


def task_file(folder: str, seq: Column, name: Column, suffix: str) -> Column:
    return F.concat(F.lit(f"{folder}/"), F.format_string("%02d", seq), F.lit("_"), safe_name(name), F.lit(suffix))


def report_rows(tasks: DataFrame, order: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Report entry per task of a run (`run_id`), numbered in `order`.

    Needs `run_id`, `task_name` and `order`; absent metric columns count as missing.
    """
    absent = {name: F.lit(None).cast(kind) for name, kind in METRICS.items()}
    absent |= {name: F.lit(None).cast("string") for name in ("db_type", "plan_content", "rendered_sql")}
    full = tasks.withColumns({name: null for name, null in absent.items() if name not in tasks.columns})
    seconds = lambda name: F.coalesce(F.col(name), F.lit(0.0)) / 1000.0
    seq, name = F.col("seq"), F.col("task_name")
    return number_rows(full, ["run_id"], order, block_rows=block_rows).select(
        "run_id", "seq", "task_name", "db_type",
        seconds("duration_ms").alias("execution_time_sec"),
        F.coalesce("parallel_degree", F.lit(1)).alias("parallel_degree"),
        seconds("db_cpu_ms").alias("cpu_time_sec"),
        seconds("db_io_ms").alias("io_time_sec"),
        bottleneck(F.col("db_cpu_ms"), F.col("db_io_ms"), F.col("io_requests"), F.col("cache_hits")).alias("bottleneck"),
        task_file("plans", seq, name, ".txt").alias("plan_file"),
        F.when(F.col("rendered_sql").isNotNull(), task_file("rendered", seq, name, ".sql")).alias("rendered_sql_file"),
        "plan_content", "rendered_sql",
    )


def report_series(rows: DataFrame, points: int) -> DataFrame:
    """Ordered arrays per run for charts, at most `points` long; `part` numbers the rows of a run from 0."""
    series = {
        "names": "task_name", "durations": "execution_time_sec", "cpu_times": "cpu_time_sec",
        "io_times": "io_time_sec", "parallel_degrees": "parallel_degree",
    }
    part = F.expr(f"(seq - 1) div {int(points)}").alias("part")
    ordered = F.array_sort(F.collect_list(F.struct("seq", *series.values())))
    return (
        rows.groupBy("run_id", part).agg(ordered.alias("_points"))
        .select("run_id", "part", *[F.col(f"_points.{column}").alias(name) for name, column in series.items()])
    )
