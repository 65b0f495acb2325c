"""Run one SQL text over registered tables and named targets."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Mapping
from contextlib import nullcontext
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from runweave.functions.sqltext import GUARDED_KEYWORDS, WHITESPACE
from runweave.runs.measure import measured
from runweave.runs.parsed import has_named_parameter, parse, tables_named, writing_command
from runweave.sinks.files import sink_csv, sink_parquet
from runweave.sinks.runlog import append_run_log, run_record
from runweave.sources.targets import Targets, listed, resolve_target, target_views

GUARD = re.compile(rf"^[^\S\n]*+({'|'.join(GUARDED_KEYWORDS)})\b", re.IGNORECASE | re.MULTILINE)


class DqlOnlyError(ValueError):
    """SQL that is not a single read-only statement."""


def check_dql(sql: str) -> None:
    """Raise when a line starts with a guarded keyword, or when there is more than one statement."""
    match = GUARD.search(sql)
    if match:
        raise DqlOnlyError(f"read-only mode: a line starts with '{match.group(1)}'")
    if len(script_statements(sql)) > 1:
        raise DqlOnlyError("read-only mode: more than one statement")


def check_reads(spark: SparkSession, sql: str) -> None:
    """Raise when Spark parses the text as a command that changes something, wherever its keyword stands."""
    command = writing_command(spark, parse(spark, sql))
    if command:
        raise DqlOnlyError(f"read-only mode: the statement is a {command}")


def target_tables(spark: SparkSession, sql: str, config: Mapping[str, Any], params: Mapping[str, Any] | None) -> list[str]:
    """Tables of a target that a statement reads, by its parsed plan; one that the target does not list raises."""
    plan = parse(spark, sql)
    named = {".".join(name) for name in tables_named(plan)}
    lost = sorted(name for name in named if not listed(config, [name]))
    if lost:
        raise ValueError(f"[TABLE_OR_VIEW_NOT_FOUND] the target lists no table {', '.join(lost)}")
    if has_named_parameter(plan):
        named |= {value for value in (params or {}).values() if isinstance(value, str)}
    return listed(config, named)


def hash_text(sql: str) -> str:
    return hashlib.sha256(sql.encode("utf-8")).hexdigest()[:16]


def limit_wrap(df: DataFrame, limit: int | None) -> DataFrame:
    """Cap the rows; 0 and None mean no cap."""
    return df.limit(int(limit)) if limit else df


def lower_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.lower() for name in df.columns])


@dataclass(frozen=True)
class QueryResult:
    """A lazy result. Running it counts the rows on the way and appends the run record."""

    data: DataFrame
    sql_hash: str
    transport: str
    fetch_name: str
    log_dir: str | None

    @property
    def columns(self) -> list[str]:
        return self.data.columns

    def run(self, action: Callable[[DataFrame], Any]) -> tuple[Any, dict[str, Any]]:
        """Apply an action to the rows; returns its value and the run record."""
        seen = Observation()
        observed = self.data.observe(seen, F.count(F.lit(1)).alias("rows"))
        start = time.monotonic()
        elapsed = lambda: int((time.monotonic() - start) * 1000)
        try:
            value = action(observed)
        except Exception as exc:
            self._log(run_record(self.fetch_name, self.transport, self.sql_hash, elapsed(), 0, str(exc)))
            raise
        record = run_record(self.fetch_name, self.transport, self.sql_hash, elapsed(), seen.get["rows"])
        self._log(record)
        return value, record

    def to_csv(self, path: str) -> dict[str, Any]:
        return self.run(lambda df: sink_csv(df, path))[1]

    def to_parquet(self, path: str) -> dict[str, Any]:
        return self.run(lambda df: sink_parquet(df, path))[1]

    def _log(self, record: Mapping[str, Any]) -> None:
        if self.log_dir:
            append_run_log(self.data.sparkSession, self.log_dir, [record])


def run_sql(
    spark: SparkSession,
    sql: str,
    *,
    target: str | None = None,
    targets: Targets | None = None,
    tables: Mapping[str, DataFrame] | None = None,
    params: Mapping[str, Any] | None = None,
    limit: int | None = None,
    dql_only: bool = False,
    fetch_name: str = "ad_hoc",
    log_dir: str | None = None,
) -> QueryResult:
    """Analyse a SQL text and return its lazy result.

    Tables come from a named target, from `tables`, or from the session. `:name` marks in the text
    are bound to `params`. A statement over a target sees the target's own tables only, which are views
    while it is analysed. With `log_dir`, a record is appended when the result runs, or at once
    when the text fails analysis.
    """
    if dql_only:
        check_dql(sql)
    if target is not None and tables is not None:
        raise ValueError("`target` and `tables` exclude each other")
    config = None if target is None else resolve_target(targets or {}, target)
    transport = "session" if config is None else config.get("transport", "parquet")
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)

    sql_hash = hash_text(f"SELECT * FROM ({sql}) sub LIMIT {int(limit)}" if limit else sql)
    start = time.monotonic()
    try:
        if dql_only:
            check_reads(spark, sql)
        views = nullcontext()
        if config is not None:
            views = target_views(spark, targets, target, target_tables(spark, sql, config, params))
        with views:
            data = limit_wrap(spark.sql(sql, args=dict(params) if params else None), limit)
    except Exception as exc:
        if log_dir:
            elapsed = int((time.monotonic() - start) * 1000)
            append_run_log(spark, log_dir, [run_record(fetch_name, transport, sql_hash, elapsed, 0, str(exc))])
        raise
    return QueryResult(data, sql_hash, transport, fetch_name, log_dir)


# -- scripts ------------------------------------------------------------------------------------

# Quoted text and comments are kept whole, so a `;` in them ends no statement.
_SCRIPT_PART = re.compile(r"""(?:'(?:[^']|'')*'|"[^"]*"|`[^`]*`|--[^\n]*|/\*.*?\*/|[^;])+""", re.DOTALL)
_COMMENT = re.compile(r"--[^\n]*|/\*.*?\*/", re.DOTALL)


def script_statements(text: str) -> list[str]:
    return [part.strip(WHITESPACE) for part in _SCRIPT_PART.findall(text) if _COMMENT.sub("", part).strip()]


def run_script(spark: SparkSession, text: str, params: Mapping[str, Any] | None = None) -> DataFrame | None:
    """Run the statements of a script in order and stop at the first error.

    Returns the lazy result of the last statement. Views of earlier statements are not materialised,
    so Catalyst still plans a chain of them as one query. A SQL `BEGIN … END` block is not used here,
    because it collects its results on the driver.
    """
    result = None
    for statement in script_statements(text):
        result = spark.sql(statement, args=dict(params) if params else None)
    return result


def profile_query(spark: SparkSession, sql: str) -> DataFrame:
    """Run a query without keeping its rows; one row with the executed plan, rows, milliseconds and what its tasks took."""
    sql = sql.strip(WHITESPACE).rstrip(";")
    result, seen = spark.sql(sql), Observation()
    with measured(spark) as took:
        result.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(
        [(hash_text(sql), took.plan, seen.get["rows"], took.duration_ms, took.parallel_degree, took.db_cpu_ms, took.db_io_ms,
          took.tasks, took.rows_read, took.bytes_read, took.spilled_bytes)],
        "sql_hash string, plan_content string, rows bigint, duration_ms double, parallel_degree int, db_cpu_ms double, "
        "db_io_ms double, tasks bigint, rows_read bigint, bytes_read bigint, spilled_bytes bigint",
    )
