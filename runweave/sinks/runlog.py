"""Run records and report tables."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from runweave.sources.files import RUN_LOG_SCHEMA

log = logging.getLogger(__name__)

# Fixed value: characters of an error kept in a run record.
ERROR_CHARS = 500


def run_record(fetch: str, transport: str, sql_hash: str, elapsed_ms: int, rows: int, error: str | None = None) -> dict[str, Any]:
    return {
        "ts": datetime.now().isoformat(timespec="seconds"),
        "fetch": fetch,
        "transport": transport,
        "sql_hash": sql_hash,
        "elapsed_ms": elapsed_ms,
        "rows": rows,
        "status": "ok" if error is None else "error",
        "error": None if error is None else error[:ERROR_CHARS],
    }


def append_json(records: DataFrame, path: str) -> None:
    records.write.mode("append").option("ignoreNullFields", False).json(path)


def append_run_log(spark: SparkSession, path: str, records: Sequence[Mapping[str, Any]], schema: str = RUN_LOG_SCHEMA) -> bool:
    """Append records to a log folder; a failure is logged and never breaks the run."""
    try:
        append_json(spark.createDataFrame([dict(r) for r in records], schema).coalesce(1), path)
        return True
    except Exception as exc:  # the log must not break the query it describes
        log.warning("Could not append to run log %s: %s", path, exc)
        return False


def sink_report(rows: DataFrame, path: str) -> None:
    """Write report rows sorted by run and task, so a reader of one run skips the other files.

    Range partitioning keeps the files even when one run owns most of the tasks.
    """
    rows.repartitionByRange("run_id", "seq").sortWithinPartitions("run_id", "seq").write.mode("append").parquet(path)
