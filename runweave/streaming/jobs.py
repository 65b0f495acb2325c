"""Live status of jobs, from a stream of what their logs say."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from runweave.operators.jobs import log_failed

EVENT_SCHEMA = "job_id long, ts timestamp, line string, ended boolean"
STATUS_SCHEMA = "job_id long, version long, status string, ts timestamp"
# failed, ended, version, the status told last, and the newest time in microseconds
_STATE = "failed boolean, ended boolean, version long, told string, newest long"


def _follow(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    failed, ended, version, told, newest = state.get if state.exists else (False, False, 0, "", 0)
    for rows in batches:
        failed = failed or bool(rows["failed"].any())
        ended = ended or bool(rows["ended"].any())
        newest = max(newest, int(rows["micros"].max()))
    status = ("FAILED" if failed else "FINISHED") if ended else "RUNNING"
    if status != told:
        version += 1
        yield pd.DataFrame({"job_id": [key[0]], "version": [version], "status": [status], "ts": [pd.Timestamp(newest, unit="us")]})
    state.update((failed, ended, version, status, newest))
    if ended:
        # Lines of an ended job may still arrive until the watermark is past its newest row.
        state.setTimeoutTimestamp(max(newest // 1000, state.getCurrentWatermarkMs()) + 1)


def follow_jobs(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Changes of status, as a stream: `job_id`, `version` (1, 2, ... within a job), `status`, `ts`.

    `events` has `job_id`, `ts`, `line` and `ended`, true in the row that says that the job is over. A job is `RUNNING` from
    its first row, `FAILED` or `FINISHED` once it ended; a line that arrives after that, by at most `late`, may still make it
    `FAILED`. A job's state is five values however long its log is, and is dropped when the watermark has passed the newest
    row of an ended job. Rows later than `late` are ignored, as are rows without a job or time, and times up to 1970-01-01. Lines are judged before the
    shuffle, so no log text is moved.
    """
    judged = (
        events.where("job_id is not null and ts is not null")
        .withWatermark("ts", late)
        .select("job_id", "ts", F.coalesce(log_failed(F.col("line")), F.lit(False)).alias("failed"),
                F.coalesce("ended", F.lit(False)).alias("ended"), F.unix_micros("ts").alias("micros"))
    )
    return judged.groupBy("job_id").applyInPandasWithState(
        _follow, STATUS_SCHEMA, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def job_events(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Events from Parquet files of a folder, as they arrive."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(folder)


def write_changes(changes: DataFrame, path: str, checkpoint: str, **trigger: Any) -> StreamingQuery:
    """Append every change to `path`, each micro-batch as one folder that a repeated batch replaces; by default what has
    arrived is worked off and the query stops."""

    def append(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return (
        changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).foreachBatch(append).start()
    )


def current_status(spark: SparkSession, path: str) -> DataFrame:
    """The newest status of each job that `write_changes` has told: `job_id`, `status`."""
    told = spark.read.schema(f"{STATUS_SCHEMA}, batch long").parquet(path)
    return told.groupBy("job_id").agg(F.max_by("status", "version").alias("status"))
