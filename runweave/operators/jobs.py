"""Run logs and jobs: what is done, what is pending, how a job ended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Text in a log that marks a failed job.
FAILURE_MARKS = ("CRITICAL", "failed after")


def done_steps(run_log: DataFrame) -> DataFrame:
    """Steps that an append-only log with `manifest, seq, ts, status` shows as done last.

    Times are compared as numbers, so the log folds in a hash aggregate before its shuffle.
    """
    at = F.unix_micros(F.try_to_timestamp("ts"))
    done = F.col("status") == "done"
    return (
        run_log.groupBy("manifest", "seq")
        .agg(F.max(F.when(done, at)).alias("_done"), F.max(F.when(~done, at)).alias("_other"))
        .where("_done >= coalesce(_other, _done)")
        .select("manifest", "seq")
    )


def resume_pending(steps: DataFrame, run_log: DataFrame) -> DataFrame:
    """Enabled steps that the log does not show as done last."""
    return steps.where("enabled").join(done_steps(run_log), ["manifest", "seq"], "left_anti")


def log_failed(line: Column) -> Column:
    failed = F.lit(False)
    for mark in FAILURE_MARKS:
        failed = failed | F.contains(line, F.lit(mark))
    return failed


def newest_jobs(jobs: DataFrame, n: int) -> DataFrame:
    return jobs.orderBy(F.desc("started"), F.desc("job_id")).limit(n)


def job_status(jobs: DataFrame, log_lines: DataFrame, newest: int | None = None) -> DataFrame:
    """`RUNNING`, `FAILED` or `FINISHED` per job, from `alive` and the lines of its log.

    With `newest`, only that many jobs, latest `started` first. Log lines are folded to one flag
    per job before they meet the jobs, so no log is ever assembled.
    """
    if newest:
        jobs = newest_jobs(jobs, newest)
        log_lines = log_lines.join(jobs.select("job_id"), "job_id", "left_semi")
    failed = log_lines.groupBy("job_id").agg(F.bool_or(log_failed(F.col("line"))).alias("_failed"))
    status = F.when(F.col("alive"), "RUNNING").when(F.coalesce("_failed", F.lit(False)), "FAILED").otherwise("FINISHED")
    return jobs.join(failed, "job_id", "left").withColumn("status", status).drop("_failed")


def latest_log_lines(jobs: DataFrame, log_lines: DataFrame, n: int = 5, width: int = 120) -> DataFrame:
    """The closing lines of the newest job's log, in order."""
    newest = newest_jobs(jobs, 1).select("job_id")
    return (
        log_lines.join(F.broadcast(newest), "job_id", "left_semi")
        .orderBy(F.desc("line_no")).limit(n)
        .select("job_id", "line_no", F.left("line", F.lit(width)).alias("line"))
    )
