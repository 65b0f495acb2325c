"""What the jobs of a block of code took, from Spark's status store: time on the CPU, waiting, tasks, rows, spill, plan."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

GROUP = "spark.jobGroup.id"
#: Newest SQL executions among which the plan of a block is looked for, and seconds to wait for the store.
RECENT, PATIENCE = 100, 10.0


@dataclass
class Measured:
    """Sums over the stages of a block. Stages beyond what `spark.ui.retainedStages` keeps are not in the sums."""

    duration_ms: float = 0.0
    db_cpu_ms: float = 0.0
    #: Time of tasks neither on the CPU nor in garbage collection: reads, shuffles, Python workers.
    db_io_ms: float = 0.0
    #: Most tasks of one stage, as far as there are cores for them; 1 where nothing ran.
    parallel_degree: int = 1
    tasks: int = 0
    rows_read: int = 0
    bytes_read: int = 0
    spilled_bytes: int = 0
    #: The last executed plan, as adaptive execution left it; None where no SQL ran.
    plan: str | None = None


@contextmanager
def measured(spark: SparkSession) -> Iterator[Measured]:
    """Figures of the jobs that this thread starts inside; they are there after the block, also when it fails."""
    context = spark.sparkContext
    before, group = context.getLocalProperty(GROUP), f"measured-{uuid.uuid4().hex}"
    figures = Measured()
    context.setLocalProperty(GROUP, group)
    start = time.monotonic()
    try:
        yield figures
    finally:
        figures.duration_ms = (time.monotonic() - start) * 1000.0
        try:
            _wait_for_store(spark)
            _read(spark, group, figures)
        finally:
            context.setLocalProperty(GROUP, before)


def _wait_for_store(spark: SparkSession) -> None:
    """The store gets events in order and late, so it holds all jobs before a small one once it shows that one's end."""
    context, mark = spark.sparkContext, f"mark-{uuid.uuid4().hex}"
    context.setLocalProperty(GROUP, mark)
    spark.range(1, numPartitions=1).write.format("noop").mode("overwrite").save()
    tracker, until = context.statusTracker(), time.monotonic() + PATIENCE
    while time.monotonic() < until:
        jobs = [tracker.getJobInfo(job) for job in tracker.getJobIdsForGroup(mark)]
        if jobs and all(job is not None and job.status != "RUNNING" for job in jobs):
            return
        time.sleep(0.01)


def _read(spark: SparkSession, group: str, figures: Measured) -> None:
    context = spark.sparkContext
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    jobs = set(tracker.getJobIdsForGroup(group))
    stages = {stage for job in jobs for info in [tracker.getJobInfo(job)] if info is not None for stage in info.stageIds}
    widest = 0
    for stage in stages:
        if tracker.getStageInfo(stage) is None:
            continue
        data = store.lastStageAttempt(stage)
        cpu = data.executorCpuTime() / 1e6
        figures.db_cpu_ms += cpu
        figures.db_io_ms += max(0.0, data.executorRunTime() - cpu - data.jvmGcTime())
        figures.tasks += data.numCompleteTasks()
        figures.rows_read += data.inputRecords()
        figures.bytes_read += data.inputBytes()
        figures.spilled_bytes += data.diskBytesSpilled()
        widest = max(widest, data.numCompleteTasks())
    figures.parallel_degree = max(1, min(widest, context.defaultParallelism))
    figures.plan = _last_plan(spark, jobs)


def _last_plan(spark: SparkSession, jobs: set[int]) -> str | None:
    store: Any = spark._jsparkSession.sharedState().statusStore()
    first = max(0, store.executionsCount() - RECENT)
    found = store.executionsList(first, RECENT)
    for at in reversed(range(found.size())):
        execution = found.apply(at)
        if any(execution.jobs().contains(job) for job in jobs):
            return execution.physicalPlanDescription()
    return None
