"""Spark session defaults and the shared folder that jobs may write to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "runweave", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library is written for. On a cluster leave `master` unset and
    size `spark.sql.shuffle.partitions` with `shuffle_partitions`; AQE coalesces down from it."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shuffle_partitions(shuffle_bytes: int, target_bytes: int = 200 << 20, least: int = 200, most: int = 100_000) -> int:
    """Value for `spark.sql.shuffle.partitions` that keeps a partition near `target_bytes`."""
    return max(least, min(most, -(-shuffle_bytes // target_bytes)))


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: `spark.checkpoint.dir`, as the cluster names it.

    Where it is unset, a local master falls back to a folder below the warehouse, which every session names.
    """
    context = spark.sparkContext
    base = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir")
        or context.getCheckpointDir()
    )
    if base is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_runweave"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base.rstrip("/")


def new_run_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is created until something is written to it."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def spread_scan(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan over all cores when it has fewer partitions than these, as files of one
    row group have; meant for heavy work per row. A scan with enough partitions is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
