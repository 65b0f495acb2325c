"""Outputs that become visible together.

Every output of a group is written to a path of its own. One log file that names all of them is the
publication: it is committed as a whole, so readers see every output of the group or none. An
output that no log names was not published.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.sinks.files import sink_csv, sink_csv_plain, sink_parquet

PUBLISH_SCHEMA = "name string, format string, path string, group_id string, published_at string"
WRITERS = {"parquet": sink_parquet, "csv": sink_csv, "csv_plain": sink_csv_plain}


class PublishGroup:
    """Stage outputs, then publish or discard them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.group_id = uuid.uuid4().hex
        self.staged: list[tuple[str, str, str]] = []

    def stage(self, name: str, df: DataFrame, format: str = "parquet") -> str:
        path = f"{self.folder}/data/{self.group_id}/{len(self.staged):03d}"
        if WRITERS[format](df, path) is not False:
            self.staged.append((name, format, path))
        return path

    def publish(self) -> None:
        if self.staged:
            at = datetime.now(timezone.utc).isoformat()
            rows = [(*output, self.group_id, at) for output in self.staged]
            self.spark.createDataFrame(rows, PUBLISH_SCHEMA).coalesce(1).write.mode("append").json(f"{self.folder}/log")
        self.staged = []

    def discard(self) -> None:
        self.staged = []


def published(spark: SparkSession, folder: str) -> DataFrame:
    """Current output per name: the one published last."""
    log = spark.read.schema(PUBLISH_SCHEMA).json(f"{folder.rstrip('/')}/log")
    # A group numbers its outputs in their paths, so of one name staged twice the later one wins.
    latest = F.max_by(F.struct(*[c for c in log.columns if c != "name"]),
                      F.struct("published_at", "group_id", F.regexp_extract("path", r"(\d+)/*\z", 1).cast("long")))
    return log.groupBy("name").agg(latest.alias("_last")).select("name", "_last.*")


def read_published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The published Parquet output of that name."""
    row = published(spark, folder).where(F.col("name") == name).first()
    if row is None:
        raise ValueError(f"nothing is published as {name!r}")
    return spark.read.parquet(row["path"])
