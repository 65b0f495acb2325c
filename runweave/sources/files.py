"""File readers: Parquet, CSV as text, run logs, report summaries, SQL files and manifests."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_LOG_SCHEMA = (
    "ts string, fetch string, transport string, sql_hash string, "
    "elapsed_ms bigint, rows bigint, status string, error string"
)
REPORT_SCHEMA = (
    "meta struct<timestamp: string, db: string>, "
    "tasks array<struct<name: string, db_type: string, execution_time_sec: double, parallel_degree: int, "
    "profile: struct<cpu_time_sec: double, io_time_sec: double, bottleneck: string>, "
    "plan_file: string, rendered_sql_file: string, plan_content: string>>"
)


def _paths(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def scan_parquet(spark: SparkSession, paths: str | Sequence[str], filename: bool = False) -> DataFrame:
    """Parquet files or globs; `filename` adds the name of the file each row came from."""
    df = spark.read.parquet(*_paths(paths))
    return df.select("*", F.col("_metadata.file_name").alias("filename")) if filename else df


def scan_csv_strings(spark: SparkSession, paths: str | Sequence[str], multi_line: bool = True) -> DataFrame:
    """CSV with a header, every value text; a missing value reads as empty text.

    `multi_line` allows line breaks inside quotes, at the price of one task per file; turn it off
    for files known to have none, so that large files split.
    """
    df = (
        spark.read.option("header", True).option("inferSchema", False)
        .option("escape", '"').option("multiLine", multi_line)
        .csv(_paths(paths))
    )
    return df.na.fill("") if df.columns else df


def scan_run_log(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Run records, one JSON object per line."""
    return spark.read.schema(RUN_LOG_SCHEMA).json(_paths(paths))


def scan_report_tasks(spark: SparkSession, paths: str | Sequence[str], multi_line: bool = True) -> DataFrame:
    """One row per task of the report summaries. Turn `multi_line` off for one document per line."""
    docs = spark.read.schema(REPORT_SCHEMA).option("multiLine", multi_line).json(_paths(paths))
    return (
        docs.select(F.col("meta.timestamp").alias("timestamp"), F.col("meta.db").alias("db"), F.posexplode("tasks").alias("_pos", "_task"))
        .select("timestamp", "db", (F.col("_pos") + 1).alias("seq"), "_task.*")
        .select("*", "profile.*").drop("profile")
    )


def scan_sql_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Whole files as UTF-8 text with their path; a path that does not exist is an error.

    Spark skips files of no bytes, so an empty file gives no row.
    """
    files = spark.read.format("binaryFile").load(_paths(paths))
    return files.select("path", F.decode("content", "UTF-8").alias("sql_text"))


def read_sql_file(spark: SparkSession, path: str) -> str:
    """Text of one SQL file; a path that holds several is an error."""
    rows = scan_sql_files(spark, path).take(2)
    if len(rows) > 1:
        raise ValueError(f"{path} holds more than one SQL file")
    return rows[0]["sql_text"] if rows else ""


def scan_manifests(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Raw steps of YAML manifests: `manifest` (its path), `seq` from 1, `raw` (map of text).

    Nested values such as `params` are kept as JSON text.
    """
    return _scan_yaml_list(spark, paths, "steps").select(
        F.col("path").alias("manifest"), "seq", F.col("item").alias("raw"))


def scan_catalog(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Entries of YAML SQL catalogs: `sql_id, file, intent, read_only, expected_duration_s`."""
    value = lambda key: F.try_element_at("item", F.lit(key))
    return _scan_yaml_list(spark, paths, "sql").select(
        value("id").alias("sql_id"), value("file").alias("file"), value("intent").alias("intent"),
        F.coalesce(value("read_only") == "true", F.lit(False)).alias("read_only"),
        value("expected_duration_s").try_cast("double").alias("expected_duration_s"),
    )


def _scan_yaml_list(spark: SparkSession, paths: str | Sequence[str], key: str) -> DataFrame:
    """Items of the list below `key` in each YAML file, as maps of text."""

    def text(value) -> str | None:
        if value is None or isinstance(value, str):
            return value
        return json.dumps(value, ensure_ascii=False, default=str)

    def parse(content: str) -> list[dict[str, str]]:
        import yaml

        items = (yaml.safe_load(content) or {}).get(key) or []
        return [{str(k): text(v) for k, v in item.items()} for item in items]

    @F.pandas_udf("array<map<string,string>>")
    def items(contents: pd.Series) -> pd.Series:
        return contents.map(parse)

    files = scan_sql_files(spark, paths)
    return files.select("path", F.posexplode(items("sql_text")).alias("_pos", "item")).select(
        "path", (F.col("_pos") + 1).cast("long").alias("seq"), "item")
