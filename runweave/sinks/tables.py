"""Catalog tables: a scratch database, statement files, drop and truncate when present."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from runweave.session import new_run_dir


def create_scratch_database(spark: SparkSession, label: str = "scratch") -> str:
    """A new database whose tables are stored below the shared folder."""
    name = f"{label}_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{new_run_dir(spark, label)}'")
    return name


def load_table(df: DataFrame, table: str, mode: str = "append") -> None:
    """Write rows to a table, creating it when needed."""
    df.write.mode(mode).saveAsTable(table)


def drop_table(spark: SparkSession, table: str) -> None:
    """Drop a table; silent when there is none."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def truncate_table(spark: SparkSession, table: str) -> bool:
    """Remove the rows of a table and keep its schema; false when there is no such table."""
    if not spark.catalog.tableExists(table):
        return False
    spark.sql(f"TRUNCATE TABLE {table}")
    return True
