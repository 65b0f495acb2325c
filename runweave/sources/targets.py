"""Named targets: where the tables behind a name live, and views over them."""

from __future__ import annotations

import threading
from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from runweave.sources.files import scan_csv_strings, scan_parquet
from runweave.sources.jdbc import scan_jdbc

Targets = Mapping[str, Mapping[str, Any]]
# Views belong to the session, so only one target at a time has its own there.
_VIEWS = threading.RLock()


def resolve_target(targets: Targets, name: str) -> dict[str, Any]:
    """Settings of a target; an unknown name raises and lists the known ones."""
    if name not in targets:
        raise ValueError(f"Unknown target: {name!r}. Registered targets: {sorted(targets) or 'none'}")
    return dict(targets[name])


def target_table(spark: SparkSession, config: Mapping[str, Any], table: str) -> DataFrame:
    """One table of a target, by its transport: parquet (default), csv, json, orc, table or jdbc."""
    transport = config.get("transport", "parquet")
    location = f"{config['path'].rstrip('/')}/{table}{config.get('suffix', '')}" if "path" in config else table
    if transport == "parquet":
        return scan_parquet(spark, location)
    if transport == "csv":
        return scan_csv_strings(spark, location)
    if transport in ("json", "orc"):
        return spark.read.format(transport).load(location)
    if transport == "table":
        return spark.table(f"{config['database']}.{table}" if config.get("database") else table)
    if transport == "jdbc":
        return scan_jdbc(spark, config, table=table)
    raise ValueError(f"Unknown transport: {transport!r}")


def register_target(spark: SparkSession, targets: Targets, name: str, only: Iterable[str] | None = None) -> dict[str, Any]:
    """Make the target's tables available to SQL as temporary views; returns its settings.

    With `only`, other tables are not opened. The views stay, and replace views of the same names; `target_views` is for
    views that are there for one statement.
    """
    config = resolve_target(targets, name)
    for table in listed(config, only):
        target_table(spark, config, table).createOrReplaceTempView(table)
    return config


def listed(config: Mapping[str, Any], names: Iterable[str] | None = None) -> list[str]:
    """Tables of a target, of these names in any case if there are some."""
    wanted = None if names is None else {n.lower() for n in names}
    return [table for table in config["tables"] if wanted is None or table.lower() in wanted]


@contextmanager
def target_views(spark: SparkSession, targets: Targets, name: str, only: Iterable[str] | None = None) -> Iterator[dict[str, Any]]:
    """The target's tables as temporary views inside the block; after it, views that had these names are there again.

    Spark binds tables when a statement is analysed, so a result made inside may run later. What a caller has cached under one
    of the names is computed anew.
    """
    with _VIEWS:
        own = listed(resolve_target(targets, name), only)
        views = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary} if own else set()
        before = {table: spark.table(table) for table in own if table.lower() in views}
        try:
            yield register_target(spark, targets, name, own)
        finally:
            for table in own:
                if table in before:
                    before[table].createOrReplaceTempView(table)
                else:
                    spark.catalog.dropTempView(table)
