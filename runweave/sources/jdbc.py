"""Tables and queries of a database, read in parallel when a numeric or date column can split them."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def jdbc_url(config: Mapping[str, Any]) -> str:
    """URL of a database from its `dialect`, `host`, `port` and `database` or `service`."""
    if config.get("url"):
        return config["url"]
    dialect = config["dialect"]
    if "oracle" in dialect:
        return f"jdbc:oracle:thin:@//{config['host']}:{config['port']}/{config['service']}"
    return f"jdbc:{dialect.split('+')[0]}://{config['host']}:{config['port']}/{config['database']}"


def jdbc_options(
    config: Mapping[str, Any],
    *,
    table: str | None = None,
    query: str | None = None,
    partition_column: str | None = None,
    lower_bound: Any = None,
    upper_bound: Any = None,
    num_partitions: int | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Reader options: a table or a query, and how to split it into parallel reads."""
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    options = {"url": jdbc_url(config), "fetchsize": str(fetch_size)}
    for name in ("user", "password", "driver"):
        if config.get(name):
            options[name] = str(config[name])
    split = {
        "partitionColumn": partition_column, "lowerBound": lower_bound,
        "upperBound": upper_bound, "numPartitions": num_partitions,
    }
    if any(v is not None for v in split.values()):
        missing = [name for name, v in split.items() if v is None]
        if missing:
            raise ValueError(f"a split read also needs {', '.join(missing)}")
        options |= {name: str(v) for name, v in split.items()}
        # A split read needs a relation, so a query becomes a subquery.
        options["dbtable"] = table or f"({query}) q"
    elif query is not None:
        options["query"] = query
    else:
        options["dbtable"] = table
    return options


def scan_jdbc(spark: SparkSession, config: Mapping[str, Any], **how: Any) -> DataFrame:
    """DataFrame over a database table or query; filters and columns are pushed down by Spark."""
    return spark.read.format("jdbc").options(**jdbc_options(config, **how)).load()
