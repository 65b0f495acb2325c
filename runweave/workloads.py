"""The queries that users run: counts, reconciliation, aggregates, archiving and score updates."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def counts_by_year(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows per year and table; each table comes with its date column. Only that column is read."""
    parts = [df.select(F.year(date).alias("year"), F.lit(name).alias("table_name")) for name, (df, date) in tables.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("year", "table_name").agg(F.count("*").alias("n"))


def reconcile(staging: DataFrame, canonical: DataFrame, key: str, canonical_key: str) -> DataFrame:
    """Staging rows with their canonical id, tagged `matched` or `mismatch`.

    No broadcast is forced; AQE broadcasts a small canonical side and splits a skewed key otherwise.
    """
    ids = canonical.select(F.col(canonical_key).alias("canonical_id"))
    return staging.join(ids, F.col(key) == F.col("canonical_id"), "left").withColumn(
        "tag", F.when(F.col("canonical_id").isNull(), "mismatch").otherwise("matched"))


def filtered_count(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition).agg(F.count("*").alias("n"))


SALES_AGGREGATES_SQL = """
SELECT l_returnflag, l_linestatus,
       round(sum(l_quantity), 2) AS sum_qty,
       round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       round(avg(l_quantity), 4) AS avg_qty,
       round(avg(l_discount), 4) AS avg_disc,
       count(*) AS count_order
FROM lineitem
WHERE l_shipdate <= :until
GROUP BY l_returnflag, l_linestatus
"""


def archive_by_date(df: DataFrame, date: str, bound: str, path: str) -> None:
    """Write rows before the bound and the rest to their own folders, in one pass over the input."""
    tier = F.when(F.col(date) < F.lit(bound).cast("timestamp_ntz"), "archive").otherwise("keep")
    df.withColumn("tier", tier).write.mode("overwrite").partitionBy("tier").parquet(path)


def read_tier(spark: SparkSession, path: str, tier: str) -> DataFrame:
    """Rows of one tier; the other tier's folder is pruned."""
    return spark.read.parquet(path).where(F.col("tier") == tier)


def update_scores(rows: DataFrame, scores: DataFrame, key: str, column: str) -> DataFrame:
    """Replace a column where there is a new score for the key, keep it elsewhere."""
    new = scores.select(key, F.col("score").alias("_score"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("_score", column)).drop("_score")


def update_partitions(spark: SparkSession, path: str, scores: DataFrame, key: str, column: str, partition: str) -> list:
    """Replace a column by new scores in a partitioned folder, rewriting only partitions that hold a matched key.

    Returns the values of the rewritten partitions, which are few against the rows; the rest keeps its files. The rows are
    read from the folder that is overwritten: Spark writes them aside and moves them when all tasks have ended.
    """
    rows = spark.read.parquet(path)
    touched = rows.select(key, partition).join(scores.select(key), key, "left_semi").select(partition).distinct()
    values = [row[partition] for row in touched.toLocalIterator()]
    if values:
        known = [v for v in values if v is not None]
        inside = F.col(partition).isin(known) if known else F.lit(False)
        if len(known) < len(values):
            inside = inside | F.col(partition).isNull()
        changed = update_scores(rows.where(inside), scores, key, column).select(rows.columns)
        changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return values


def big_group_join(lineitem: DataFrame, orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Revenue per market segment and order year: two joins and an aggregate.

    The joins carry only the columns the aggregate needs. Join strategy and skew are left to AQE;
    the aggregate folds each partition before its shuffle.
    """
    lines = lineitem.select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    heads = orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("order_year"))
    buyers = customer.select("c_custkey", "c_mktsegment")
    return (
        lines.join(heads, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(buyers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_mktsegment", "order_year")
        .agg(F.round(F.sum("revenue"), 2).alias("revenue"), F.count("*").alias("line_count"))
    )
