"""The queries that users run."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.derived import TABLES, table
from runweave import workloads
from runweave.runs.query import run_sql
from runweave.session import new_run_dir
from runweave.sinks.files import sink_csv, sink_parquet
from runweave.sinks.tables import create_scratch_database, load_table
from runweave.sources.files import scan_csv_strings


def counts(spark, sf_dir):
    return workloads.counts_by_year({
        "orders": (table(spark, sf_dir, "orders"), "o_orderdate"),
        "lineitem": (table(spark, sf_dir, "lineitem"), "l_shipdate"),
        "events": (table(spark, sf_dir, "events"), "ts"),
    })


def reconcile(spark, sf_dir):
    """Orders against the customers in credit; the other orders are mismatches."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    canonical = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    matched = workloads.reconcile(orders, canonical, "o_custkey", "c_custkey")
    return matched.select("o_orderkey", F.coalesce("canonical_id", F.lit(-1)).alias("canonical_id"), "tag")


def load_staging(spark, sf_dir):
    """Raw CSV text, cast and loaded into a table."""
    path = new_run_dir(spark, "raw")
    sink_csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), path)
    staging = f"{create_scratch_database(spark)}.staging_orders"
    raw = scan_csv_strings(spark, path, multi_line=False)
    load_table(raw.selectExpr("try_cast(o_orderkey AS bigint) AS o_orderkey", "try_cast(o_custkey AS bigint) AS o_custkey",
                              "try_cast(o_totalprice AS double) AS o_totalprice", "o_orderstatus"), staging)
    return spark.table(staging)


def filtered_count(spark, sf_dir):
    return workloads.filtered_count(table(spark, sf_dir, "customer"), F.col("c_mktsegment") == "MACHINERY")


def sales_aggregates(spark, sf_dir):
    """Through the whole run surface: named target, parameter, read-only guard."""
    targets = {"WAREHOUSE": {"transport": "parquet", "path": sf_dir, "suffix": ".parquet", "tables": TABLES}}
    return run_sql(
        spark, workloads.SALES_AGGREGATES_SQL, target="WAREHOUSE", targets=targets,
        params={"until": "2000-09-02"}, dql_only=True, fetch_name="sales_aggregates",
    ).data


def archive_old(spark, sf_dir):
    path = new_run_dir(spark, "archive")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    workloads.archive_by_date(orders, "o_orderdate", "1998-01-01", path)
    tiers = [workloads.read_tier(spark, path, tier) for tier in ("archive", "keep")]
    return tiers[0].unionByName(tiers[1]).select("tier", "o_orderkey", "o_totalprice")


def update_scores(spark, sf_dir):
    path = new_run_dir(spark, "scores")
    scores = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("score"))
    sink_parquet(workloads.update_scores(table(spark, sf_dir, "customer"), scores, "c_custkey", "c_acctbal"), path)
    return spark.read.parquet(path).select("c_custkey", "c_name", "c_acctbal")


def update_scores_partitions(spark, sf_dir):
    """Customers by nation; only nations with a matched customer are rewritten."""
    path = new_run_dir(spark, "nations")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey").write.partitionBy("c_nationkey").parquet(path)
    scores = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_totalprice > 499000").groupBy(
        F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("score"))
    workloads.update_partitions(spark, path, scores, "c_custkey", "c_acctbal", "c_nationkey")
    return spark.read.parquet(path).select("c_custkey", "c_name", "c_acctbal", "c_nationkey")


def big_group_join(spark, sf_dir):
    return workloads.big_group_join(*[table(spark, sf_dir, name) for name in ("lineitem", "orders", "customer")])


QUERIES = {
    "counts": counts,
    "reconcile": reconcile,
    "load_staging": load_staging,
    "filtered_count": filtered_count,
    "sales_aggregates": sales_aggregates,
    "archive_old": archive_old,
    "update_scores": update_scores,
    "update_scores_partitions": update_scores_partitions,
    "big_group_join": big_group_join,
}

ORACLE = {
    "counts": """
        SELECT CAST(year(d) AS INT) AS year, table_name, count(*) AS n FROM (
          SELECT o_orderdate AS d, 'orders' AS table_name FROM orders
          UNION ALL SELECT l_shipdate, 'lineitem' FROM lineitem
          UNION ALL SELECT ts, 'events' FROM events) GROUP BY 1, 2""",
    "reconcile": """
        SELECT o_orderkey, coalesce(c_custkey, -1) AS canonical_id, CASE WHEN c_custkey IS NULL THEN 'mismatch' ELSE 'matched' END AS tag
        FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""",
    "load_staging": "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders",
    "filtered_count": "SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'MACHINERY'",
    "sales_aggregates": workloads.SALES_AGGREGATES_SQL.replace(":until", "TIMESTAMP '2000-09-02'"),
    "archive_old": """
        SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'archive' ELSE 'keep' END AS tier, o_orderkey, o_totalprice FROM orders""",
    "update_scores": """
        SELECT c_custkey, c_name, coalesce(score, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (
          SELECT o_custkey, round(sum(o_totalprice), 2) AS score FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) ON o_custkey = c_custkey""",
    "update_scores_partitions": """
        SELECT c_custkey, c_name, coalesce(score, c_acctbal) AS c_acctbal, c_nationkey FROM customer LEFT JOIN (
          SELECT o_custkey, round(sum(o_totalprice), 2) AS score FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 499000
          GROUP BY o_custkey) ON o_custkey = c_custkey""",
    "big_group_join": """
        SELECT c_mktsegment, CAST(year(o_orderdate) AS INT) AS order_year,
               round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS line_count
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        GROUP BY c_mktsegment, year(o_orderdate)""",
}
