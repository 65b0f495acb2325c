"""Sinks and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import derived
from checks.derived import table
from checks.plans import REPORT_SQL
from runweave.functions.sqltext import split_statements
from runweave.plans.report import report_rows
from runweave.session import new_run_dir
from runweave.sinks import files, tables
from runweave.sinks.publish import PublishGroup, published, read_published
from runweave.sinks.runlog import append_json, sink_report
from runweave.sources.files import scan_csv_strings, scan_run_log

ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def sink_csv(spark, sf_dir):
    """Round trip of texts with quotes, commas and line breaks."""
    path = new_run_dir(spark, "csv")
    files.sink_csv(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), path)
    return scan_csv_strings(spark, path).select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text")


def sink_csv_plain(spark, sf_dir):
    path = new_run_dir(spark, "plain")
    steps = derived.steps(spark, sf_dir)
    files.sink_csv_plain(steps.select("manifest", "seq", "enabled", "description", "duration"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def sink_parquet(spark, sf_dir):
    path = new_run_dir(spark, "parquet")
    files.sink_parquet(table(spark, sf_dir, "orders").select(*ORDER_COLUMNS), path)
    return spark.read.parquet(path)


def table_load(spark, sf_dir):
    """A file of several statements, split and run one by one."""
    staging = f"{tables.create_scratch_database(spark)}.staging_orders"
    table(spark, sf_dir, "orders").createOrReplaceTempView("load_orders")
    script = f"""
        CREATE TABLE {staging} (o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING) USING parquet;
        INSERT INTO {staging} SELECT o_orderkey, o_custkey, o_orderstatus FROM load_orders WHERE o_orderstatus = 'F';
        INSERT INTO {staging} SELECT o_orderkey, o_custkey, o_orderstatus FROM load_orders WHERE o_orderstatus <> 'F';
    """
    statements = spark.range(1).select(F.posexplode(split_statements(F.lit(script)))).orderBy("pos")
    for statement in statements.collect():
        spark.sql(statement["col"])
    return spark.table(staging)


def table_drop_if_exists(spark, sf_dir):
    """Load a table, drop it twice, and load it again: only the second load is left."""
    staging = f"{tables.create_scratch_database(spark)}.staging_orders"
    orders = table(spark, sf_dir, "orders").select(*ORDER_COLUMNS)
    tables.load_table(orders, staging)
    tables.drop_table(spark, staging)
    tables.drop_table(spark, staging)
    tables.load_table(orders.withColumn("loads", F.lit(2)), staging)
    return spark.table(staging)


def table_truncate_if_exists(spark, sf_dir):
    """Load, truncate and load again; the schema survives and absent tables are skipped."""
    database = tables.create_scratch_database(spark)
    staging = f"{database}.staging_orders"
    orders = table(spark, sf_dir, "orders").select(*ORDER_COLUMNS)
    tables.load_table(orders, staging)
    tables.truncate_table(spark, staging)
    left = spark.table(staging).count()
    tables.truncate_table(spark, f"{database}.absent")
    tables.load_table(orders, staging)
    return spark.table(staging).withColumn("left_by_truncate", F.lit(left))


def sink_provenance(spark, sf_dir):
    """Two appends to one log; the reader sees both."""
    path = new_run_dir(spark, "runlog")
    records = derived.run_records(spark, sf_dir)
    append_json(records.where("status = 'ok'"), path)
    append_json(records.where("status = 'error'"), path)
    return scan_run_log(spark, path).groupBy("fetch", "status").agg(
        F.count("*").alias("n"), F.sum("elapsed_ms").alias("elapsed_ms"), F.count("error").alias("errors"))


def sink_report_query(spark, sf_dir):
    path = new_run_dir(spark, "report")
    sink_report(report_rows(derived.tasks(spark, sf_dir), "task_no"), path)
    return spark.read.parquet(path).select("run_id", "seq", "task_name", "plan_file", "plan_content", "rendered_sql_file", "rendered_sql")


def publish_group(spark, sf_dir):
    """Two groups publish, a third is discarded; what is current per name is what was published last."""
    folder = new_run_dir(spark, "published")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    first = PublishGroup(spark, folder)
    first.stage("orders", orders.withColumn("version", F.lit(1)))
    first.stage("customers", table(spark, sf_dir, "customer").select("c_custkey"))
    first.publish()
    second = PublishGroup(spark, folder)
    second.stage("orders", orders.withColumn("version", F.lit(2)))
    second.publish()
    lost = PublishGroup(spark, folder)
    lost.stage("orders", orders.withColumn("version", F.lit(3)))
    lost.discard()
    names = published(spark, folder).agg(F.count("*").alias("n")).first()["n"]
    return read_published(spark, folder, "orders").withColumn("published_names", F.lit(names))


QUERIES = {
    "sink_csv": sink_csv,
    "sink_csv_plain": sink_csv_plain,
    "sink_parquet": sink_parquet,
    "table_load": table_load,
    "table_drop_if_exists": table_drop_if_exists,
    "table_truncate_if_exists": table_truncate_if_exists,
    "sink_provenance": sink_provenance,
    "sink_report": sink_report_query,
    "publish_group": publish_group,
}

_ORDERS = f"SELECT {', '.join(ORDER_COLUMNS)}{{}} FROM orders"

ORACLE = {
    "sink_csv": "SELECT doc_id, lang, text FROM documents",
    "sink_csv_plain": f"""
        SELECT concat(manifest, ',', seq, ',', CASE WHEN enabled THEN 'True' ELSE 'False' END, ',',
                      coalesce(description, 'None'), ',', duration) AS line
        FROM ({derived.STEPS_SQL}) s
        UNION ALL SELECT 'manifest,seq,enabled,description,duration'""",
    "sink_parquet": _ORDERS.format(""),
    "table_load": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders",
    "table_drop_if_exists": _ORDERS.format(", 2 AS loads"),
    "table_truncate_if_exists": _ORDERS.format(", 0 AS left_by_truncate"),
    "sink_provenance": f"""
        SELECT "fetch", status, count(*) AS n, CAST(sum(elapsed_ms) AS BIGINT) AS elapsed_ms, count(error) AS errors
        FROM ({derived.RUN_RECORDS_SQL}) r GROUP BY "fetch", status""",
    "sink_report": f"""
        SELECT run_id, seq, task_name, plan_file, plan_content, rendered_sql_file, rendered_sql FROM ({REPORT_SQL}) r""",
    "publish_group": "SELECT o_orderkey, o_orderstatus, 2 AS version, 2 AS published_names FROM orders",
}
