"""Sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import derived
from checks.derived import table
from runweave.plans.explain import execution_time, parse_plan
from runweave.session import new_run_dir
from runweave.sinks.files import sink_csv
from runweave.sinks.runlog import append_json
from runweave.sources.files import scan_csv_strings, scan_parquet, scan_report_tasks, scan_run_log, scan_sql_files
from runweave.sources.quoted import scan_csv_quoted
from runweave.sources.targets import register_target


def scan_parquet_filename(spark, sf_dir):
    orders = scan_parquet(spark, [f"{sf_dir}/orders.parquet"], filename=True)
    return orders.select("o_orderkey", "o_orderstatus", F.regexp_replace("filename", r"\Apart-.*", "orders.parquet").alias("filename"))


def scan_csv_strings_query(spark, sf_dir):
    path = new_run_dir(spark, "csv")
    sink_csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), path)
    return scan_csv_strings(spark, path)


def scan_csv_quoted_query(spark, sf_dir):
    """Notes with line breaks, quotes and commas, written to one file and read in byte ranges."""
    path = new_run_dir(spark, "quoted")
    note = F.expr("""concat(o_orderstatus, '\n said "', o_orderpriority, '",\n\n', o_custkey)""").alias("note")
    sink_csv(table(spark, sf_dir, "orders").select("o_orderkey", note, "o_orderstatus").coalesce(1), path)
    return scan_csv_quoted(spark, path)


def scan_target(spark, sf_dir):
    targets = {"WAREHOUSE": {"transport": "parquet", "path": sf_dir, "suffix": ".parquet", "tables": derived.TABLES}}
    names = register_target(spark, targets, "WAREHOUSE")["tables"]
    return spark.sql(" UNION ALL ".join(f"SELECT '{name}' AS table_name, count(*) AS n FROM {name}" for name in names))


def scan_provenance(spark, sf_dir):
    path = new_run_dir(spark, "runlog")
    append_json(derived.run_records(spark, sf_dir), path)
    return scan_run_log(spark, path)


def scan_report_tasks_query(spark, sf_dir):
    path = new_run_dir(spark, "reports")
    task = F.struct(
        F.col("p_name").alias("name"), F.col("p_type").alias("db_type"),
        (F.col("p_retailprice") / 1000.0).alias("execution_time_sec"), F.col("p_size").alias("parallel_degree"),
        F.struct(F.col("p_retailprice").alias("cpu_time_sec"), F.lit(0.5).alias("io_time_sec"), F.lit("CPU").alias("bottleneck")).alias("profile"),
    )
    # A summary document covers 20 neighbouring keys, so no document grows with the data.
    docs = (
        table(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 20").alias("run"))
        .agg(F.array_sort(F.collect_list(F.struct("p_partkey", task.alias("task")))).alias("_tasks"))
        .select(
            F.struct(F.concat(F.lit("run-"), F.col("run")).alias("timestamp"), F.lit("Oracle 19c").alias("db")).alias("meta"),
            F.col("_tasks.task").alias("tasks"),
        )
    )
    docs.write.json(path)
    return scan_report_tasks(spark, path, multi_line=False).select(
        "timestamp", "seq", "name", "db_type", "execution_time_sec", "parallel_degree", "cpu_time_sec", "io_time_sec", "bottleneck")


def scan_plan_docs(spark, sf_dir):
    docs = derived.plan_docs(spark, sf_dir).withColumn("root", parse_plan(F.col("plan")))
    return docs.select(
        "l_orderkey", "l_linenumber",
        execution_time(F.col("root")).alias("duration_ms"),
        F.col("root.Plan")["Node Type"].alias("root_node"),
        F.col("root.Plan.Plans")[0]["Node Type"].alias("child_node"),
    )


def scan_sql_corpus(spark, sf_dir):
    """Write the corpus as files of many lines, read the files whole, and count their lines per order status."""
    path = new_run_dir(spark, "corpus")
    line = F.concat(F.col("o_orderstatus"), F.lit("|"), F.translate("sql_text", "\n", " "))
    derived.corpus(spark, sf_dir).select(line.alias("value")).write.option("maxRecordsPerFile", 200_000).text(path)
    lines = scan_sql_files(spark, path).select("path", F.explode(F.split("sql_text", "\n")).alias("line"))
    return lines.where("line != ''").groupBy(F.left("line", F.lit(1)).alias("o_orderstatus")).agg(
        F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


QUERIES = {
    "scan_parquet_filename": scan_parquet_filename,
    "scan_csv_strings": scan_csv_strings_query,
    "scan_csv_quoted": scan_csv_quoted_query,
    "scan_target": scan_target,
    "scan_provenance": scan_provenance,
    "scan_report_tasks": scan_report_tasks_query,
    "scan_plan_docs": scan_plan_docs,
    "scan_sql_corpus": scan_sql_corpus,
}

ORACLE = {
    "scan_parquet_filename": "SELECT o_orderkey, o_orderstatus, 'orders.parquet' AS filename FROM orders",
    "scan_csv_strings": "SELECT CAST(o_orderkey AS varchar) AS o_orderkey, CAST(o_custkey AS varchar) AS o_custkey, "
                        "o_orderstatus, o_orderpriority FROM orders",
    "scan_csv_quoted": """
        SELECT CAST(o_orderkey AS varchar) AS o_orderkey, o_orderstatus,
               concat(o_orderstatus, chr(10), ' said "', o_orderpriority, '",', chr(10), chr(10), o_custkey) AS note FROM orders""",
    "scan_target": " UNION ALL ".join(f"SELECT '{name}' AS table_name, count(*) AS n FROM {name}" for name in derived.TABLES),
    "scan_provenance": derived.RUN_RECORDS_SQL,
    "scan_report_tasks": """
        SELECT concat('run-', p_partkey // 20) AS timestamp,
               CAST(row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) AS INT) AS seq,
               p_name AS name, p_type AS db_type, p_retailprice / 1000.0 AS execution_time_sec, p_size AS parallel_degree,
               p_retailprice AS cpu_time_sec, CAST(0.5 AS DOUBLE) AS io_time_sec, 'CPU' AS bottleneck
        FROM part""",
    "scan_plan_docs": """
        SELECT l_orderkey, l_linenumber, l_extendedprice AS duration_ms, 'Gather' AS root_node, 'Nested Loop' AS child_node
        FROM lineitem""",
    "scan_sql_corpus": f"""
        SELECT o_orderstatus, count(*) AS lines, CAST(sum(length(sql_text) + 2) AS BIGINT) AS chars
        FROM ({derived.CORPUS_SQL}) c GROUP BY o_orderstatus""",
}
