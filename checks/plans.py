"""Plan roll-ups, engine statistics and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import derived
from checks.derived import table
from runweave.plans import explain, monitor, report


def plan_buffers(spark, sf_dir):
    return explain.plan_buffers(derived.plan_docs(spark, sf_dir)).drop("plan")


def plan_metrics(spark, sf_dir):
    return explain.plan_metrics(derived.plan_docs(spark, sf_dir)).drop("plan", "db_io_ms", "parallel_degree")


def _monitor(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey AS sql_id", "l_orderkey AS sql_exec_id", "l_suppkey AS sid", "l_linestatus AS status",
        "cast(round(l_extendedprice * 100) AS bigint) AS elapsed_time",
        "CASE WHEN l_returnflag <> 'N' THEN cast(l_quantity AS bigint) * 1000 END AS cpu_time",
        "cast(l_linenumber AS bigint) * 250 AS user_io_wait_time",
        "cast(l_quantity AS bigint) * 8192 AS physical_read_bytes",
        "CASE WHEN l_linenumber > 2 THEN l_linenumber END AS px_servers_allocated")


def sql_monitor_agg(spark, sf_dir):
    return monitor.sql_monitor_agg(_monitor(spark, sf_dir))


def session_stats(spark, sf_dir):
    """Sessions are parts; each supplier stands for a statistic, some of them named as the two that count."""
    values = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS sid", "l_suppkey AS statistic", "cast(l_quantity AS bigint) AS value")
    names = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS statistic",
        f"CASE WHEN s_acctbal > 6000 THEN '{monitor.CPU_STAT}' WHEN s_acctbal > 2000 THEN '{monitor.IO_STAT}' ELSE s_name END AS name")
    stat = lambda name: F.coalesce(F.try_element_at("stats", F.lit(name)), F.lit(-1))
    return monitor.session_stats(values, names).select(
        "sid", F.size("stats").alias("n"), stat(monitor.CPU_STAT).alias("cpu"), stat(monitor.IO_STAT).alias("io"))


def stat_delta(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("bigint").alias("value"))
    return monitor.stat_delta(lines.where("l_linestatus = 'F'"), lines.where("l_linestatus = 'O'"), ["l_suppkey", "l_returnflag"])


def step_deltas(spark, sf_dir):
    """Users are sessions: views are snapshots, some without one of the counters, purchases are steps of up to ten hours."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    snapshots = events.where("event_type = 'view'").select(
        F.col("user_id").alias("sid"), F.col("ts").alias("at"),
        F.map_filter(F.create_map(F.lit(monitor.CPU_STAT), F.expr("event_id * 3"), F.lit(monitor.IO_STAT), F.expr("if(event_id % 3 = 0, null, event_id % 1000)")),
                     lambda _, v: v.isNotNull()).alias("stats"))
    steps = events.where("event_type = 'purchase'").select(
        F.col("user_id").alias("sid"), "event_id", F.col("ts").alias("started"), F.expr("ts + make_dt_interval(0, 0, cast(event_id % 600 as int))").alias("ended"))
    return monitor.step_deltas(steps, snapshots).select("sid", "event_id", "db_cpu_ms", "db_io_ms")


def duration_backfill(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber",
        monitor.duration_backfill(F.nullif(F.col("l_discount"), F.lit(0.05)), F.col("l_quantity")).alias("duration_ms"))


def bottleneck(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber",
        monitor.bottleneck(
            F.col("l_tax"), F.col("l_discount"),
            F.when(F.col("l_returnflag") != "N", F.col("l_quantity").cast("bigint")), F.col("l_linenumber") * 5,
        ).alias("bottleneck"))


def report_rows(spark, sf_dir):
    return report.report_rows(derived.tasks(spark, sf_dir), "task_no")


def report_series(spark, sf_dir):
    """Series of 20 points, joined to text."""
    series = report.report_series(report.report_rows(derived.tasks(spark, sf_dir), "task_no"), points=20)
    joined = lambda name: F.array_join(F.transform(name, lambda v: F.round(v * 1000).cast("bigint").cast("string")), "|").alias(name)
    return series.select(
        "run_id", "part", F.array_join("names", "|").alias("names"), joined("durations"), joined("cpu_times"), joined("io_times"),
        F.array_join(F.transform("parallel_degrees", lambda v: v.cast("string")), "|").alias("parallel_degrees"))


QUERIES = {
    "plan_buffers": plan_buffers,
    "plan_metrics": plan_metrics,
    "sql_monitor_agg": sql_monitor_agg,
    "session_stats": session_stats,
    "stat_delta": stat_delta,
    "step_deltas": step_deltas,
    "duration_backfill": duration_backfill,
    "bottleneck": bottleneck,
    "report_rows": report_rows,
    "report_series": report_series,
}

REPORT_SQL = f"""
SELECT run_id, seq, task_name, db_type, coalesce(duration_ms, 0) / 1000.0 AS execution_time_sec,
       coalesce(parallel_degree, 1) AS parallel_degree, cpu_time_sec, io_time_sec,
       CASE WHEN cpu_time_sec + io_time_sec > 0 THEN CASE WHEN io_time_sec / (cpu_time_sec + io_time_sec) > 0.5 THEN 'I/O' ELSE 'CPU' END
            WHEN io_requests > 0 THEN CASE WHEN io_requests / (io_requests + cache_hits) > 0.5 THEN 'I/O' ELSE 'CPU' END
            ELSE 'Unknown' END AS bottleneck,
       concat('plans/', base, '.txt') AS plan_file,
       CASE WHEN rendered_sql IS NOT NULL THEN concat('rendered/', base, '.sql') END AS rendered_sql_file,
       plan_content, rendered_sql
FROM (SELECT *, coalesce(db_cpu_ms, 0) / 1000.0 AS cpu_time_sec, coalesce(db_io_ms, 0) / 1000.0 AS io_time_sec,
             concat(CASE WHEN seq < 10 THEN '0' ELSE '' END, seq, '_', regexp_replace(task_name, '[^\\p{{L}}\\p{{N}}._\\- ]', '', 'g')) AS base
      FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY task_no) AS seq FROM ({derived.TASKS_SQL}) t) n) b
"""

ORACLE = {
    "plan_buffers": f"SELECT * EXCLUDE (duration_ms) FROM ({derived.PLAN_TOTALS_SQL}) p",
    "plan_metrics": f"""
        SELECT l_orderkey, l_partkey, l_linenumber, duration_ms, read_blocks AS io_requests, hit_blocks AS cache_hits
        FROM ({derived.PLAN_TOTALS_SQL}) p""",
    "sql_monitor_agg": """
        SELECT l_partkey AS sql_id, l_orderkey AS sql_exec_id,
               sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 1000.0 AS duration_ms,
               coalesce(sum(CASE WHEN l_returnflag <> 'N' THEN CAST(l_quantity AS BIGINT) * 1000 END), 0) / 1000.0 AS db_cpu_ms,
               sum(CAST(l_linenumber AS BIGINT) * 250) / 1000.0 AS db_io_ms, CAST(0 AS BIGINT) AS io_requests,
               CAST(sum(CAST(l_quantity AS BIGINT) * 8192) AS BIGINT) AS io_bytes,
               coalesce(max(CASE WHEN l_linenumber > 2 THEN l_linenumber END), 0) AS parallel_degree, max(l_linestatus) AS status
        FROM lineitem GROUP BY l_partkey, l_orderkey""",
    "session_stats": """
        SELECT l_partkey AS sid,
               CAST((count(*) FILTER (WHERE s_acctbal > 6000) > 0)::INT + (count(*) FILTER (WHERE s_acctbal <= 6000) > 0)::INT AS INT) AS n,
               coalesce(max(CAST(l_quantity AS BIGINT)) FILTER (WHERE s_acctbal > 6000), -1) AS cpu,
               coalesce(max(CAST(l_quantity AS BIGINT)) FILTER (WHERE s_acctbal <= 6000), -1) AS io
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 2000 GROUP BY l_partkey""",
    "stat_delta": """
        SELECT l_suppkey, l_returnflag,
               CAST(10 * sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) WHEN l_linestatus = 'F' THEN -CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS delta_ms
        FROM lineitem WHERE l_linestatus IN ('O', 'F') GROUP BY l_suppkey, l_returnflag""",
    "step_deltas": """
        WITH snapshots AS (
          SELECT user_id AS sid, ts AS at, event_id * 3 AS cpu, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 1000 END AS io
          FROM events WHERE event_type = 'view'),
        steps AS (
          SELECT user_id AS sid, event_id, ts AS started, ts + to_minutes(CAST(event_id % 600 AS INT)) AS ended FROM events WHERE event_type = 'purchase')
        SELECT s.sid, s.event_id, 10 * (coalesce(e.cpu, 0) - coalesce(b.cpu, 0)) AS db_cpu_ms, 10 * (coalesce(e.io, 0) - coalesce(b.io, 0)) AS db_io_ms
        FROM steps s ASOF LEFT JOIN snapshots b ON s.sid = b.sid AND s.started >= b.at
        ASOF LEFT JOIN snapshots e ON s.sid = e.sid AND s.ended >= e.at""",
    "duration_backfill": """
        SELECT l_orderkey, l_partkey, l_linenumber,
               CASE WHEN l_discount = 0 OR l_discount = 0.05::DOUBLE THEN l_quantity * 1000 ELSE l_discount END AS duration_ms FROM lineitem""",
    "bottleneck": """
        SELECT l_orderkey, l_partkey, l_linenumber, CASE
          WHEN l_tax / 1000.0 + l_discount / 1000.0 > 0 THEN
            CASE WHEN (l_discount / 1000.0) / (l_tax / 1000.0 + l_discount / 1000.0) > 0.5 THEN 'I/O' ELSE 'CPU' END
          WHEN l_returnflag <> 'N' AND l_quantity > 0 THEN CASE WHEN l_quantity / (l_quantity + l_linenumber * 5) > 0.5 THEN 'I/O' ELSE 'CPU' END
          ELSE 'Unknown' END AS bottleneck FROM lineitem""",
    "report_rows": REPORT_SQL,
    "report_series": f"""
        SELECT run_id, (seq - 1) // 20 AS part, string_agg(task_name, '|' ORDER BY seq) AS names,
               string_agg(CAST(CAST(round(execution_time_sec * 1000) AS BIGINT) AS varchar), '|' ORDER BY seq) AS durations,
               string_agg(CAST(CAST(round(cpu_time_sec * 1000) AS BIGINT) AS varchar), '|' ORDER BY seq) AS cpu_times,
               string_agg(CAST(CAST(round(io_time_sec * 1000) AS BIGINT) AS varchar), '|' ORDER BY seq) AS io_times,
               string_agg(CAST(parallel_degree AS varchar), '|' ORDER BY seq) AS parallel_degrees
        FROM ({REPORT_SQL}) r GROUP BY run_id, (seq - 1) // 20""",
}
