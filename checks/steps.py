"""Filters, lookups, validation and grouping over step tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import derived
from checks.derived import table
from checks.running import RUNS_SQL
from runweave.operators import grouping, jobs, steps as step_ops
from runweave.session import new_run_dir
from runweave.streaming import jobs as live


def enabled_filter(spark, sf_dir):
    return step_ops.enabled_filter(derived.steps(spark, sf_dir)).select("manifest", "seq", "name", "type")


def resolve_sql_id(spark, sf_dir):
    return step_ops.resolve_sql_ids(
        derived.steps(spark, sf_dir).select("manifest", "seq", "file", "sql_id"), derived.catalog(spark, sf_dir))


def unresolved_sql_id(spark, sf_dir):
    return step_ops.unresolved_sql_ids(
        derived.steps(spark, sf_dir).select("manifest", "seq", "sql_id"), derived.catalog(spark, sf_dir))


def catalog_with_flaws(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(
        "CASE WHEN p_size > 3 THEN concat(p_brand, '_', p_type, '_', p_size) END AS sql_id",
        "CASE WHEN p_retailprice > 950 THEN concat('sql/', p_partkey, '.sql') END AS file")


def validate_catalog(spark, sf_dir):
    return step_ops.validate_catalog(catalog_with_flaws(spark, sf_dir))


def raw_steps(spark, sf_dir):
    """Raw step maps that break one rule or several, depending on the event."""
    raw = F.expr("""
        map_filter(map(
          'name', CASE WHEN value > 1 THEN concat('step_', event_id) END,
          'type', CASE WHEN event_type = 'error' THEN 'selectish' WHEN value <= 29 THEN 'sql' END,
          'file', CASE WHEN event_type IN ('view', 'click') THEN 'a.sql' END,
          'sql_id', CASE WHEN event_type IN ('click', 'signup') THEN 'a' END,
          'joined_glue', CASE WHEN value < 3 THEN 'weird' ELSE 'raw' END,
          'cleanup_mode', CASE WHEN event_type = 'purchase' AND value < 5 THEN 'explode' ELSE 'drop' END,
          'fielo', CASE WHEN value > 20 THEN 'x' END,
          'extra', CASE WHEN value > 24 THEN 'y' END,
          'transaction_group', CASE WHEN value > 12 THEN event_type WHEN value > 6 THEN '0' ELSE '' END,
          'enabled', CASE WHEN value > 18 THEN 'false' WHEN value > 9 THEN 'true' END,
          'params', CASE WHEN event_type = 'view' THEN props END), (k, v) -> v IS NOT NULL) AS raw""")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("manifest"), F.col("event_id").alias("seq"), raw)


def validate_steps(spark, sf_dir):
    return step_ops.validate_steps(raw_steps(spark, sf_dir))


def typed_steps(spark, sf_dir):
    typed = step_ops.typed_steps(raw_steps(spark, sf_dir))
    return typed.select(
        "manifest", "seq", "name", "type", "enabled", "file", "sql_id", "transaction_group", "joined_glue", "cleanup_mode", "notify",
        F.coalesce(F.try_element_at("params", F.lit("k")), F.lit("none")).alias("param_k"))


def _files(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "concat('scripts/', lower(p_type), '/', p_partkey, ' - ', p_name, '.sql') AS file")


def resolve_variant(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("name", F.expr("concat(p_partkey, ' - ', p_name, '.sql')")) \
        .withColumn("under", F.expr("replace(replace(name, ' - ', '_'), ' ', '_')"))
    at = lambda condition, folder, name: parts.where(condition).select(F.concat(F.lit(folder), F.col(name)).alias("path"))
    index = (
        at("p_size > 40", "postgres-pipeline/", "name")
        .unionAll(at("p_size BETWEEN 25 AND 42", "postgres-pipeline/", "under"))
        .unionAll(at("p_size BETWEEN 15 AND 30", "postgres-pipeline/schemas/", "name"))
        .unionAll(at("p_size BETWEEN 5 AND 20", "postgres-pipeline/schemas/", "under"))
        .unionAll(at("p_size < 8", "duckdb-pipeline/", "name"))
    )
    return step_ops.resolve_variants(_files(spark, sf_dir), index, "postgresql+psycopg2")


def consecutive_groups(spark, sf_dir):
    return grouping.consecutive_groups(derived.steps(spark, sf_dir)).select("manifest", "seq", "item_no", "item_kind")


def group_durations(spark, sf_dir):
    runs = grouping.group_durations(derived.steps(spark, sf_dir))
    line = grouping.summary_line(*[F.col(c) for c in ("task_no", "transaction_group", "first_step", "steps")], F.lit(0.0))
    return runs.withColumn("seconds", F.round("seconds", 3)).withColumn("line", F.substring_index(line, " - time taken", 1))


def even_split(spark, sf_dir):
    """Total price of an order shared by its line items."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    walls = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("wall"))
    return grouping.even_split(lines, walls, ["l_orderkey"])


def alert_filter(spark, sf_dir):
    """Single steps and fused groups that raise an alert, in one table."""
    steps = derived.steps(spark, sf_dir)
    singles = grouping.alerting_steps(steps).select(
        F.lit("step").alias("kind"), "manifest", "seq", F.lit(1).cast("bigint").alias("steps"), F.round("duration", 3).alias("seconds"))
    groups = grouping.alerting_groups(steps).select(
        F.lit("joined").alias("kind"), "manifest", F.col("run_no").alias("seq"), "steps", F.round("seconds", 3).alias("seconds"))
    return singles.unionByName(groups)


def mixed_groups(spark, sf_dir):
    steps = derived.steps(spark, sf_dir).withColumn("joined_group", F.expr("CASE WHEN type IN ('psql', 'sql') THEN 'g' END"))
    return grouping.mixed_groups(steps).select("manifest", "run_no", "joined_group", F.array_join("types", ",").alias("types"))


def _step_log(spark, sf_dir):
    """Every step is logged as started; costly steps are done later, and some of these fail again."""
    events = table(spark, sf_dir, "events")
    entry = lambda rows, ts, status: rows.select(
        F.col("user_id").alias("manifest"), F.col("event_id").alias("seq"), F.lit(ts).alias("ts"), F.lit(status).alias("status"))
    return (
        entry(events, "2024-01-01T00:00:00", "started")
        .unionAll(entry(events.where("value > 5"), "2024-01-01T01:00:00", "done"))
        .unionAll(entry(events.where("value > 12"), "2024-01-01T02:00:00", "error"))
        .unionAll(entry(events.where("value > 18"), "2024-01-01T03:00:00", "done"))
    )


def resume_pending(spark, sf_dir):
    steps = derived.steps(spark, sf_dir).select("manifest", "seq", "name", "enabled")
    return jobs.resume_pending(steps, _step_log(spark, sf_dir))


def job_status(spark, sf_dir):
    return jobs.job_status(derived.jobs(spark, sf_dir), derived.log_lines(spark, sf_dir))


def job_status_newest(spark, sf_dir):
    """The report of the five newest jobs, with the closing log lines of the newest one."""
    all_jobs, lines = derived.jobs(spark, sf_dir), derived.log_lines(spark, sf_dir)
    status = jobs.job_status(all_jobs, lines, newest=5).select("job_id", F.lit(-1).cast("bigint").alias("line_no"), F.col("status").alias("line"))
    return status.unionByName(jobs.latest_log_lines(all_jobs, lines))


def job_status_live(spark, sf_dir):
    """The log lines and the ends of the jobs as a stream of files, followed in several micro-batches."""
    folder = new_run_dir(spark, "live")
    ended = derived.jobs(spark, sf_dir).where("not alive").selectExpr("job_id", "timestamp_seconds(1700086400) AS ts", "CAST(NULL AS string) AS line", "true AS ended")
    lines = derived.log_lines(spark, sf_dir).selectExpr("job_id", "timestamp_seconds(1700000000 + line_no) AS ts", "line", "false AS ended")
    lines.unionByName(ended).repartition(4, F.xxhash64("job_id", "ts")).write.parquet(f"{folder}/in")
    changes = live.follow_jobs(live.job_events(spark, f"{folder}/in", max_files=2), late="2 days")
    live.write_changes(changes, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return live.current_status(spark, f"{folder}/out")


QUERIES = {
    "enabled_filter": enabled_filter,
    "resolve_sql_id": resolve_sql_id,
    "unresolved_sql_id": unresolved_sql_id,
    "validate_catalog": validate_catalog,
    "validate_steps": validate_steps,
    "typed_steps": typed_steps,
    "resolve_variant": resolve_variant,
    "consecutive_groups": consecutive_groups,
    "group_durations": group_durations,
    "even_split": even_split,
    "alert_filter": alert_filter,
    "mixed_groups": mixed_groups,
    "resume_pending": resume_pending,
    "job_status": job_status,
    "job_status_newest": job_status_newest,
    "job_status_live": job_status_live,
}

_STEPS = f"({derived.STEPS_SQL}) s"
_WITH_STEPS = f"WITH steps AS ({derived.STEPS_SQL})"

_RAW_SQL = """
SELECT user_id AS manifest, event_id AS seq,
       CASE WHEN value > 1 THEN concat('step_', event_id) END AS name,
       CASE WHEN event_type = 'error' THEN 'selectish' WHEN value <= 29 THEN 'sql' END AS type,
       CASE WHEN event_type IN ('view', 'click') THEN 'a.sql' END AS file,
       CASE WHEN event_type IN ('click', 'signup') THEN 'a' END AS sql_id,
       CASE WHEN value < 3 THEN 'weird' ELSE 'raw' END AS joined_glue,
       CASE WHEN event_type = 'purchase' AND value < 5 THEN 'explode' ELSE 'drop' END AS cleanup_mode,
       CASE WHEN value > 24 THEN 'extra, fielo' WHEN value > 20 THEN 'fielo' END AS unknown,
       CASE WHEN value > 12 THEN event_type END AS transaction_group,
       CASE WHEN value > 18 THEN FALSE ELSE TRUE END AS enabled,
       CASE WHEN event_type = 'view' THEN json_extract_string(props, '$.k') END AS param_k
FROM events
"""

ORACLE = {
    "enabled_filter": f"SELECT manifest, seq, name, type FROM {_STEPS} WHERE enabled",
    "resolve_sql_id": f"""
        SELECT manifest, seq, coalesce(c.file, s.file) AS file, CASE WHEN c.file IS NULL THEN s.sql_id END AS sql_id
        FROM {_STEPS} LEFT JOIN ({derived.CATALOG_SQL}) c ON s.sql_id = c.sql_id""",
    "unresolved_sql_id": f"""
        SELECT manifest, seq, sql_id FROM {_STEPS}
        WHERE sql_id IS NOT NULL AND sql_id NOT IN (SELECT sql_id FROM ({derived.CATALOG_SQL}) c)""",
    "validate_catalog": """
        WITH entries AS (
          SELECT CASE WHEN p_size > 3 THEN concat(p_brand, '_', p_type, '_', p_size) END AS sql_id, p_retailprice > 950 AS has_file FROM part)
        SELECT 'missing id' AS problem, NULL AS sql_id, count(*) AS entries FROM entries WHERE sql_id IS NULL HAVING count(*) > 0
        UNION ALL
        SELECT 'missing file', sql_id, count(*) FROM entries WHERE sql_id IS NOT NULL AND NOT has_file GROUP BY sql_id
        UNION ALL
        SELECT 'duplicate id', sql_id, count(*) FROM entries WHERE sql_id IS NOT NULL AND has_file GROUP BY sql_id HAVING count(*) > 1""",
    "validate_steps": f"""
        WITH raw AS ({_RAW_SQL}),
        broken AS (
          SELECT manifest, seq, 1 AS rule, concat('unknown keys ', unknown) AS problem FROM raw WHERE unknown IS NOT NULL
          UNION ALL SELECT manifest, seq, 2, 'missing required name' FROM raw WHERE name IS NULL
          UNION ALL SELECT manifest, seq, 3, 'missing required type' FROM raw WHERE type IS NULL
          UNION ALL SELECT manifest, seq, 4, 'type selectish is not one of bulk_insert, manifest, plsql, psql, python, sql' FROM raw WHERE type = 'selectish'
          UNION ALL SELECT manifest, seq, 5, 'set either file or sql_id, not both' FROM raw WHERE file IS NOT NULL AND sql_id IS NOT NULL
          UNION ALL SELECT manifest, seq, 6, 'joined_glue must be one of raw, statement, got weird' FROM raw WHERE joined_glue = 'weird'
          UNION ALL SELECT manifest, seq, 7, 'cleanup_mode must be one of drop, truncate, got explode' FROM raw WHERE cleanup_mode = 'explode')
        SELECT manifest, seq, CAST(row_number() OVER (PARTITION BY seq ORDER BY rule) AS INT) AS rule_no, problem FROM broken""",
    "typed_steps": f"""
        SELECT manifest, seq, name, type, enabled, file, sql_id, transaction_group, joined_glue, cleanup_mode,
               FALSE AS notify, coalesce(param_k, 'none') AS param_k FROM ({_RAW_SQL}) r""",
    "resolve_variant": """
        WITH files AS (
          SELECT p_partkey, p_size, concat('scripts/', lower(p_type), '/', p_partkey, ' - ', p_name, '.sql') AS file,
                 concat(p_partkey, ' - ', p_name, '.sql') AS name FROM part),
        named AS (SELECT *, replace(replace(name, ' - ', '_'), ' ', '_') AS under FROM files)
        SELECT p_partkey, file, CASE
          WHEN p_size > 40 THEN concat('postgres-pipeline/', name)
          WHEN p_size >= 25 THEN concat('postgres-pipeline/', under)
          WHEN p_size >= 15 THEN concat('postgres-pipeline/schemas/', name)
          WHEN p_size >= 5 THEN concat('postgres-pipeline/schemas/', under)
          ELSE file END AS resolved FROM named""",
    "consecutive_groups": f"""
        WITH steps AS (
          SELECT *, CASE WHEN joined_group IS NOT NULL THEN concat('J', joined_group)
                         WHEN transaction_group IS NOT NULL THEN concat('G', transaction_group) END AS label FROM {_STEPS}),
        {RUNS_SQL.format(label="label", steps="steps")}
        SELECT manifest, seq, run_no AS item_no,
               CASE left(label, 1) WHEN 'J' THEN 'joined' WHEN 'G' THEN 'group' ELSE 'step' END AS item_kind FROM runs""",
    "group_durations": f"""
        {_WITH_STEPS}, {RUNS_SQL.format(label="transaction_group", steps="steps")},
        tasks AS (
          SELECT manifest, run_no AS task_no, max(transaction_group) AS transaction_group, arg_min(name, seq) AS first_step,
                 count(*) AS steps, round(sum(duration), 3) AS seconds FROM runs GROUP BY manifest, run_no)
        SELECT *, concat('Task ', task_no, ' - ', CASE WHEN transaction_group IS NULL THEN first_step
                         ELSE concat('Group ', transaction_group, ' (', steps, ' steps)') END) AS line FROM tasks""",
    "even_split": """
        SELECT l_orderkey, l_partkey, l_linenumber, o_totalprice / count(*) OVER (PARTITION BY l_orderkey) AS duration,
               count(*) OVER (PARTITION BY l_orderkey) AS group_steps
        FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""",
    "alert_filter": f"""
        {_WITH_STEPS}, {RUNS_SQL.format(label="joined_group", steps="steps")}
        SELECT 'step' AS kind, manifest, seq, CAST(1 AS BIGINT) AS steps, round(duration, 3) AS seconds
        FROM steps WHERE joined_group IS NULL AND (notify OR duration > 5)
        UNION ALL
        SELECT 'joined', manifest, run_no, count(*), round(sum(duration), 3) FROM runs
        WHERE joined_group IS NOT NULL GROUP BY manifest, run_no HAVING sum(duration) > 5""",
    "mixed_groups": f"""
        WITH steps AS (SELECT manifest, seq, type, CASE WHEN type IN ('psql', 'sql') THEN 'g' END AS label FROM {_STEPS}),
        {RUNS_SQL.format(label="label", steps="steps")}
        SELECT manifest, run_no, 'g' AS joined_group, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM runs
        WHERE label IS NOT NULL GROUP BY manifest, run_no HAVING count(*) FILTER (WHERE type <> 'psql') > 0""",
    "resume_pending": """
        SELECT user_id AS manifest, event_id AS seq, concat('step_', event_id) AS name, TRUE AS enabled FROM events
        WHERE value >= 2 AND (value <= 5 OR (value > 12 AND value <= 18))""",
    "job_status": f"""
        SELECT j.*, CASE WHEN alive THEN 'RUNNING' WHEN failed THEN 'FAILED' ELSE 'FINISHED' END AS status
        FROM ({derived.JOBS_SQL}) j LEFT JOIN (
          SELECT job_id AS id, bool_or(contains(line, 'CRITICAL') OR contains(line, 'failed after')) AS failed
          FROM ({derived.LOG_LINES_SQL}) l GROUP BY job_id) f ON j.job_id = f.id""",
    "job_status_live": f"""
        SELECT job_id, CASE WHEN alive THEN 'RUNNING' WHEN failed THEN 'FAILED' ELSE 'FINISHED' END AS status
        FROM ({derived.JOBS_SQL}) j LEFT JOIN (
          SELECT job_id AS id, bool_or(contains(line, 'CRITICAL') OR contains(line, 'failed after')) AS failed
          FROM ({derived.LOG_LINES_SQL}) l GROUP BY job_id) f ON j.job_id = f.id""",
    "job_status_newest": f"""
        WITH newest AS (SELECT * FROM ({derived.JOBS_SQL}) j ORDER BY started DESC LIMIT 5), lines AS ({derived.LOG_LINES_SQL})
        SELECT job_id, CAST(-1 AS BIGINT) AS line_no, CASE WHEN alive THEN 'RUNNING'
               WHEN EXISTS (SELECT 1 FROM lines WHERE lines.job_id = newest.job_id AND (contains(line, 'CRITICAL') OR contains(line, 'failed after')))
               THEN 'FAILED' ELSE 'FINISHED' END AS line FROM newest
        UNION ALL
        SELECT * FROM (SELECT job_id, line_no, left(line, 120) FROM lines
                       WHERE job_id = (SELECT job_id FROM newest ORDER BY started DESC LIMIT 1) ORDER BY line_no DESC LIMIT 5)""",
}
