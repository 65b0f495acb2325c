"""Inputs derived from the test tables: the same formula once for Spark and once as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.session import spread_scan

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- steps: one per event, one manifest per user ------------------------------------------------

_STEP_COLUMNS = {
    "manifest": "user_id",
    "seq": "event_id",
    "name": "concat('step_', event_id)",
    "type": "CASE event_type WHEN 'view' THEN 'psql' WHEN 'click' THEN 'sql' WHEN 'purchase' THEN 'bulk_insert' "
            "WHEN 'signup' THEN 'plsql' ELSE 'python' END",
    "enabled": "value >= 2",
    "description": "CASE WHEN value > 10 THEN concat(event_type, ' load') END",
    "file": "CASE WHEN event_type IN ('view', 'click', 'error') THEN concat('sql/', event_type, '.sql') END",
    "sql_id": "CASE WHEN event_type = 'purchase' AND value > 15 THEN 'lost' "
              "WHEN event_type IN ('purchase', 'signup') THEN concat('part_', {k}) END",
    "transaction_group": "CASE WHEN event_type <> 'error' THEN event_type END",
    "joined_group": "CASE WHEN event_type = 'view' THEN 'view' END",
    "joined_glue": "CASE WHEN event_type = 'view' AND value > 8 THEN 'raw' END",
    "cleanup_target": "CASE WHEN event_type = 'error' AND value > 5 THEN 'stage_error' END",
    "cleanup_mode": "CASE WHEN value > 9 THEN 'truncate' ELSE 'drop' END",
    "notify": "value > 25",
    "duration": "value / 10",
    "sql_text": "concat('SELECT ', event_id, ' AS k ;', {newline})",
}


def _step_select(**dialect: str) -> list[str]:
    return [f"{text.format(**dialect)} AS {name}" for name, text in _STEP_COLUMNS.items()]


STEPS_SQL = "SELECT " + ",\n  ".join(
    _step_select(k="json_extract_string(props, '$.k')", newline="chr(10)")) + "\nFROM events"


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_step_select(k="get_json_object(props, '$.k')", newline="'\\n'"))


# -- catalog: one entry per part ----------------------------------------------------------------

CATALOG_SQL = (
    "SELECT concat('part_', p_partkey) AS sql_id, "
    "concat('sql/', lower(p_type), '/', p_partkey, '.sql') AS file FROM part"
)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "concat('part_', p_partkey) AS sql_id", "concat('sql/', lower(p_type), '/', p_partkey, '.sql') AS file")


# -- SQL corpus: one text per order -------------------------------------------------------------

_CORPUS_TEXTS = (
    "concat('SELECT count(*) AS n FROM orders WHERE o_orderkey = ', o_orderkey)",
    "concat('DROP TABLE stage_', o_orderkey, ';')",
    "concat('-- refresh ', o_orderkey, {nl}, 'CREATE TABLE stage (a INT);', {nl})",
    "concat('INSERT INTO t VALUES (', o_orderkey, '); INSERT INTO t VALUES (2) ;; ')",
    "concat('  SELECT * FROM orders WHERE s = {{{{ status }}}} AND p = {{{{priority}}}} LIMIT {{{{ cap }}}} -- ', o_orderkey, {nl})",
    "concat('SELECT ', o_orderkey, '; DROP TABLE t')",
    "concat('SELECT *', {nl}, 'FROM t', {nl}, 'WHERE a = ', o_orderkey, {nl}, '  update t SET b = 1')",
    "concat('WITH x AS (SELECT ', o_orderkey, ' AS k) SELECT * FROM x ;')",
)


def _corpus_text(nl: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {text.format(nl=nl)}" for i, text in enumerate(_CORPUS_TEXTS))
    return f"CASE o_orderkey % 8 {cases} END AS sql_text"


CORPUS_SQL = f"SELECT o_orderkey, o_orderstatus, o_orderpriority, {_corpus_text('chr(10)')} FROM orders"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _corpus_text("'\\n'")
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderstatus", "o_orderpriority", text)


# -- plan documents: one per line item, nested as deep as its line number -----------------------


def plan_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Gather above `l_linenumber` nested loops, each beside a scan, above one more scan."""
    inner = F.expr("""
        aggregate(sequence(1, l_linenumber),
          concat('{"Node Type": "Seq Scan", "Temp Read Blocks": ', cast(l_quantity AS bigint), '}'),
          (below, i) -> concat(
            '{"Node Type": "Nested Loop", "Shared Read Blocks": ', i, ', "Local Hit Blocks": 1, "I/O Read Time": 0.25, ',
            '"Workers": [{"Shared Read Blocks": 1000}], "Plans": [', below,
            ', {"Node Type": "Index Scan", "Shared Hit Blocks": ', i, '}]}'))
    """)
    doc = F.concat(
        F.lit('[{"Plan": {"Node Type": "Gather", "Workers Launched": '), F.col("l_linenumber"),
        F.lit(', "Plans": ['), inner, F.lit(']}, "Execution Time": '), F.col("l_extendedprice").cast("decimal(18,2)"), F.lit("}]"),
    )
    lines = spread_scan(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice"))
    return lines.select("l_orderkey", "l_partkey", "l_linenumber", doc.alias("plan"))


PLAN_TOTALS_SQL = """
SELECT l_orderkey, l_partkey, l_linenumber,
       CAST(l_linenumber * (l_linenumber + 1) // 2 + CAST(l_quantity AS BIGINT) AS BIGINT) AS read_blocks,
       CAST(l_linenumber * (l_linenumber + 1) // 2 + l_linenumber AS BIGINT) AS hit_blocks,
       CAST(l_linenumber * 0.25 AS DOUBLE) AS db_io_ms,
       l_linenumber AS parallel_degree,
       l_extendedprice AS duration_ms
FROM lineitem
"""

# -- report tasks: one per part, one run per brand ----------------------------------------------

_TASK_COLUMNS = {
    "run_id": "p_brand",
    "task_no": "p_partkey",
    "task_name": "concat(p_name, ' / ', p_type, ' #', p_partkey)",
    "db_type": "CASE WHEN p_size > 25 THEN 'ORACLE' ELSE 'POSTGRES' END",
    "duration_ms": "p_retailprice",
    "db_cpu_ms": "CASE WHEN p_size > 25 THEN p_retailprice END",
    "db_io_ms": "CASE WHEN p_size > 25 THEN p_size * 30.0E0 END",
    "io_requests": "CASE WHEN p_size <= 25 THEN CAST(p_size AS bigint) END",
    "cache_hits": "CASE WHEN p_size <= 25 THEN CAST(12 AS bigint) END",
    "parallel_degree": "CASE WHEN p_size > 10 THEN p_size END",
    "plan_content": "concat('plan of ', p_partkey)",
    "rendered_sql": "CASE WHEN p_size > 5 THEN concat('SELECT ', p_partkey) END",
}
TASKS_SQL = "SELECT " + ", ".join(f"{text} AS {name}" for name, text in _TASK_COLUMNS.items()) + " FROM part"


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*[f"{text} AS {name}" for name, text in _TASK_COLUMNS.items()])


# -- jobs and logs: one job per conversation, one line per turn ---------------------------------

LOG_LINES_SQL = """
SELECT conv_id AS job_id, turn AS line_no,
       CASE WHEN conv_id % 7 = 0 AND role = 'assistant' THEN concat('CRITICAL ', replace(text, chr(10), ' '))
            WHEN conv_id % 11 = 0 AND turn = 0 THEN 'Step failed after 3 retries'
            ELSE replace(text, chr(10), ' ') END AS line
FROM conversations
"""
JOBS_SQL = """
SELECT conv_id AS job_id, concat('run-', lpad(CAST(conv_id AS varchar), 12, '0')) AS started, conv_id % 5 = 0 AS alive
FROM conversations WHERE turn = 0
"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id AS job_id", "turn AS line_no",
        """CASE WHEN conv_id % 7 = 0 AND role = 'assistant' THEN concat('CRITICAL ', replace(text, '\\n', ' '))
                WHEN conv_id % 11 = 0 AND turn = 0 THEN 'Step failed after 3 retries'
                ELSE replace(text, '\\n', ' ') END AS line""",
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("turn = 0").selectExpr(
        "conv_id AS job_id", "concat('run-', lpad(cast(conv_id AS string), 12, '0')) AS started", "conv_id % 5 = 0 AS alive")


# -- run records: one per order -----------------------------------------------------------------

RUN_RECORDS_SQL = """
SELECT strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS ts, o_orderpriority AS fetch, 'parquet' AS transport,
       substring(sha256(CAST(o_orderkey AS varchar)), 1, 16) AS sql_hash,
       CAST(floor(o_totalprice) AS BIGINT) AS elapsed_ms, o_custkey AS rows,
       CASE WHEN o_orderstatus = 'F' THEN 'error' ELSE 'ok' END AS status,
       CASE WHEN o_orderstatus = 'F' THEN concat('connection refused: ', o_orderkey) END AS error
FROM orders
"""


def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") AS ts", "o_orderpriority AS fetch", "'parquet' AS transport",
        "substring(sha2(cast(o_orderkey AS string), 256), 1, 16) AS sql_hash",
        "cast(floor(o_totalprice) AS bigint) AS elapsed_ms", "o_custkey AS rows",
        "CASE WHEN o_orderstatus = 'F' THEN 'error' ELSE 'ok' END AS status",
        "CASE WHEN o_orderstatus = 'F' THEN concat('connection refused: ', o_orderkey) END AS error",
    )
