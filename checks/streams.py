"""Streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from checks.derived import TABLES, table
from runweave.session import new_run_dir
from runweave.streaming.requests import read_responses, request_lines, serve_requests as serve, write_classified

_LINE = """
    CASE o_orderkey % 5
      WHEN 0 THEN concat('{"id": ', o_orderkey, ', "sql_file": "a.sql", "target": "T", "output": "out/', o_custkey, '", "limit": 10}')
      WHEN 1 THEN concat('{"id": ', o_orderkey, ', "sql_file": "a.sql", "target": ""}')
      WHEN 2 THEN concat('not json ', o_orderkey)
      WHEN 3 THEN '   '
      ELSE concat('  {"id": ', o_orderkey, ', "cmd": "shutdown"}') END"""


def request_stream(spark, sf_dir):
    """Lines written as files, streamed and classified."""
    folder = new_run_dir(spark, "requests")
    table(spark, sf_dir, "orders").select(F.expr(_LINE).alias("value")).write.option("maxRecordsPerFile", 1_000_000).text(f"{folder}/in")
    write_classified(request_lines(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(
        F.coalesce("id", F.lit(-1)).alias("id"), "kind", "sql_file", "target", "output", F.coalesce("limit", F.lit(0)).alias("row_limit"), "error")


_SERVED = {
    1: "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey",
    2: "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 45",
    3: "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer",
}


def serve_requests(spark, sf_dir):
    """Requests over whole tables, answered from SQL files; one names an unknown target."""
    folder = new_run_dir(spark, "serve")
    targets = {"WAREHOUSE": {"transport": "parquet", "path": sf_dir, "suffix": ".parquet", "tables": TABLES}}
    requests = []
    for number, sql in _SERVED.items():
        spark.createDataFrame([(f"{sql} ;",)], "value string").coalesce(1).write.text(f"{folder}/sql/{number}")
        requests.append({"id": number, "sql_file": f"{folder}/sql/{number}", "target": "WAREHOUSE", "output": f"{folder}/csv/{number}"})
    requests.append({**requests[0], "id": 4, "target": "NOWHERE"})
    spark.createDataFrame([(json.dumps(r),) for r in requests], "value string").write.text(f"{folder}/in")
    serve(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", targets).awaitTermination()
    return read_responses(spark, f"{folder}/out")


QUERIES = {"request_stream": request_stream, "serve_requests": serve_requests}

ORACLE = {
    "request_stream": """
        SELECT CASE WHEN o_orderkey % 5 = 2 THEN -1 ELSE o_orderkey END AS id,
               CASE o_orderkey % 5 WHEN 0 THEN 'run' WHEN 4 THEN 'shutdown' ELSE 'error' END AS kind,
               CASE WHEN o_orderkey % 5 < 2 THEN 'a.sql' END AS sql_file,
               CASE o_orderkey % 5 WHEN 0 THEN 'T' WHEN 1 THEN '' END AS target,
               CASE WHEN o_orderkey % 5 = 0 THEN concat('out/', o_custkey) END AS output,
               CAST(CASE WHEN o_orderkey % 5 = 0 THEN 10 ELSE 0 END AS BIGINT) AS row_limit,
               CASE o_orderkey % 5 WHEN 1 THEN 'ERROR: request needs ''sql_file'', ''target'', and ''output'''
                    WHEN 2 THEN concat('ERROR: bad request JSON: not json ', o_orderkey) END AS error
        FROM orders WHERE o_orderkey % 5 <> 3""",
    "serve_requests": " UNION ALL ".join(
        [f"SELECT CAST({number} AS BIGINT) AS id, TRUE AS ok, count(*) AS rows, NULL AS error FROM ({sql}) q" for number, sql in _SERVED.items()]
        + ["SELECT 4, FALSE, 0, 'ERROR: Unknown target: ''NOWHERE''. Registered targets: [''WAREHOUSE'']'"]),
}
