import json
import random

import pytest
from pyspark.sql import functions as F

from runweave.plans import explain, monitor, report

PLAN = [{"Plan": {"Node Type": "Gather", "Workers Launched": 2, "Shared Read Blocks": 10, "Shared Hit Blocks": 50,
                  "Plans": [{"Node Type": "Seq Scan", "Shared Read Blocks": 5}]}, "Execution Time": 123.45}]
NAMES = ("duration_ms", "io_requests", "cache_hits", "db_io_ms", "parallel_degree")


def walk(doc):
    """The roll-up as a plain recursion."""
    total = {"read": 0, "hit": 0, "io": 0.0, "degree": None}

    def visit(node):
        total["read"] += sum(node.get(k, 0) for k in explain.READ_COUNTERS)
        total["hit"] += sum(node.get(k, 0) for k in explain.HIT_COUNTERS)
        total["io"] += sum(node.get(k, 0) for k in explain.IO_TIMERS)
        if node.get("Node Type") == "Gather":
            total["degree"] = max(total["degree"] or 0, node.get("Workers Launched", 0))
        for child in node.get("Plans", []):
            visit(child)

    visit(doc[0].get("Plan", {}))
    return doc[0].get("Execution Time", 0.0), total["read"], total["hit"], total["io"], total["degree"]


def random_plan(rng, depth):
    node = {"Node Type": rng.choice(["Gather", "Gather Merge", "Seq Scan", "say \"Plans\""]), "Workers": [{"Shared Read Blocks": 99}]}
    for name in explain.READ_COUNTERS + explain.HIT_COUNTERS + ("Workers Launched",):
        if rng.random() < 0.5:
            node[name] = rng.randrange(100)
    if rng.random() < 0.3:
        node["I/O Read Time"] = 0.5
    if depth:
        node["Plans"] = [random_plan(rng, depth - 1)] + [random_plan(rng, rng.randrange(min(depth, 3))) for _ in range(rng.randrange(3))]
    return node


def metrics(spark, docs, parsed=False):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, plan string")
    if parsed:
        df = df.withColumn("plan", F.try_parse_json("plan"))
    return [tuple(r[n] for n in NAMES) for r in explain.plan_metrics(df).orderBy("i").collect()]


@pytest.mark.parametrize("parsed", [False, True])
def test_known_plan(spark, parsed):
    assert metrics(spark, [json.dumps(PLAN)], parsed) == [(123.45, 15, 50, 0.0, 2)]


@pytest.mark.parametrize("parsed", [False, True])
def test_plans_of_any_depth(spark, parsed):
    rng = random.Random(1)
    docs = [[{"Plan": random_plan(rng, depth), "Execution Time": 1.5}] for depth in (0, 1, 3, 14, 15, 16, 17, 40, 120)]
    assert metrics(spark, [json.dumps(d) for d in docs], parsed) == [walk(d) for d in docs]


def test_escaped_keys_and_other_documents(spark):
    escaped = json.dumps(PLAN).replace('"Plans"', '"Pl\\u0061ns"')
    none = (None,) * 5
    assert metrics(spark, [escaped, "nope", '{"Plan": {}}', "[]", "[{}]", "[1]"]) == [
        (123.45, 15, 50, 0.0, 2), none, none, none, (0.0, 0, 0, 0.0, None), none]


def test_monitor(spark):
    rows = [("q", 1, 7, "DONE", 1000, 500, None, 10, 2), ("q", 1, 7, "EXECUTING", 500, None, None, 5, 4), ("q", 2, 8, "DONE", 1, 1, 1, None, None)]
    df = spark.createDataFrame(rows, "sql_id string, sql_exec_id bigint, sid bigint, status string, elapsed_time bigint, cpu_time bigint, "
                                     "user_io_wait_time bigint, physical_read_bytes bigint, px_servers_allocated int")
    got = {r.sql_exec_id: r for r in monitor.sql_monitor_agg(df).collect()}
    assert (got[1].duration_ms, got[1].db_cpu_ms, got[1].db_io_ms, got[1].io_bytes, got[1].parallel_degree, got[1].status) == (1.5, 0.5, 0.0, 15, 4, "EXECUTING")
    assert (got[2].io_bytes, got[2].parallel_degree) == (0, 0)
    assert [r.sql_exec_id for r in monitor.sql_monitor_agg(df, sql_id="q", sid=8).collect()] == [2]


def test_session_stats_and_delta(spark):
    values = spark.createDataFrame([(1, 10, 100), (1, 11, 5), (1, 12, 9), (2, 12, 1), (3, 11, 8)], "sid int, statistic int, value bigint")
    names = spark.createDataFrame([(10, monitor.CPU_STAT), (11, monitor.IO_STAT), (12, "other")], "statistic int, name string")
    assert {r.sid: r.stats for r in monitor.session_stats(values, names).collect()} == {
        1: {monitor.CPU_STAT: 100, monitor.IO_STAT: 5}, 3: {monitor.IO_STAT: 8}}
    before = spark.createDataFrame([("cpu", 100), ("gone", 7)], "name string, value bigint")
    after = spark.createDataFrame([("cpu", 130), ("io", 4)], "name string, value bigint")
    assert {r.name: r.delta_ms for r in monitor.stat_delta(before, after, ["name"]).collect()} == {"cpu": 300, "gone": -70, "io": 40}


@pytest.mark.parametrize("cpu, io, reads, hits, expected", [
    (1000.0, 200.0, None, None, "CPU"), (200.0, 1000.0, None, None, "I/O"), (5.0, 5.0, None, None, "CPU"),
    (0.0, 0.0, 15000, 200, "I/O"), (None, None, 10, 10, "CPU"), (None, None, 10, None, "I/O"),
    (None, None, 10, -1, "Unknown"), (None, None, 0, 10, "Unknown"), (None, None, None, None, "Unknown"),
])
def test_bottleneck(spark, cpu, io, reads, hits, expected):
    df = spark.createDataFrame([(cpu, io, reads, hits)], "c double, i double, r bigint, h bigint")
    assert df.select(monitor.bottleneck(F.col("c"), F.col("i"), F.col("r"), F.col("h"))).first()[0] == expected


def test_duration_backfill(spark):
    df = spark.createDataFrame([(0.0, 2.0), (None, 3.0), (7.0, 9.0)], "d double, w double")
    assert [r[0] for r in df.select(monitor.duration_backfill(F.col("d"), F.col("w"))).collect()] == [2000.0, 3000.0, 7.0]


def test_report(spark):
    rows = [("r", 1, "Test CPU Task", 1500.0, 1000.0, 200.0, 2, None), ("r", 5, "a/b: çé #1", None, None, None, None, "SELECT 1")]
    df = spark.createDataFrame(rows, "run_id string, n bigint, task_name string, duration_ms double, db_cpu_ms double, db_io_ms double, "
                                     "parallel_degree int, rendered_sql string")
    first, second = report.report_rows(df, "n").orderBy("seq").collect()
    assert (first.plan_file, first.bottleneck, first.execution_time_sec, first.rendered_sql_file) == ("plans/01_Test CPU Task.txt", "CPU", 1.5, None)
    assert (second.seq, second.rendered_sql_file, second.parallel_degree, second.bottleneck) == (2, "rendered/02_ab çé 1.sql", 1, "Unknown")
    series = report.report_series(report.report_rows(df, "n"), points=1).orderBy("part").collect()
    assert [(r.part, r.names, r.durations) for r in series] == [(0, ["Test CPU Task"], [1.5]), (1, ["a/b: çé #1"], [0.0])]


@pytest.mark.parametrize("parsed", [False, True])
def test_counters_count_the_same_at_any_depth(spark, parsed):
    node = {"Node Type": "Gather", "Workers Launched": 2.0, "Shared Read Blocks": 10.0, "Local Read Blocks": "10", "Temp Read Blocks": "none",
            "Shared Hit Blocks": 3e1, "Local Hit Blocks": True, "I/O Read Time": "0.5", "I/O Write Time": [1]}
    docs = []
    for depth in (1, 8, 17, 18, 30):
        plan = node
        for _ in range(depth - 1):
            plan = {"Node Type": "Sort", "Plans": [plan, {"Node Type": "Scan", "Temp Read Blocks": None, "Plans": "odd"}]}
        docs.append(json.dumps([{"Plan": plan, "Execution Time": "1.5"}]))
    assert metrics(spark, docs, parsed) == [(1.5, 20, 30, 0.5, 2)] * len(docs)


def test_repeated_keys_count_the_same_at_any_depth(spark):
    text = '{"Node Type": "Gather", "Workers Launched": 9, "Workers Launched": 3, "Shared Read Blocks": 1, "Shared Read Blocks": 7}'
    docs = []
    for depth in (1, 3, 16, 17, 120):
        plan = text
        for _ in range(depth - 1):
            plan = '{"Node Type": "Sort", "Plans": [null, 5, %s]}' % plan
        docs.append('[{"Plan": %s, "Execution Time": 2}]' % plan)
    assert metrics(spark, docs) == [(2.0, 7, 0, 0.0, 3)] * len(docs)


def test_counters_that_do_not_fit_count_nothing(spark):
    node = ('{"Shared Read Blocks": 9223372036854775808, "Local Read Blocks": 9223372036854775807, "Temp Read Blocks": 1e400, '
            '"Shared Hit Blocks": -4, "Local Hit Blocks": 5.99, "I/O Read Time": 1e999999999, "I/O Write Time": "NaN"}')
    assert metrics(spark, ['[{"Plan": %s, "Execution Time": "x"}]' % node, None, '[{"Plan": {"Shared Read Blocks": NaN}}]']) == [
        (0.0, 2**63 - 1, 1, 0.0, None), (None,) * 5, (None,) * 5]


def test_plain_counters_take_the_short_way(monkeypatch):
    from runweave.plans import explain

    plan = '[{"Plan": {"Shared Read Blocks": 7, "Local Hit Blocks": "5", "I/O Write Time": 0.5, "I/O Read Time": 2, "Plans": [{"Temp Read Blocks": 3}]}, "Execution Time": 1.25}]'
    want = {"time": 1.25, "read_blocks": 10, "hit_blocks": 5, "db_io_ms": 2.5, "parallel_degree": None}
    odd = plan.replace(" 7,", ' " 7e0",')
    assert explain.walk_plan(plan) == want == explain.walk_plan(odd)
    monkeypatch.setattr(explain, "_whole", None)
    monkeypatch.setattr(explain, "_decimal", None)
    assert explain.walk_plan(plan) == want
