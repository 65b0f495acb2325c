"""One key holds a third of the rows or more: plans must split it, and results stay whole."""

import contextlib

import pytest
from pyspark.sql import functions as F

from runweave.operators import grouping, steps
from runweave.plans import monitor, report
from runweave import workloads

ROWS = 120_000


@pytest.fixture
def shuffled_joins(spark):
    """No broadcast, and a low bar for what counts as a skewed partition."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    with contextlib.ExitStack() as stack:
        for key, value in conf.items():
            old = spark.conf.get(key, None)
            stack.callback(lambda k=key, v=old: spark.conf.unset(k) if v is None else spark.conf.set(k, v))
            spark.conf.set(key, value)
        yield


@pytest.fixture
def facts(spark):
    """Half of the rows carry key 7."""
    key = F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id") % 997)
    return spark.range(0, ROWS, 1, 8).select(F.col("id"), key.cast("bigint").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))


def final_plan(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_reconcile_splits_the_hot_key(spark, facts, shuffled_joins):
    canonical = spark.range(0, 500).withColumnRenamed("id", "c")
    rows, plan = final_plan(workloads.reconcile(facts, canonical, "k", "c"))
    assert len(rows) == ROWS and "skew=true" in plan
    assert sum(r.tag == "mismatch" for r in rows) == sum(1 for i in range(ROWS) if i % 2 and i % 997 >= 500)


def test_resolve_splits_a_hot_id_and_spreads_steps_without_one(spark, facts, shuffled_joins):
    table = facts.select(
        F.lit("m").alias("manifest"), F.col("id").alias("seq"), F.when(F.col("k") == 7, "own.sql").alias("file"),
        F.when(F.col("k") != 7, F.when(F.col("k") < 600, F.lit("hot")).otherwise(F.concat(F.lit("p"), "k"))).alias("sql_id"), "pad")
    catalog = spark.range(500, 997).select(F.concat(F.lit("p"), "id").alias("sql_id"), F.concat(F.lit("f"), "id").alias("file"))
    catalog = catalog.unionByName(spark.createDataFrame([("hot", "hot.sql")], "sql_id string, file string"))
    rows, plan = final_plan(steps.resolve_sql_ids(table, catalog))
    assert len(rows) == ROWS and all(r.file for r in rows) and all(r.sql_id is None for r in rows)
    assert "skew=true" in plan


def test_expand_splits_a_manifest_with_most_steps(spark, facts, shuffled_joins, monkeypatch):
    monkeypatch.setattr(steps, "broadcast_if_small", lambda df: df)
    leaves = facts.select(F.concat(F.lit("c"), "k").alias("manifest"), F.col("id").alias("seq"), F.lit("o.sql").alias("file"), F.lit("sql").alias("type"), "pad")
    calls = facts.select("k").distinct().select(
        F.lit("top").alias("manifest"), F.col("k").alias("seq"), F.concat(F.lit("c"), "k").alias("file"), F.lit("manifest").alias("type"), F.lit("").alias("pad"))
    rows, plan = final_plan(steps.expand_manifests(leaves.unionByName(calls).withColumn("enabled", F.lit(True)), "top"))
    assert len(rows) == ROWS and all(r.path == [int(r.manifest[1:]), r.seq] for r in rows)
    assert "skew=true" in plan


def test_even_split_deals_a_hot_group(spark, facts, shuffled_joins):
    walls = facts.select("k").distinct().withColumn("wall", F.lit(1000.0))
    split = grouping.even_split(facts.select("id", "k"), walls, ["k"])
    counts = {r.k: r.n for r in facts.groupBy("k").agg(F.count("*").alias("n")).collect()}
    got = split.groupBy("k").agg(F.min("duration").alias("lo"), F.max("duration").alias("hi"), F.count("*").alias("n")).collect()
    assert {r.k: r.n for r in got} == counts
    assert all(r.lo == r.hi == 1000.0 / counts[r.k] for r in got)


def test_one_run_over_a_third_of_the_rows(spark):
    """A fused group longer than a row may hold: text in bounded pieces, nothing lost."""
    table = spark.range(0, 30_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 50).alias("manifest"), F.col("id").alias("seq"),
        F.lit("psql").alias("type"), F.lit("g").alias("joined_group"), F.lit("raw").alias("joined_glue"), F.col("id").cast("string").alias("sql_text"))
    fused = grouping.fuse_fragments(table, segment_rows=512)
    hot = fused.where("manifest = -1").orderBy("segment").collect()
    assert max(r.fragments for r in hot) <= 512 and len(hot) > 50
    assert hot[0].joint.join(r.sql_text for r in hot) == "\n".join(str(i) for i in range(0, 30_000, 3))
    assert fused.agg(F.sum("fragments")).first()[0] == 30_000


def test_report_of_one_run_with_most_tasks(spark):
    tasks = spark.range(0, 9_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("r"), F.col("id") % 20)).alias("run_id"), F.col("id").alias("n"),
        F.concat(F.lit("t"), "id").alias("task_name"), F.lit(1.0).alias("duration_ms"))
    rows = report.report_rows(tasks, "n", block_rows=100)
    hot = rows.where("run_id = 'hot'").orderBy("seq").collect()
    assert [r.seq for r in hot] == list(range(1, 3001)) and [r.task_name for r in hot] == [f"t{i}" for i in range(0, 9000, 3)]
    series = report.report_series(rows, points=250).where("run_id = 'hot'").orderBy("part").collect()
    assert [len(r.names) for r in series] == [250] * 12
    assert [n for r in series for n in r.names] == [r.task_name for r in hot]


def test_hot_sessions_fold_before_the_shuffle(spark, facts):
    values = facts.select(F.col("k").alias("sid"), (F.col("id") % 3).alias("statistic"), F.col("id").alias("value"))
    names = spark.createDataFrame([(0, monitor.CPU_STAT), (1, monitor.IO_STAT), (2, "other")], "statistic bigint, name string")
    stats = monitor.session_stats(values, names)
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan
    assert stats.where("sid = 7").first().stats[monitor.CPU_STAT] == max(i for i in range(0, ROWS, 2) if i % 3 == 0)
