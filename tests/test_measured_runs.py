"""Measured profiles, parsed statements, and what the step runner reads beside a manifest."""

import pytest
from pyspark.sql import functions as F

from runweave import workloads
from runweave.runs import measure, parsed, query, steps
from runweave.sinks.publish import published

from test_runs import make  # noqa: F401


def names(spark, sql):
    return {".".join(n) for n in parsed.tables_named(parsed.parse(spark, sql))}


def test_tables_of_a_statement(spark):
    assert names(spark, "WITH a AS (SELECT * FROM t1) SELECT *, (SELECT max(x) FROM t2) FROM a JOIN db.t3 WHERE x IN (SELECT 't5' FROM t4) -- t6") == {
        "t1", "t2", "db.t3", "t4"}
    # a clause does not see itself, later ones and what is outside see it
    assert names(spark, "WITH t AS (SELECT * FROM t), u AS (SELECT * FROM T) SELECT * FROM u") == {"t"}
    assert names(spark, "WITH u AS (SELECT * FROM v), v AS (SELECT 1) SELECT * FROM u") == {"v"}
    assert names(spark, "WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT * FROM r") == set()
    assert names(spark, "SELECT * FROM (WITH s AS (SELECT 1) SELECT * FROM s) JOIN s") == {"s"}
    assert names(spark, "SELECT 'FROM x' AS orders /* FROM y */") == set()
    assert parsed.has_named_parameter(parsed.parse(spark, "WITH a AS (SELECT * FROM IDENTIFIER(:t)) SELECT * FROM a"))


@pytest.mark.parametrize("sql", [
    "WITH x AS (SELECT 1 AS a) INSERT INTO u SELECT * FROM x", "FROM t INSERT INTO u SELECT *", "CACHE TABLE t", "SET a = b", "USE other",
    "REFRESH TABLE t", "ANALYZE TABLE t COMPUTE STATISTICS", "MSCK REPAIR TABLE t"])
def test_commands_are_not_read_only(spark, sql):
    with pytest.raises(query.DqlOnlyError):
        query.run_sql(spark, sql, dql_only=True)


def test_read_only_statements_pass(spark):
    for sql in ("SELECT ';' AS a, 'x; y' AS b;", "VALUES (1)", "SHOW TABLES", "EXPLAIN SELECT 1", "FROM range(3) |> SELECT id", "-- c; d\nSELECT 1"):
        query.run_sql(spark, sql, dql_only=True)


def test_target_leaves_the_views_of_the_user(spark, tmp_path):
    spark.createDataFrame([(1,)], "v int").write.parquet(f"{tmp_path}/a/mine")
    spark.createDataFrame([(2,)], "v int").write.parquet(f"{tmp_path}/a/other")
    spark.createDataFrame([(7,)], "v int").createOrReplaceTempView("mine")
    spark.createDataFrame([(8,)], "v int").createOrReplaceTempView("users_own")
    known = {"A": {"path": f"{tmp_path}/a", "tables": ["mine", "other", "absent"]}}
    run = lambda sql, **how: query.run_sql(spark, sql, target="A", targets=known, **how).data
    late = run("SELECT v, 'absent' AS w FROM MINE -- absent")
    assert spark.table("mine").first().v == 7 and not spark.catalog.tableExists("other")
    assert late.first().v == 1
    assert run("SELECT v FROM IDENTIFIER(:t)", params={"t": "other"}).first().v == 2
    assert run("SELECT mine.v + o.v AS v FROM mine, (SELECT * FROM other) o").first().v == 3
    assert run("WITH users_own AS (SELECT * FROM other) SELECT v FROM users_own").first().v == 2
    for sql in ("SELECT * FROM users_own", "SELECT * FROM mine WHERE v IN (SELECT v FROM users_own)", f"SELECT * FROM parquet.`{tmp_path}/a/mine`"):
        with pytest.raises(ValueError, match="lists no table"):
            run(sql)
    with pytest.raises(Exception, match="nope"):
        run("SELECT nope FROM mine")
    assert spark.table("mine").first().v == 7


def test_measured_block(spark):
    spark.sparkContext.setLocalProperty(measure.GROUP, "callers")
    with measure.measured(spark) as took:
        spark.range(400_000, numPartitions=3).groupBy((F.col("id") % 7).alias("k")).agg(F.sum(F.sqrt("id"))).write.format("noop").mode("overwrite").save()
    assert took.parallel_degree == 3 and took.tasks >= 4 and took.rows_read == 400_000 and took.db_cpu_ms > 0 and took.duration_ms > 0
    assert "HashAggregate" in took.plan and "Final Plan" in took.plan
    with pytest.raises(Exception, match="broken"), measure.measured(spark) as failed:
        spark.sql("SELECT raise_error('broken')").collect()
    assert failed.duration_ms > 0
    with measure.measured(spark) as nothing:
        pass
    assert (nothing.tasks, nothing.parallel_degree, nothing.plan) == (0, 1, None)
    assert spark.sparkContext.getLocalProperty(measure.GROUP) == "callers"
    spark.sparkContext.setLocalProperty(measure.GROUP, None)


def test_profile_is_that_of_the_run(spark):
    spark.range(9, numPartitions=1).createOrReplaceTempView("one_part")
    spark.range(40, numPartitions=4).createOrReplaceTempView("four_parts")
    one = query.profile_query(spark, "SELECT id FROM one_part").first()
    four = query.profile_query(spark, "SELECT id FROM four_parts").first()
    assert (one.parallel_degree, four.parallel_degree, one.rows, four.rows, four.tasks) == (1, 4, 9, 40, 4)


def test_report_has_measured_figures(spark, make, tmp_path):  # noqa: F811
    texts = {"heavy.sql": "SELECT id % 5 AS k, sum(sqrt(id)) AS s FROM range(0, 3000000, 1, 3) GROUP BY id % 5", "v.sql": "CREATE OR REPLACE TEMP VIEW measured_v AS SELECT 1 AS a"}
    table = make({"file": "heavy.sql", "output_file": "out"}, {"file": "heavy.sql"}, {"file": "v.sql"}).withColumn("profile", F.lit(True))
    steps.run_steps(spark, table, "m", str(tmp_path / "o"), str(tmp_path / "l"), sql_texts=texts, report_dir=str(tmp_path / "r"))
    rows = spark.read.parquet(str(tmp_path / "r")).orderBy("seq").collect()
    assert [r.parallel_degree for r in rows] == [3, 3, 1] and [r.bottleneck == "Unknown" for r in rows] == [False, False, True]
    assert all(r.cpu_time_sec > 0 and "Final Plan" in r.plan_content for r in rows[:2]) and rows[2].plan_content == steps.NO_PLAN


def test_dialect_variants_are_read(spark, make, tmp_path):  # noqa: F811
    folder = tmp_path / "sql" / "postgres-pipeline"
    (folder / "schemas").mkdir(parents=True)
    (folder / "a.sql").write_text("SELECT 'a of postgres' AS t")
    (folder / "schemas" / "b_c.sql").write_text("SELECT 'b of postgres' AS t")
    original = {name: f"SELECT 'original {name}' AS t" for name in ("x/a.sql", "x/b - c.sql", "x/d.sql")}
    table = make(*[{"file": name, "output_file": f"o{i}"} for i, name in enumerate(original)])

    def texts(out, **how):
        steps.run_steps(spark, table, "m", str(tmp_path / out), str(tmp_path / f"{out}-log"), sql_texts=original, **how)
        return [sorted(r.value for r in spark.read.text(p.path).collect() if r.value != "t")[0] for p in published(spark, str(tmp_path / out)).orderBy("name").collect()]

    plain = ["original x/a.sql", "original x/b - c.sql", "original x/d.sql"]
    assert texts("p", dialect="postgresql+psycopg2", variants_dir=str(tmp_path / "sql")) == ["a of postgres", "b of postgres", "original x/d.sql"]
    assert texts("q", dialect="oracle", variants_dir=str(tmp_path / "sql")) == plain
    assert texts("r", dialect="duckdb", variants_dir=str(tmp_path / "sql")) == plain


def test_catalog_beside_the_manifest_and_dry_run(spark, tmp_path, capsys):
    (tmp_path / "one.sql").write_text("SELECT 5 AS n")
    main = tmp_path / "main.yaml"
    main.write_text("steps:\n  - {name: first, type: sql, sql_id: one, output_file: out, description: all of it}\n  - {name: off, type: sql, file: x.sql, enabled: false}\n")
    catalog = tmp_path / "sql-catalog.yaml"
    catalog.write_text(f"sql:\n  - {{id: one, file: {tmp_path}/one.sql}}\n")
    run = lambda **how: steps.run_manifest(spark, str(main), str(tmp_path / "o"), str(tmp_path / "l"), **how)
    assert run(dry_run=True) == [] and not (tmp_path / "o").exists() and not (tmp_path / "l").exists()
    assert capsys.readouterr().out == "[1] SQL: first\n     all of it\n--- 1 tasks (1 steps) ---\n"
    assert [r["name"] for r in run()] == ["first"]
    catalog.write_text("sql:\n" + "".join(f"  - {{id: id{i:02}, file: a.sql}}\n" * 2 for i in range(12)))
    with pytest.raises(steps.CatalogError, match=r"duplicate id id00.* and 2 more"):
        run(enable_all=True)
    catalog.write_text("sql: []\n")
    with pytest.raises(steps.CatalogError, match="not found in catalog: .'one'"):
        run(enable_all=True)


def test_messages_of_a_run(spark, make, tmp_path):  # noqa: F811
    told = []
    texts = {"ok.sql": "SELECT 1 AS a", "bad.sql": "SELECT nope"}
    table = make({"file": "ok.sql"}, {"file": "ok.sql"}, {"file": "bad.sql"}).withColumn("notify", F.col("seq") == 2)
    how = dict(sql_texts=texts, tell=lambda subject, text: told.append((subject, text)))
    with pytest.raises(steps.StepFailed):
        steps.run_steps(spark, table, "m", str(tmp_path / "o"), str(tmp_path / "l"), **how)
    assert [t[0] for t in told] == ["Step Completed", "Job Failed"] and told[0][1].startswith("Step 's2' completed in ")
    assert "**Failed Step:** s3" in told[1][1] and "nope" in told[1][1]
    assert "\nTask 1 - s1 - time taken: " in told[1][1] and "\nTask 2 - s2 - time taken: " in told[1][1]
    told.clear()
    steps.run_steps(spark, table.where("seq < 3"), "m", str(tmp_path / "o2"), str(tmp_path / "l2"), **how)
    assert told[-1][0] == "Job Finished" and "**Total Duration:**" in told[-1][1]
    told.clear()
    steps.run_steps(spark, table.where("seq < 3"), "m", str(tmp_path / "o2"), str(tmp_path / "l2"), **how)
    assert [t[0] for t in told] == ["Job Finished"] and told[0][1].endswith("**Executed tasks:**\nNone")


def test_summary_groups_steps():
    records = [dict(name=n, group=g, duration=1.5) for n, g in (("a", None), ("b", "g"), ("c", "g"), ("d", None), ("e", None))]
    assert steps._summary(records).split("\n") == [
        "Task 1 - a - time taken: 1.50s", "Task 2 - Group g (2 steps) - time taken: 3.00s", "Task 3 - d - time taken: 1.50s", "Task 4 - e - time taken: 1.50s"]


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    path = tmp_path / "t"
    rows = [(1, 1.0, "a"), (2, 2.0, "a"), (3, 3.0, "b"), (4, 4.0, None), (None, 5.0, "b"), (6, 6.0, "c")]
    spark.createDataFrame(rows, "k int, v double, p string").write.partitionBy("p").parquet(str(path))
    files = lambda: {d.name: {f.name for f in d.glob("*.parquet")} for d in path.iterdir() if d.is_dir()}
    got = lambda: sorted(((r.k, r.v, r.p) for r in spark.read.parquet(str(path)).collect()), key=lambda r: r[1])
    update = lambda *scores: workloads.update_partitions(
        spark, str(path), spark.createDataFrame(list(scores), "k int, score double"), "k", "v", "p")
    before = files()
    assert update((9, 1.0), (None, 7.0)) == [] and files() == before
    assert update((1, 1.5)) == ["a"]
    after = files()
    assert {name for name in before if before[name] != after[name]} == {"p=a"}
    assert got() == [(1, 1.5, "a"), *rows[1:]]
    # a null partition, and a null score that keeps the value
    assert update((4, 4.5), (2, None)) in (["a", None], [None, "a"])
    assert got() == [(1, 1.5, "a"), (2, 2.0, "a"), (3, 3.0, "b"), (4, 4.5, None), (None, 5.0, "b"), (6, 6.0, "c")]
    assert files()["p=b"] == before["p=b"] and files()["p=c"] == before["p=c"]
