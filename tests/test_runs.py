import hashlib

import pytest
from pyspark.sql import functions as F

from runweave.runs import query, steps
from runweave.sinks.publish import published, read_published
from runweave.sources.files import scan_run_log

STEP_SCHEMA = (
    "manifest string, seq bigint, name string, type string, enabled boolean, file string, sql_id string, params map<string,string>, "
    "transaction_group string, joined_group string, joined_glue string, cleanup_target string, cleanup_mode string, output_file string"
)


@pytest.fixture
def make(spark):
    def build(*given):
        fields = [part.split()[0] for part in STEP_SCHEMA.split(", ")]
        default = dict(manifest="m", type="sql", enabled=True, cleanup_mode="drop")
        return spark.createDataFrame(
            [tuple({**dict.fromkeys(fields), **default, "seq": i, "name": f"s{i}", **g}[f] for f in fields) for i, g in enumerate(given, 1)],
            STEP_SCHEMA)

    return build


@pytest.mark.parametrize("sql", [
    "DROP TABLE t", "SELECT 1\n UPDATE t SET a = 1", "insert into t values (1)", "SELECT 1; DROP TABLE t", "SELECT 1; SELECT 2"])
def test_guard_blocks(spark, sql):
    with pytest.raises(query.DqlOnlyError):
        query.run_sql(spark, sql, dql_only=True)


def test_guard_names_the_keyword():
    with pytest.raises(query.DqlOnlyError, match="'DROP'"):
        query.check_dql("  DROP TABLE t")
    query.check_dql("-- c\nWITH x AS (SELECT 1) SELECT * FROM x;")


def test_run_sql(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "data" / "nums"))
    known = {"T": {"path": str(tmp_path / "data"), "tables": ["nums"]}}
    log = str(tmp_path / "log")
    sql = "SELECT id FROM nums WHERE id >= :low ORDER BY id"
    result = query.run_sql(spark, sql, target="T", targets=known, params={"low": 4}, limit=3, log_dir=log, fetch_name="my_query", dql_only=True)
    assert result.columns == ["id"]
    assert result.sql_hash == hashlib.sha256(f"SELECT * FROM ({sql}) sub LIMIT 3".encode()).hexdigest()[:16]
    record = result.to_csv(str(tmp_path / "out"))
    assert record["rows"] == 3 and record["status"] == "ok"
    rows, _ = query.run_sql(spark, sql, target="T", targets=known, params={"low": 4}, limit=0).run(lambda df: df.collect())
    assert [r.id for r in rows] == [4, 5, 6, 7, 8, 9]
    logged = scan_run_log(spark, log).collect()
    assert [(r.fetch, r.rows, r.transport) for r in logged] == [("my_query", 3, "parquet")]


def test_run_sql_errors_are_logged_and_raised(spark, tmp_path):
    log = str(tmp_path / "log")
    with pytest.raises(Exception, match="nowhere"):
        query.run_sql(spark, "SELECT * FROM nowhere", log_dir=log)
    failing = query.run_sql(spark, "SELECT raise_error('connection refused') AS x", log_dir=log)
    with pytest.raises(Exception, match="connection refused"):
        failing.to_parquet(str(tmp_path / "out"))
    logged = scan_run_log(spark, log).collect()
    assert all(r.status == "error" and r.rows == 0 for r in logged) and any("connection refused" in r.error for r in logged) and len(logged) == 2


def test_target_excludes_tables(spark):
    with pytest.raises(ValueError, match="exclude each other"):
        query.run_sql(spark, "SELECT 1", target="T", targets={"T": {"path": "/x", "tables": []}}, tables={})


def test_script_statements():
    script = "-- a; b\nSELECT ';' AS x; /* c; */ SELECT \"a;b\" ; ;\n-- end;\n"
    assert query.script_statements(script) == ["-- a; b\nSELECT ';' AS x", "/* c; */ SELECT \"a;b\""]


def test_run_script_stops_at_the_first_error(spark):
    with pytest.raises(Exception, match="nowhere_at_all"):
        query.run_script(spark, "SELECT 1; SELECT * FROM nowhere_at_all; CREATE OR REPLACE TEMP VIEW never AS SELECT 1")
    assert not spark.catalog.tableExists("never")
    assert query.run_script(spark, "SELECT 1 AS a; SELECT :x AS b;", {"x": 5}).first().b == 5
    assert query.run_script(spark, " ;; ") is None


def test_lower_headers_and_limit(spark):
    df = query.lower_headers(spark.sql("SELECT 1 AS A, 2 AS bC"))
    assert df.columns == ["a", "bc"]
    assert query.limit_wrap(spark.range(9), 0).count() == 9 and query.limit_wrap(spark.range(9), 4).count() == 4


def test_profile(spark):
    row = query.profile_query(spark, "SELECT id FROM range(7);").first()
    assert row.rows == 7 and row.duration_ms > 0 and "Range" in row.plan_content


def test_render_and_fuse():
    assert steps.render_sql("a {{ x }} {{y}} {{ z }}\n", {"x": 1, "y": None}) == "a 1 None "
    assert steps.render_sql("a {{ x }}\n", {}) == "a {{ x }}\n"
    assert steps.fuse_sql(["SELECT 1;", "SELECT 2;"], None) == "SELECT 1\n;\n\nSELECT 2\n;"
    with pytest.raises(ValueError, match="joined_glue"):
        steps.fuse_sql(["a"], "weird")


def test_manifest_publishes_groups_and_resumes(spark, make, tmp_path):
    texts = {"a.sql": "SELECT {{ n }} AS n, 'x' AS t", "bad.sql": "SELECT * FROM not_there_yet", "c.sql": "SELECT id FROM range(3)"}
    table = make(
        {"file": "a.sql", "params": {"n": "1"}, "output_file": "one"},
        {"file": "a.sql", "params": {"n": "2"}, "output_file": "two", "transaction_group": "g"},
        {"file": "bad.sql", "output_file": "three", "transaction_group": "g"},
        {"type": "python", "file": "f", "params": {"n": "4"}, "name": "four"},
        {"type": "manifest", "file": "kid"},
        {"manifest": "kid", "seq": 1, "file": "c.sql", "output_file": "five"},
        {"manifest": "kid", "seq": 2, "file": "c.sql", "output_file": "off", "enabled": False},
    )
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    how = dict(sql_texts=texts, functions={"f": lambda session, n: session.range(int(n))})
    with pytest.raises(steps.StepFailed) as failure:
        steps.run_steps(spark, table, "m", out, log, **how)
    assert failure.value.failed_step == "s3" and "**Group:** `g`" in failure.value.body and "**SQL hash:**" in failure.value.body
    # the failed group is discarded as a whole
    assert {r.name for r in published(spark, out).collect()} == {"one"}
    spark.range(2).createOrReplaceTempView("not_there_yet")
    ran = steps.run_steps(spark, table, "m", out, log, **how)
    assert [r["name"] for r in ran] == ["s2", "s3", "four", "s5"]
    assert {r.name for r in published(spark, out).collect()} == {"one", "two", "three", "four", "five"}
    assert read_published(spark, out, "four").count() == 4
    assert steps.run_steps(spark, table, "m", out, log, **how) == []
    assert len(steps.run_steps(spark, table, "m", out, log, enable_all=True, **how)) == 5
    text = spark.read.text(published(spark, out).where("name = 'three'").first().path)
    assert sorted(r.value for r in text.collect()) == ["0", "1", "id"]


def test_fused_group_runs_once_and_splits_its_time(spark, make, tmp_path):
    texts = {"1.sql": "CREATE OR REPLACE TEMP VIEW fused_v AS", "2.sql": "SELECT 41 + 1 AS n"}
    table = make({"type": "psql", "file": "1.sql", "joined_group": "j", "joined_glue": "raw"}, {"type": "psql", "file": "2.sql", "joined_group": "j"})
    records = steps.run_steps(spark, table, "m", str(tmp_path / "o"), str(tmp_path / "l"), sql_texts=texts)
    assert spark.table("fused_v").first().n == 42
    assert len(records) == 2 and records[0]["duration"] == records[1]["duration"]
    mixed = make({"type": "psql", "file": "1.sql", "joined_group": "j"}, {"file": "2.sql", "joined_group": "j"})
    with pytest.raises(steps.StepFailed, match="only psql steps"):
        steps.run_steps(spark, mixed, "m", str(tmp_path / "o2"), str(tmp_path / "l2"), sql_texts=texts)


def test_cleanup_bulk_insert_and_catalog(spark, make, tmp_path):
    texts = {"load.sql": "CREATE TABLE bulk_t (a INT) USING parquet; INSERT INTO bulk_t VALUES (1); INSERT INTO bulk_t VALUES (2);"}
    catalog = spark.createDataFrame([("load", "load.sql")], "sql_id string, file string")
    table = make({"type": "bulk_insert", "sql_id": "load", "cleanup_target": "bulk_t"})
    for run in range(2):
        steps.run_steps(spark, table, "m", str(tmp_path / "o"), str(tmp_path / "l"), sql_texts=texts, catalog=catalog, enable_all=True)
    assert sorted(r.a for r in spark.table("bulk_t").collect()) == [1, 2]
    spark.sql("DROP TABLE bulk_t")
    with pytest.raises(ValueError, match="lost"):
        steps.run_steps(spark, make({"sql_id": "lost"}), "m", str(tmp_path / "o"), str(tmp_path / "l"), catalog=catalog)


def test_apply_step(spark):
    shifted = steps.apply_step(spark.range(2), lambda df, by: df.select((F.col("id") + int(by)).alias("id")), {"by": "3"})
    assert sorted(r.id for r in shifted.collect()) == [3, 4]


def test_manifest_files(spark, tmp_path):
    (tmp_path / "one.sql").write_text("SELECT {{ n }} AS n;\n")
    child = tmp_path / "child.yaml"
    child.write_text(f"steps:\n  - {{name: inner, type: sql, file: {tmp_path}/one.sql, params: {{n: 7}}, output_file: inner}}\n")
    main = tmp_path / "main.yaml"
    main.write_text(f"steps:\n  - {{name: call, type: manifest, file: {child}}}\n  - {{name: off, type: sql, file: x.sql, enabled: false}}\n")
    ran = steps.run_manifest(spark, str(main), str(tmp_path / "o"), str(tmp_path / "l"))
    assert [r["name"] for r in ran] == ["call"]
    out = published(spark, str(tmp_path / "o")).first()
    assert (out.name, sorted(r.value for r in spark.read.text(out.path).collect())) == ("inner", ["7", "n"])
    main.write_text("steps:\n  - {name: a, type: sql}\n  - {name: b, type: nope}\n")
    with pytest.raises(ValueError, match="step 2: type nope is not one of"):
        steps.run_manifest(spark, str(main), str(tmp_path / "o"), str(tmp_path / "l"))


def test_flawed_catalog_is_refused(spark, make, tmp_path):
    catalog = spark.createDataFrame([("x", "a.sql"), ("x", "b.sql")], "sql_id string, file string")
    with pytest.raises(ValueError, match="duplicate id x"):
        steps.run_steps(spark, make({"sql_id": "x"}), "m", str(tmp_path / "o"), str(tmp_path / "l"), catalog=catalog)


def test_report_of_a_run(spark, make, tmp_path):
    texts = {"q.sql": "SELECT id FROM range({{ n }}) ;", "v.sql": "CREATE OR REPLACE TEMP VIEW reported AS SELECT 1 AS a", "bad.sql": "SELECT nope"}
    table = make(
        {"name": "load it!", "file": "q.sql", "params": {"n": "5"}}, {"file": "v.sql"}, {"type": "psql", "file": "q.sql", "params": {"n": "2"}, "joined_group": "j"},
        {"file": "bad.sql"}).withColumn("profile", F.lit(True))
    with pytest.raises(steps.StepFailed):
        steps.run_steps(spark, table, "m", str(tmp_path / "o"), str(tmp_path / "l"), sql_texts=texts, report_dir=str(tmp_path / "r"))
    rows = spark.read.parquet(str(tmp_path / "r")).orderBy("seq").collect()
    assert [r.plan_file for r in rows] == ["plans/01_load it.txt", "plans/02_s2.txt", "plans/03_s3.txt"]
    assert rows[0].rendered_sql == "SELECT id FROM range(5) ;" and "Range" in rows[0].plan_content
    assert rows[1].plan_content == "(profiling disabled for this step)"
    assert rows[2].plan_content == "(part of joined_group 'j', 1 fragments)"
    # What ran has measured figures; the view ran nothing.
    assert [r.bottleneck in ("CPU", "I/O") for r in rows] == [True, False, True] and rows[1].bottleneck == "Unknown"
    assert all(r.parallel_degree >= 1 for r in rows) and rows[1].parallel_degree == 1
