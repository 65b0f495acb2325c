import json

import pytest

from runweave.operators.steps import typed_steps
from runweave.sources import files, jdbc, targets


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_values_are_text(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'id,name,note\n1,alice,"says, hi"\n2,,"two\nlines ""quoted"""\n')
    df = files.scan_csv_strings(spark, path)
    assert df.columns == ["id", "name", "note"]
    assert sorted(tuple(r) for r in df.collect()) == [("1", "alice", "says, hi"), ("2", "", 'two\nlines "quoted"')]


@pytest.mark.parametrize("text", ["", "\n\n"])
def test_csv_without_lines_is_empty(spark, tmp_path, text):
    df = files.scan_csv_strings(spark, write(tmp_path / "e.csv", text))
    assert df.columns == [] and df.count() == 0


def test_parquet_lists_globs_and_file_names(spark, tmp_path):
    for name in ("a", "b"):
        spark.range(2).coalesce(1).write.parquet(str(tmp_path / name))
    by_list = files.scan_parquet(spark, [str(tmp_path / "a"), str(tmp_path / "b")], filename=True)
    assert by_list.count() == 4 and by_list.select("filename").distinct().count() == 2
    assert files.scan_parquet(spark, f"{tmp_path}/*").count() == 4


def test_report_summary(spark, tmp_path):
    task = {"name": "t", "db_type": "ORACLE", "execution_time_sec": 45.0, "parallel_degree": 4,
            "profile": {"cpu_time_sec": 120.0, "io_time_sec": 5.0, "bottleneck": "CPU"}, "plan_file": "plans/01_t.txt", "plan_content": "P"}
    doc = {"meta": {"timestamp": "2024", "db": "Oracle 19c"}, "tasks": [task, {**task, "name": "u"}]}
    rows = files.scan_report_tasks(spark, write(tmp_path / "summary.json", json.dumps(doc, indent=2))).orderBy("seq").collect()
    assert [(r.seq, r.name, r.db, r.cpu_time_sec, r.bottleneck, r.rendered_sql_file) for r in rows] == [
        (1, "t", "Oracle 19c", 120.0, "CPU", None), (2, "u", "Oracle 19c", 120.0, "CPU", None)]


def test_sql_files(spark, tmp_path):
    write(tmp_path / "sql" / "a.sql", "SELECT 'é'\nFROM t;\n")
    write(tmp_path / "sql" / "b.sql", "")
    rows = files.scan_sql_files(spark, f"{tmp_path}/sql/*.sql").collect()
    assert {r.path.rsplit("/", 1)[1]: r.sql_text for r in rows} == {"a.sql": "SELECT 'é'\nFROM t;\n"}
    assert files.read_sql_file(spark, f"{tmp_path}/sql/a.sql") == rows[0].sql_text
    assert files.read_sql_file(spark, f"{tmp_path}/sql/b.sql") == ""
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.scan_sql_files(spark, f"{tmp_path}/none.sql")


def test_manifest_and_catalog_files(spark, tmp_path):
    manifest = write(tmp_path / "m.yaml", """
steps:
  - name: "Import"
    file: "scripts/import.sql"
    type: sql
    transaction_group: 1
    params: {region: "US-EAST", n: 3}
    notify: true
  - name: "Cleanup"
    file: clean.py
    type: python
    enabled: false
    description: null
""")
    raw = files.scan_manifests(spark, manifest)
    first, second = typed_steps(raw).orderBy("seq").collect()
    assert (first.name, first.transaction_group, first.notify, first.params) == ("Import", "1", True, {"region": "US-EAST", "n": "3"})
    assert (second.seq, second.enabled, second.type, second.description) == (2, False, "python", None)
    catalog = write(tmp_path / "c.yaml", """
sql:
  - {id: load, file: scripts/load.sql, intent: "Load rows", read_only: false, expected_duration_s: 60}
  - {id: x, file: x.sql}
""")
    got = files.scan_catalog(spark, catalog).orderBy("sql_id").collect()
    assert [tuple(r) for r in got] == [("load", "scripts/load.sql", "Load rows", False, 60.0), ("x", "x.sql", None, False, None)]


def test_targets(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "things"))
    known = {"LOCAL": {"path": str(tmp_path), "tables": ["things", "absent"]}}
    assert targets.resolve_target(known, "LOCAL")["path"] == str(tmp_path)
    with pytest.raises(ValueError, match=r"'NOPE'. Registered targets: \['LOCAL'\]"):
        targets.resolve_target(known, "NOPE")
    with pytest.raises(ValueError, match="none"):
        targets.resolve_target({}, "NOPE")
    targets.register_target(spark, known, "LOCAL", only=["THINGS"])
    assert spark.table("things").count() == 3
    with pytest.raises(ValueError, match="Unknown transport"):
        targets.target_table(spark, {"transport": "pigeon"}, "t")


def test_jdbc_options():
    config = {"dialect": "postgresql+psycopg2", "host": "h", "port": 5432, "database": "d", "user": "u", "password": "p"}
    assert jdbc.jdbc_url(config) == "jdbc:postgresql://h:5432/d"
    assert jdbc.jdbc_url({**config, "dialect": "oracle+oracledb", "service": "s", "port": 1521}) == "jdbc:oracle:thin:@//h:1521/s"
    assert jdbc.jdbc_options(config, query="SELECT 1")["query"] == "SELECT 1"
    split = jdbc.jdbc_options(config, query="SELECT 1", partition_column="id", lower_bound=0, upper_bound=9, num_partitions=3)
    assert split["dbtable"] == "(SELECT 1) q" and split["numPartitions"] == "3" and "query" not in split
    assert jdbc.jdbc_options(config, table="t")["dbtable"] == "t"
    with pytest.raises(ValueError, match="either a table or a query"):
        jdbc.jdbc_options(config)
    with pytest.raises(ValueError, match="numPartitions"):
        jdbc.jdbc_options(config, table="t", partition_column="id", lower_bound=0, upper_bound=9)


def test_read_sql_file_refuses_several_files(spark, tmp_path):
    for name in ("a.sql", "b.sql"):
        (tmp_path / name).write_text("SELECT 1")
    assert files.read_sql_file(spark, str(tmp_path / "a.sql")) == "SELECT 1"
    with pytest.raises(ValueError, match="more than one"):
        files.read_sql_file(spark, str(tmp_path))


def test_a_target_does_not_see_tables_of_another(spark, tmp_path):
    from runweave.runs.query import run_sql

    for folder, value in (("a", 1), ("b", 2)):
        spark.createDataFrame([(value,)], "v int").write.parquet(f"{tmp_path}/{folder}/both_have")
    spark.createDataFrame([(3,)], "v int").write.parquet(f"{tmp_path}/a/only_a_has")
    targets = {"A": {"path": f"{tmp_path}/a", "tables": ["both_have", "only_a_has"]}, "B": {"path": f"{tmp_path}/b", "tables": ["both_have"]}}
    first = run_sql(spark, "SELECT both_have.v, only_a_has.v AS w FROM both_have, only_a_has", target="A", targets=targets).data
    assert run_sql(spark, "SELECT v FROM both_have", target="B", targets=targets).data.first().v == 2
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        run_sql(spark, "SELECT v FROM only_a_has", target="B", targets=targets)
    assert tuple(first.first()) == (1, 3)  # an earlier result stays readable
