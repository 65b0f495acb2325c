import csv
import datetime
import io
import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from runweave.session import new_run_dir, shared_dir, shuffle_partitions
from runweave.sinks import files, publish, runlog, tables
from runweave.sources.files import scan_csv_strings, scan_run_log


def text_of(path):
    return "\n".join(p.read_text(encoding="utf-8") for p in sorted(path.glob("part-*")) if p.stat().st_size)


def test_shared_dir_is_the_one_the_session_names(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_run_dir(spark, "x").startswith(shared_dir(spark))


def test_a_cluster_must_name_its_shared_folder():
    context = SimpleNamespace(master="spark://x", getConf=lambda: SimpleNamespace(get=lambda key: None), getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default)))


def test_shuffle_partitions_follow_the_volume():
    assert [shuffle_partitions(b) for b in (0, 1 << 30, 1 << 40, 100 << 40)] == [200, 200, 5243, 100_000]


def test_csv_quotes_only_where_needed(spark, tmp_path):
    rows = [(1, "plain", datetime.datetime(2024, 1, 2, 3, 4, 5)), (2, 'a "b", c', None), (3, "", None)]
    df = spark.createDataFrame(rows, "id int, note string, ts timestamp_ntz").coalesce(1)
    files.sink_csv(df, str(tmp_path / "out"))
    assert text_of(tmp_path / "out") == 'id,note,ts\n1,plain,2024-01-02 03:04:05\n2,"a ""b"", c",\n3,,\n'
    back = scan_csv_strings(spark, str(tmp_path / "out")).orderBy("id").collect()
    assert [r.note for r in back] == ["plain", 'a "b", c', ""]


def test_csv_keeps_blanks_and_prints_like_python(spark, tmp_path):
    rows = [(" a ", True, 12345678.5, datetime.datetime(2024, 1, 2, 3, 4, 5, 500000)), ("\n b\t", False, 0.25, None), (" ", None, None, None)]
    df = spark.createDataFrame(rows, "s string, b boolean, d double, ts timestamp_ntz").coalesce(1)
    files.sink_csv(df, str(tmp_path / "out"))
    want = io.StringIO()
    csv.writer(want, lineterminator="\n").writerows([df.columns, *rows])
    assert text_of(tmp_path / "out") == want.getvalue()
    back = scan_csv_strings(spark, str(tmp_path / "out")).collect()
    assert [r.s for r in back] == [" a ", "\n b\t", " "]


def test_csv_without_rows_has_a_header(spark, tmp_path):
    files.sink_csv(spark.createDataFrame([], "a int, b string"), str(tmp_path / "out"))
    assert text_of(tmp_path / "out") == "a,b\n"


def test_plain_csv_prints_like_python(spark, tmp_path):
    numbers = [0.0, 1.5, -2.0, 1e6, 12345678.9, 1e7, 123456789012.25, 1e15, 1e16, 1.5e300, 0.001, 0.00025, 1e-5, 1.25e-7, -3e-12, None]
    rows = [(i, n, bool(i % 2), "a,b" if i else None) for i, n in enumerate(numbers)]
    df = spark.createDataFrame(rows, "i int, n double, b boolean, s string").coalesce(1)
    assert files.sink_csv_plain(df, str(tmp_path / "out"))
    lines = [line for line in text_of(tmp_path / "out").split("\n") if line]
    assert lines == ["i,n,b,s"] + [",".join(map(str, row)) for row in rows]


def test_plain_csv_without_rows_writes_nothing(spark, tmp_path):
    assert files.sink_csv_plain(spark.range(0), str(tmp_path / "none")) is False
    assert not (tmp_path / "none").exists()


def test_drop_and_truncate(spark):
    name = f"{tables.create_scratch_database(spark)}.t"
    tables.drop_table(spark, name)
    assert tables.truncate_table(spark, name) is False
    tables.load_table(spark.range(5), name)
    assert tables.truncate_table(spark, name) is True
    assert spark.table(name).count() == 0 and spark.table(name).columns == ["id"]
    tables.drop_table(spark, name)
    assert not spark.catalog.tableExists(name)


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert runlog.append_run_log(spark, path, [runlog.run_record("q", "parquet", "abc", 12, 3)])
    assert runlog.append_run_log(spark, path, [runlog.run_record("q", "parquet", "abc", 1, 0, "connection refused " * 100)])
    ok, failed = scan_run_log(spark, path).orderBy("rows", ascending=False).collect()
    assert (ok.status, ok.rows, ok.error) == ("ok", 3, None)
    assert (failed.status, len(failed.error)) == ("error", 500)
    first = next(json.loads(line) for line in text_of(tmp_path / "log").splitlines() if '"ok"' in line)
    assert list(first) == ["ts", "fetch", "transport", "sql_hash", "elapsed_ms", "rows", "status", "error"]


def test_a_run_log_that_cannot_be_written_breaks_nothing(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    assert runlog.append_run_log(spark, str(tmp_path / "file"), [runlog.run_record("q", "t", "h", 1, 1)]) is False


def test_a_group_is_published_whole_or_not_at_all(spark, tmp_path):
    folder = str(tmp_path / "pub")
    group = publish.PublishGroup(spark, folder)
    group.stage("a", spark.range(1))
    group.stage("b", spark.range(2))
    group.stage("none", spark.range(0), "csv_plain")
    with pytest.raises(Exception):
        publish.published(spark, folder).collect()
    group.publish()
    assert {r.name for r in publish.published(spark, folder).collect()} == {"a", "b"}
    lost = publish.PublishGroup(spark, folder)
    lost.stage("a", spark.range(9))
    lost.discard()
    lost.publish()
    assert publish.read_published(spark, folder, "a").count() == 1
    newer = publish.PublishGroup(spark, folder)
    newer.stage("a", spark.range(4))
    newer.publish()
    assert publish.read_published(spark, folder, "a").count() == 4
    with pytest.raises(ValueError, match="nothing is published"):
        publish.read_published(spark, folder, "zzz")


def test_report_files_are_sorted_by_run(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 10).cast("string").alias("run_id"), F.col("id").alias("seq"))
    runlog.sink_report(rows, str(tmp_path / "r"))
    runlog.sink_report(rows, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2000


def test_nan_and_infinity_are_written_as_python_prints_them(spark):
    table = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (0.5,)], "x double")
    from runweave.sinks.files import python_text

    assert {r[0] for r in table.select(python_text(table.x, table.schema["x"].dataType)).collect()} == {"nan", "inf", "-inf", "0.5"}


def test_of_one_name_staged_twice_the_later_output_wins(spark, tmp_path):
    from runweave.sinks.publish import PublishGroup, read_published

    group = PublishGroup(spark, str(tmp_path))
    for value in range(12):
        group.stage("twice", spark.createDataFrame([(value,)], "v int"))
    group.publish()
    assert read_published(spark, str(tmp_path), "twice").first().v == 11
