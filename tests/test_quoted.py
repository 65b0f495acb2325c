"""CSV with line breaks in quotes: the same rows whether one task reads a file or many do."""

import csv
import random
from collections import Counter

import pytest

from runweave.sources.files import scan_csv_strings
from runweave.sources.quoted import numbered_lines, records, scan_csv_quoted

RANGE = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def ranges(spark):
    """Sets the bytes that a task reads."""
    before, cost = spark.conf.get(RANGE), spark.conf.get("spark.sql.files.openCostInBytes")

    def set_to(size):
        spark.conf.set(RANGE, size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)

    yield set_to
    spark.conf.set(RANGE, before)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)


def write(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as out:
        csv.writer(out, lineterminator=end).writerows(rows)


def random_rows(seed, n):
    rng = random.Random(seed)
    value = lambda: rng.choice(["", "plain", 'say "hi"', "two\nlines", "a\n\n\nb", ",", '"', '""\n"', "çã ö", "x" * 40, "\n", "end\n"])
    return [[str(i), value(), value()] for i in range(n)]


@pytest.mark.parametrize("size", ["1", "37", "200", "1m"])
def test_same_rows_in_ranges_of_any_size(spark, tmp_path, ranges, size):
    folder = tmp_path / "csv"
    folder.mkdir()
    rows = random_rows(1, 120), random_rows(2, 5), []
    for i, part in enumerate(rows):
        write(folder / f"f{i}.csv", [["id", "a b", "c"], *part])
    ranges("1m")
    multi = Counter(map(tuple, scan_csv_strings(spark, str(folder)).collect()))
    ranges(size if size != "1" else "16")
    got = scan_csv_quoted(spark, str(folder))
    assert got.columns == ["id", "a b", "c"]
    assert Counter(map(tuple, got.collect())) == multi == Counter(tuple(r) for part in rows for r in part)
    if size == "37":
        assert numbered_lines(spark, [str(folder / "f0.csv")]).rdd.getNumPartitions() > 20


def test_records_longer_than_a_range_and_broken_headers(spark, tmp_path, ranges):
    path = str(tmp_path / "one.csv")
    write(path, [["h\n1", "h2"], ["1", "\n".join("long line %d" % i for i in range(60))], ["2", 'x"y'], ["3", "\n" * 50]])
    ranges("64")
    got = {r[0]: r[1] for r in scan_csv_quoted(spark, path).collect()}
    assert got == {"1": "\n".join("long line %d" % i for i in range(60)), "2": 'x"y', "3": "\n" * 50}
    assert sorted(r["record"] for r in records(numbered_lines(spark, [path])).collect() if r["text"]) == [1, 2, 3, 4]


def test_other_line_ends_blank_lines_and_empty_files(spark, tmp_path, ranges):
    ranges("32")
    path = tmp_path / "w.csv"
    write(path, [["a", "b"], ["1", "x\r\ny"], ["2", ""], ["3", "z"]], "\r\n")
    assert sorted(map(tuple, scan_csv_quoted(spark, str(path)).collect())) == [("1", "x\r\ny"), ("2", ""), ("3", "z")]
    blank = tmp_path / "blank.csv"
    blank.write_text('a,b\n\n1,"p\n\nq"\n\n\n2\n')
    assert sorted(map(tuple, scan_csv_quoted(spark, str(blank)).collect())) == [("1", "p\n\nq"), ("2", "")]
    (tmp_path / "open.csv").write_text('a,b\n1,2\n3,"never closed\n4,5\n')
    assert ("1", "2") in [tuple(r) for r in scan_csv_quoted(spark, str(tmp_path / "open.csv")).collect()]
    (tmp_path / "none.csv").write_text("")
    assert scan_csv_quoted(spark, str(tmp_path / "none.csv")).collect() == []


def test_only_records_across_ranges_are_dealt_by_record(spark, tmp_path, ranges):
    path = str(tmp_path / "one.csv")
    write(path, random_rows(3, 200))
    ranges("200")
    plan = records(numbered_lines(spark, [path]))._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.split("\n") if "hashpartitioning(file" in line and "record#" in line]
    assert dealt and not any("range_start" in line for line in dealt) and "crosses" in plan
    multi = records(numbered_lines(spark, [path])).where("text like '%\n%'").count()
    assert multi == sum(any("\n" in v for v in row) for row in random_rows(3, 200))
