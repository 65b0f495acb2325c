import hashlib
import re

import pytest
from hypothesis import given, settings, HealthCheck
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runweave.functions import sqltext


@pytest.mark.parametrize("sql, keyword, ddl", [
    ("SELECT 1", "", False),
    ("WITH x AS (SELECT 1) SELECT * FROM x", "", False),
    ("  -- comment\n  SELECT * FROM t", "", False),
    ("DROP TABLE foo", "DROP", True),
    ("INSERT INTO t VALUES (1)", "INSERT", False),
    ("update t SET x=1", "update", False),
    ("-- comentário\nCREATE TABLE foo (a INT)", "CREATE", True),
    ("TRUNCATE TABLE foo", "TRUNCATE", True),
    ("COPY foo TO '/tmp/x.csv'", "", True),
    ("/* c */ DROP TABLE foo", "", False),
    ("SELECT 1; DROP TABLE t", "", False),
    ("SELECT dropped FROM t\nDROPPED", "", False),
    ("SELECT 1\r  DROP TABLE t", "", False),
    ("SELECT 1\n\t call p()", "call", False),
])
def test_guard_and_ddl(one, sql, keyword, ddl):
    assert one(sqltext.guard_keyword, q=sql) == keyword
    assert one(sqltext.is_ddl, q=sql) is ddl


def test_guard_reads_a_run_of_empty_lines_once(one):
    assert one(sqltext.guard_keyword, q="SELECT 1" + "\n" * 300_000 + " drop") == "drop"
    assert one(sqltext.guard_keyword, q="SELECT 1" + "\n" * 300_000 + "x") == ""


def test_ddl_after_a_long_comment_header(one):
    assert one(sqltext.is_ddl, q="-- note\n" * 50_000 + "CREATE TABLE t (a INT)") is True
    assert one(sqltext.is_ddl, q="-- note\n" * 50_000 + "SELECT 1") is False


def test_whitespace_is_what_python_strips():
    assert sqltext.WHITESPACE == "".join(c for c in map(chr, range(0x110000)) if c.isspace())


@pytest.mark.parametrize("sql, single, every", [
    ("SELECT 1;", "SELECT 1", "SELECT 1"),
    (" SELECT 1 ; ; ", "SELECT 1 ;", "SELECT 1 ; "),
    ("SELECT 1;;;", "SELECT 1;;", "SELECT 1"),
    (" SELECT 1 ", "SELECT 1", "SELECT 1"),
    (";", "", ""),
    ("", "", ""),
])
def test_strip_terminator(one, sql, single, every):
    assert one(sqltext.strip_terminator, q=sql) == single
    assert one(lambda q: sqltext.strip_terminator(q, every=True), q=sql) == every


def test_split_statements_keeps_order_and_drops_empties(one):
    assert one(sqltext.split_statements, q=" a ;; b\n; ; 'x;y' ") == ["a", "b", "'x", "y'"]


def test_sql_hash_is_the_python_prefix(one):
    assert one(sqltext.sql_hash, q="SELECT 'é'") == hashlib.sha256("SELECT 'é'".encode()).hexdigest()[:16]


@pytest.mark.parametrize("text, params, expected", [
    ("a {{ x }} b {{y}}", {"x": "1", "y": "2"}, "a 1 b 2"),
    ("{{ x }}", {"x": "{{ y }}", "y": "2"}, "{{ y }}"),
    ("[{{ lost }}]", {"x": "1"}, "[]"),
    ("{{ x }}", {"x": None}, "None"),
    ("a {{ x }}\n", None, "a {{ x }}\n"),
    ("a {{ x }}\n", {}, "a {{ x }}\n"),
    ("a\r\nb\n\n", {"x": "1"}, "a\nb\n"),
    ("{{x}}{{x}}", {"x": "$1\\"}, "$1\\$1\\"),
])
def test_render_template(spark, text, params, expected):
    df = spark.createDataFrame([(text, params)], "t string, p map<string,string>")
    assert df.select(sqltext.render_template(F.col("t"), F.col("p"))).first()[0] == expected


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=" \n\r\t;-'aDROPdrop x", max_size=30), min_size=1, max_size=20))
def test_guard_and_split_agree_with_python(spark, texts):
    guard = re.compile(rf"^\s*({'|'.join(sqltext.GUARDED_KEYWORDS)})\b", re.I | re.M)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", sqltext.guard_keyword(F.col("t")).alias("k"), sqltext.split_statements(F.col("t")).alias("s")).collect()
    for row in rows:
        match = guard.search(texts[row.i])
        assert row.k == (match.group(1) if match else "")
        assert row.s == [p.strip() for p in texts[row.i].split(";") if p.strip()]


def test_template_names_of_any_script(one):
    assert one(lambda sql: sqltext.render_template(sql, F.create_map(F.lit("região"), F.lit("7"))), sql="SELECT {{ região }}") == "SELECT 7"
