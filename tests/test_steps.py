import pytest
from pyspark.sql import functions as F

from runweave.operators import grouping, jobs, steps

STEP_SCHEMA = (
    "manifest string, seq bigint, name string, type string, enabled boolean, description string, file string, sql_id string, "
    "transaction_group string, joined_group string, joined_glue string, cleanup_target string, cleanup_mode string, "
    "notify boolean, duration double, sql_text string"
)


@pytest.fixture(scope="module")
def make(spark):
    def build(*given):
        default = dict(manifest="m", type="sql", enabled=True, cleanup_mode="drop", notify=False, duration=1.0)
        fields = [part.split()[0] for part in STEP_SCHEMA.split(", ")]
        rows = []
        for i, values in enumerate(given, 1):
            full = {**dict.fromkeys(fields), **default, "seq": i, "name": f"s{i}", **values}
            rows.append(tuple(full[f] for f in fields))
        return spark.createDataFrame(rows, STEP_SCHEMA)

    return build


@pytest.mark.parametrize("raw, problem", [
    ({"name": "x", "type": "sql"}, None),
    ({"name": "x", "type": "sql", "fielo": "1", "abc": "2"}, "unknown keys abc, fielo"),
    ({"type": "sql"}, "missing required name"),
    ({"name": "x"}, "missing required type"),
    ({"name": "x", "type": "selectish"}, "type selectish is not one of bulk_insert, manifest, plsql, psql, python, sql"),
    ({"name": "x", "type": "sql", "joined_glue": "weird"}, "joined_glue must be one of raw, statement, got weird"),
    ({"name": "x", "type": "sql", "joined_glue": None}, None),
    ({"name": "x", "type": "sql", "cleanup_mode": "explode"}, "cleanup_mode must be one of drop, truncate, got explode"),
    ({"name": "x", "type": "sql", "file": "a", "sql_id": "b"}, "set either file or sql_id, not both"),
    ({"name": "x", "type": "sql", "file": "", "sql_id": "b"}, None),
])
def test_validate_steps(spark, raw, problem):
    df = spark.createDataFrame([("m", 1, raw)], "manifest string, seq bigint, raw map<string,string>")
    found = steps.validate_steps(df).collect()
    assert [r.problem for r in found] == ([problem] if problem else [])


def test_violations_come_in_checking_order(spark):
    raw = {"zzz": "1", "type": "nope", "file": "a", "sql_id": "b"}
    df = spark.createDataFrame([("m", 1, raw)], "manifest string, seq bigint, raw map<string,string>")
    found = steps.validate_steps(df).orderBy("rule_no").collect()
    assert [r.rule_no for r in found] == [1, 2, 3, 4]
    assert found[0].problem.startswith("unknown") and found[1].problem == "missing required name"


def test_typed_steps_defaults(spark):
    raw = [("m", 1, {"name": "x", "type": "sql"}),
           ("m", 2, {"name": "y", "type": "sql", "enabled": "false", "transaction_group": "0", "joined_group": "", "params": '{"a": "1"}'})]
    first, second = steps.typed_steps(spark.createDataFrame(raw, "manifest string, seq bigint, raw map<string,string>")).orderBy("seq").collect()
    assert first.enabled and first.params == {} and first.cleanup_mode == "drop" and not first.profile and not first.notify
    assert not second.enabled and second.transaction_group is None and second.joined_group is None and second.params == {"a": "1"}


def test_catalog(spark, make):
    catalog = spark.createDataFrame([("load", "scripts/load.sql")], "sql_id string, file string")
    table = make({"sql_id": "load"}, {"file": "own.sql"}, {"sql_id": "missing"})
    got = {r.seq: (r.file, r.sql_id) for r in steps.resolve_sql_ids(table, catalog).collect()}
    assert got == {1: ("scripts/load.sql", None), 2: ("own.sql", None), 3: (None, "missing")}
    assert [r.sql_id for r in steps.unresolved_sql_ids(table, catalog).collect()] == ["missing"]


def test_validate_catalog(spark):
    rows = [("x", "a.sql"), ("x", "b.sql"), (None, "c.sql"), ("y", None), ("z", "z.sql")]
    found = steps.validate_catalog(spark.createDataFrame(rows, "sql_id string, file string")).collect()
    assert sorted((r.problem, r.sql_id, r.entries) for r in found if r.sql_id) == [("duplicate id", "x", 2), ("missing file", "y", 1)]
    assert [(r.problem, r.entries) for r in found if r.sql_id is None] == [("missing id", 1)]


def test_variants(spark):
    files = spark.createDataFrame([("d/01 - a b.sql",), ("d/c.sql",), ("e.sql",), ("f g.sql",), ("none.sql",)], "file string")
    index = spark.createDataFrame([
        ("postgres-pipeline/schemas/01 - a b.sql",), ("postgres-pipeline/01_a_b.sql",), ("postgres-pipeline/schemas/c.sql",),
        ("duckdb-pipeline/e.sql",), ("postgres-pipeline/schemas/f_g.sql",), ("postgres-pipeline/other/none.sql",)], "path string")
    got = {r.file: r.resolved for r in steps.resolve_variants(files, index, "postgresql+psycopg2").collect()}
    assert got == {
        "d/01 - a b.sql": "postgres-pipeline/01_a_b.sql", "d/c.sql": "postgres-pipeline/schemas/c.sql",
        "e.sql": "e.sql", "f g.sql": "postgres-pipeline/schemas/f_g.sql", "none.sql": "none.sql"}
    for dialect in ("oracle+oracledb", "", "unknown"):
        assert all(r.file == r.resolved for r in steps.resolve_variants(files, index, dialect).collect())


def test_expand_manifests(make):
    table = make(
        {"manifest": "top", "seq": 1, "name": "a"}, {"manifest": "top", "seq": 2, "type": "manifest", "file": "kid"},
        {"manifest": "top", "seq": 3, "name": "z"}, {"manifest": "kid", "seq": 1, "name": "k1"},
        {"manifest": "kid", "seq": 2, "type": "manifest", "file": "leaf"}, {"manifest": "kid", "seq": 3, "name": "off", "enabled": False},
        {"manifest": "leaf", "seq": 1, "name": "l1"})
    in_order = [(r.name, r.path) for r in steps.expand_manifests(table, "top").orderBy("path").collect()]
    assert in_order == [("a", [1]), ("k1", [2, 1]), ("l1", [2, 2, 1]), ("z", [3])]
    assert steps.expand_manifests(table, "top", enable_all=True).count() == 5


def test_expand_rejects_a_cycle(make):
    table = make({"manifest": "a", "type": "manifest", "file": "b"}, {"manifest": "b", "type": "manifest", "file": "a"})
    with pytest.raises(ValueError, match="includes itself"):
        steps.expand_manifests(table, "a")


def test_plan_listing(make):
    table = make(
        {"type": "psql", "joined_group": "j", "transaction_group": "1"}, {"type": "psql", "joined_group": "j", "description": "fused"},
        {"transaction_group": "1", "description": ""}, {"transaction_group": "1"},
        {"name": "solo", "cleanup_target": "T", "cleanup_mode": "truncate", "description": "d"}, {"name": "last"})
    lines = [r.line for r in grouping.plan_listing(table).orderBy("item_no").collect()]
    assert lines == [
        "[1] JOINED 'j' (2 psql steps fused)\n     fused", "[2] GROUP 1 (2 steps)",
        "[3] SQL: solo - Cleanup(truncate): T\n     d", "[4] SQL: last", "--- 4 tasks (6 steps) ---"]


def test_group_durations(make):
    table = make(
        {"transaction_group": "1", "duration": 1.5}, {"transaction_group": "1", "joined_group": "j", "duration": 2.0},
        {"duration": 3.0}, {"duration": 4.0}, {"transaction_group": "1", "duration": 0.25})
    rows = grouping.group_durations(table).withColumn("line", grouping.summary_line(
        *[F.col(c) for c in ("task_no", "transaction_group", "first_step", "steps", "seconds")])).orderBy("task_no").collect()
    assert [r.line for r in rows] == [
        "Task 1 - Group 1 (2 steps) - time taken: 3.50s", "Task 2 - s3 - time taken: 3.00s",
        "Task 3 - s4 - time taken: 4.00s", "Task 4 - Group 1 (1 steps) - time taken: 0.25s"]


def test_even_split(spark, make):
    table = make({"joined_group": "j"}, {"joined_group": "j"}, {"joined_group": "j"}, {"joined_group": "k"}).drop("duration")
    walls = spark.createDataFrame([("j", 6.0), ("k", 5.0)], "joined_group string, wall double")
    got = {r.seq: r.duration for r in grouping.even_split(table, walls, ["joined_group"]).collect()}
    assert got == {1: 2.0, 2: 2.0, 3: 2.0, 4: 5.0}


def test_alerts_are_strict(make):
    table = make(
        {"duration": 5.0}, {"duration": 5.01}, {"notify": True}, {"joined_group": "a", "duration": 2.5}, {"joined_group": "a", "duration": 2.5},
        {"joined_group": "b", "duration": 2.5}, {"joined_group": "b", "duration": 2.75})
    assert sorted(r.seq for r in grouping.alerting_steps(table).collect()) == [2, 3]
    assert [(r.joined_group, r.seconds) for r in grouping.alerting_groups(table).collect()] == [("b", 5.25)]


def test_fuse_fragments(make):
    table = make(
        {"type": "psql", "joined_group": "a", "sql_text": "SELECT 1;"}, {"type": "psql", "joined_group": "a", "sql_text": "SELECT 2; \n"},
        {"sql_text": "alone"}, {"type": "psql", "joined_group": "b", "joined_glue": "raw", "sql_text": "WITH x AS"},
        {"type": "psql", "joined_group": "b", "joined_glue": "statement", "sql_text": "(SELECT 1) SELECT * FROM x;"})
    whole = {r.joined_group: r.sql_text for r in grouping.fuse_fragments(table).collect()}
    assert whole == {"a": "SELECT 1\n;\n\nSELECT 2\n;", "b": "WITH x AS\n(SELECT 1) SELECT * FROM x;"}
    cut = grouping.fuse_fragments(table, segment_rows=1).orderBy("segment").collect()
    assert cut[0].joint.join(r.sql_text for r in cut if r.joined_group == "a") == whole["a"]
    assert cut[-1].joint.join(r.sql_text for r in cut if r.joined_group == "b") == whole["b"]


def test_fragment_rows_make_the_whole_text(make):
    table = make(*[{"type": "psql", "joined_group": "long", "joined_glue": "raw" if i else None, "sql_text": f"S{i};"} for i in range(300)],
                 *[{"type": "psql", "joined_group": "r", "joined_glue": "raw", "sql_text": t} for t in ("a", "b")])
    texts = {}
    for r in grouping.fragment_rows(table).orderBy("seq").collect():
        texts[r.joined_group] = texts.get(r.joined_group, "") + r.joint + r.piece
    assert texts == {"long": "\n\n".join(f"S{i}\n;" for i in range(300)), "r": "a\nb"}
    assert {r.joined_group: r.sql_text for r in grouping.fuse_fragments(table).collect()} == texts


def test_mixed_groups(make):
    table = make({"type": "psql", "joined_group": "ok"}, {"type": "psql", "joined_group": "bad"}, {"type": "sql", "joined_group": "bad"})
    assert [(r.joined_group, r.types) for r in grouping.mixed_groups(table).collect()] == [("bad", ["psql", "sql"])]


def test_resume(spark, make):
    log = spark.createDataFrame([
        ("m", 1, "2024-01-01T00:00:00", "done"), ("m", 2, "2024-01-01T00:00:00", "done"), ("m", 2, "2024-01-02T00:00:00", "error"),
        ("m", 3, "2024-01-01T00:00:00", "error"), ("m", 3, "2024-01-01T00:00:00", "done"), ("other", 4, "2024-01-01T00:00:00", "done")],
        "manifest string, seq bigint, ts string, status string")
    table = make({}, {}, {}, {}, {"enabled": False})
    assert sorted(r.seq for r in jobs.resume_pending(table, log).collect()) == [2, 4]


def test_job_status(spark):
    table = spark.createDataFrame([(i, f"2024-01-0{i}", i == 1) for i in range(1, 8)], "job_id int, started string, alive boolean")
    lines = spark.createDataFrame([
        (1, 1, "CRITICAL x"), (2, 1, "fine"), (3, 1, "step failed after 3 retries"), (7, 1, "a"), (7, 2, "b" * 200), (7, 3, "CRITICAL")],
        "job_id int, line_no int, line string")
    got = {r.job_id: r.status for r in jobs.job_status(table, lines).collect()}
    assert got == {1: "RUNNING", 2: "FINISHED", 3: "FAILED", 4: "FINISHED", 5: "FINISHED", 6: "FINISHED", 7: "FAILED"}
    assert sorted(r.job_id for r in jobs.job_status(table, lines, newest=5).collect()) == [3, 4, 5, 6, 7]
    tail = jobs.latest_log_lines(table, lines, n=2).orderBy("line_no").collect()
    assert [r.line for r in tail] == ["b" * 120, "CRITICAL"]
