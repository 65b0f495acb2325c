import json
import os
from datetime import datetime, timedelta

from runweave.sources.files import scan_csv_strings
from runweave.streaming import jobs, requests


def serve(spark, tmp_path, lines, known, **how):
    folder = tmp_path / "in"
    folder.mkdir(exist_ok=True)
    (folder / f"{len(list(folder.iterdir()))}.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    query = requests.serve_requests(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "checkpoint"), known, **how)
    query.awaitTermination()
    return [tuple(r) for r in requests.read_responses(spark, str(tmp_path / "out")).orderBy("id").collect()]


def test_requests_are_answered_and_errors_never_stop_the_run(spark, tmp_path):
    spark.createDataFrame([(1, "açaí"), (2, "café")], "id int, name string").write.parquet(str(tmp_path / "db" / "t"))
    known = {"LOCAL": {"path": str(tmp_path / "db"), "tables": ["t"]}}
    sql = tmp_path / "q.sql"
    sql.write_text("SELECT id, name FROM t ORDER BY id ;\n", encoding="utf-8")
    ask = lambda **r: json.dumps({"sql_file": str(sql), "target": "LOCAL", "output": str(tmp_path / f"out{r['id']}"), **r})
    lines = [
        ask(id=1), ask(id=2, limit=1), "", "not json", ask(id=3, target="NOPE"), ask(id=4, sql_file="/no/such/file.sql"),
        json.dumps({"id": 5, "target": "LOCAL"}), json.dumps({"id": 7, "cmd": "shutdown"}), ask(id=8),
    ]
    answers = serve(spark, tmp_path, lines, known)
    by_id = {a[0]: a for a in answers}
    assert set(by_id) == {None, 1, 2, 3, 4, 5}
    assert by_id[1] == (1, True, 2, None) and by_id[2] == (2, True, 1, None)
    assert by_id[None][1:3] == (False, 0) and "bad request JSON" in by_id[None][3]
    assert all(by_id[i][3].startswith("ERROR: ") for i in (None, 3, 4, 5))
    assert "Unknown target" in by_id[3][3] and "not found" in by_id[4][3] and "needs" in by_id[5][3]
    rows = scan_csv_strings(spark, str(tmp_path / "out1")).collect()
    assert sorted((r.id, r.name) for r in rows) == [("1", "açaí"), ("2", "café")]
    # a second run answers only what is new
    assert len(serve(spark, tmp_path, [ask(id=9)], known)) == len(answers) + 1


def test_classified_stream_survives_a_restart(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    paths = (str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    for i, line in enumerate(['{"id": 1, "sql_file": "a", "target": "t", "output": "o", "limit": 5}', '{"id": 2}']):
        (folder / f"{i}.jsonl").write_text(line + "\n")
        requests.write_classified(requests.request_lines(spark, str(folder)), *paths).awaitTermination()
    rows = spark.read.parquet(paths[0]).orderBy("id").collect()
    assert [(r.id, r.kind, r.limit) for r in rows] == [(1, "run", 5), (2, "error", None)]


def local(spark, tmp_path):
    spark.createDataFrame([(1,), (2,), (3,)], "id int").write.mode("overwrite").parquet(str(tmp_path / "db" / "t"))
    sql = tmp_path / "q.sql"
    sql.write_text("SELECT id FROM t")
    known = {"LOCAL": {"path": str(tmp_path / "db"), "tables": ["t"]}}
    number = iter(range(1000))

    def ask(**r):
        return json.dumps({"sql_file": str(sql), "target": "LOCAL", "output": str(tmp_path / f"csv{next(number)}"), **r})

    return known, ask


def test_shutdown_cuts_by_position_without_an_id_and_over_restarts(spark, tmp_path):
    known, ask = local(spark, tmp_path)
    folder = tmp_path / "in"
    folder.mkdir()
    files = [[ask(id=50), ask(id=3)], [ask(id=2), '{"cmd": "shutdown"}', ask(id=1), "not json"], [ask(id=0)]]
    for i, lines in enumerate(files):
        (folder / f"{i}.jsonl").write_text("\n".join(lines) + "\n")
        os.utime(folder / f"{i}.jsonl", (1_700_000_000 + i, 1_700_000_000 + i))

    def run(batches=None):
        query = requests.serve_requests(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "checkpoint"), known, max_files=1)
        query.awaitTermination()
        return sorted(r.id for r in requests.read_responses(spark, str(tmp_path / "out")).collect())

    assert run() == [2, 3, 50]
    # A file that was there before the stop shows up only now: behind the request, so it stays unanswered.
    (folder / "9.jsonl").write_text(ask(id=7) + "\n")
    os.utime(folder / "9.jsonl", (1_700_000_009, 1_700_000_009))
    assert run() == [2, 3, 50]
    (folder / "later.jsonl").write_text(ask(id=8) + "\n" + '{"cmd": "shutdown", "id": 1}\n' + ask(id=9) + "\n")
    assert run() == [2, 3, 8, 50]


def test_any_id_is_echoed_and_bad_limits_fail(spark, tmp_path):
    known, ask = local(spark, tmp_path)
    lines = [ask(id="abc", limit=2), ask(id=1.5), ask(id={"a": [1, None]}), ask(id=None), ask(id=True, limit="1"), ask(id=6, limit="zz"),
             ask(id=7, limit=2.9), ask(id=8, limit=0), ask(id=9, limit=""), ask(id=10, limit=[1]), '{"id": "x", "target": "LOCAL"}']
    serve(spark, tmp_path, lines, known)
    got = {r.id: (r.ok, r.rows, r.error) for r in requests.read_responses(spark, str(tmp_path / "out"), "string").collect()}
    assert got == {
        "abc": (True, 2, None), "1.5": (True, 3, None), '{"a":[1,null]}': (True, 3, None), None: (True, 3, None), "true": (True, 1, None),
        "6": (False, 0, requests.BAD_LIMIT + "zz"), "7": (True, 2, None), "8": (True, 3, None), "9": (True, 3, None),
        "10": (False, 0, requests.BAD_LIMIT + "[1]"), "x": (False, 0, requests.INCOMPLETE)}
    assert '"id":"abc"' in "".join(p.read_text() for p in (tmp_path / "out").rglob("part-*"))


def test_live_job_status_follows_ends_late_lines_and_drops_state(spark, tmp_path):
    at = lambda second: datetime(2024, 1, 1) + timedelta(seconds=second)
    (tmp_path / "in").mkdir()
    changes = jobs.follow_jobs(jobs.job_events(spark, str(tmp_path / "in")), late="60 seconds")

    def run(*rows):
        spark.createDataFrame(rows, jobs.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = jobs.write_changes(changes, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        query.awaitTermination()
        held = query.lastProgress.stateOperators[0].numRowsTotal
        return {r.job_id: r.status for r in jobs.current_status(spark, str(tmp_path / "out")).collect()}, held

    got, _ = run((1, at(0), "start", False), (2, at(1), "CRITICAL x", None), (3, at(1), None, False), (None, at(1), "lost", True), (5, None, "lost", True))
    assert got == {1: "RUNNING", 2: "RUNNING", 3: "RUNNING"}
    got, held = run((1, at(10), None, True), (2, at(10), None, True), (3, at(10), "go on", False))
    assert got == {1: "FINISHED", 2: "FAILED", 3: "RUNNING"} and held == 3
    got, _ = run((1, at(9), "step failed after 3 retries", False))
    assert got[1] == "FAILED"
    # The watermark passes the ended jobs: only what runs is held, and what comes too late changes nothing.
    got, held = run((3, at(1000), "still here", False))
    assert got == {1: "FAILED", 2: "FAILED", 3: "RUNNING"} and held == 1
    got, held = run((2, at(5), "too late", False), (3, at(1001), None, True), (3, at(1001), None, True))
    assert got == {1: "FAILED", 2: "FAILED", 3: "FINISHED"} and held == 1
    versions = [(r.job_id, r.version) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("job_id", "version").collect()]
    assert versions == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (3, 1), (3, 2)]
