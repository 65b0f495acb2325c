import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runweave.functions import chunking, text


@pytest.mark.parametrize("error, message", [
    ("(psycopg2.errors.UndefinedTable) relation \"x\" does not exist \nLINE 1", 'relation "x" does not exist'),
    ("boom (psycopg2.errors.X)   \n  late", "late"),
    ("psycopg2.OperationalError) bad host\n", "bad host"),
    ("e" * 400, "e" * 300),
    ("short", "short"),
])
def test_clean_error(one, error, message):
    assert one(text.clean_error, e=error) == message


def test_clean_error_of_the_summary(one):
    summary = lambda e: text.clean_error(e, summary=True)
    assert one(summary, e="e" * 600) == "e" * 500
    assert one(summary, e="psycopg2.OperationalError) bad host") == "psycopg2.OperationalError) bad host"


@pytest.mark.parametrize("source", ["a\nb\r\nc\rd\x0be f", "a\nb\n", "a\n\n", "", "one"])
def test_tail_stderr_is_splitlines(one, source):
    assert one(lambda t: text.tail_stderr(t, 2), t=source) == "\n".join(source.splitlines()[-2:])


def test_tail_log(one):
    source = "\n" + "\n".join(f"{i} " + "x" * 200 for i in range(9)) + "\n\n"
    assert one(text.tail_log, t=source) == [line[:120] for line in source.strip().split("\n")[-5:]]
    assert one(text.tail_log, t="a\nb") == ["a", "b"]


def python_escape(s):
    """What the markup rules say, character by character."""
    out, i = [], 0
    plain = lambda t: "".join("\\" + c if c in text.MARKUP_SPECIAL else c for c in t)
    while i < len(s):
        mark = next((m for m in ("**", "`") if s.startswith(m, i) and s.find(m, i + len(m)) >= 0), None)
        if mark:
            end = s.find(mark, i + len(mark))
            inner = s[i + len(mark):end]
            out.append(f"*{plain(inner)}*" if mark == "**" else f"`{inner}`")
            i = end + len(mark)
        else:
            out.append(plain(s[i]))
            i += 1
    return "".join(out)


def test_escape_markup_cases(one):
    assert one(text.escape_markup, t="hello (world) [test]!") == r"hello \(world\) \[test\]\!"
    assert one(text.escape_markup, t="**important** thing") == "*important* thing"
    assert one(text.escape_markup, t="see `step_name` for") == "see `step_name` for"
    assert one(text.escape_markup, t="a\\b") == "a\\b"


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="*`_a.\n ", max_size=25), min_size=1, max_size=30))
def test_escape_markup_agrees_with_the_rules(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for row in df.select("i", text.escape_markup(F.col("t")).alias("e")).collect():
        assert row.e == python_escape(texts[row.i])


def test_messages(one):
    assert one(lambda s: text.chat_message(s, F.lit("b"), F.lit("u.v")), s="S!") == "*S\\!*\n\nb\n\n_— u\\.v_"
    assert one(lambda s: text.alert_header(s, F.lit("me")), s="S") == "**S** (by me)"
    assert one(lambda s: text.alert_header(s, F.lit("me"), F.lit("7")), s="S") == "<@7> **S** (by me)"


def test_failure_body(one):
    body = lambda g, j, f, h: one(lambda n: text.failure_body(n, *[F.lit(v).cast("string") for v in (f, g, j, h, "bad")]), n="load")
    assert body("1", "j", "a.sql", "abc") == "**Step:** `load`\n**File:** `a.sql`\n**Group:** `1`\n**SQL hash:** `abc`\n**Error:** bad"
    assert body(None, "j", None, None) == "**Step:** `load`\n**File:** `unknown`\n**Group:** `j`\n**Error:** bad"
    assert body("", None, "", "") == "**Step:** `load`\n**File:** `unknown`\n**Error:** bad"


def test_time_formats(spark):
    ts = F.lit("2024-01-02 03:04:05.678").cast("timestamp_ntz")
    row = spark.range(1).select(text.file_stamp(ts), text.iso_seconds(ts), text.plain_stamp(ts)).first()
    assert tuple(row) == ("20240102_030405", "2024-01-02T03:04:05", "2024-01-02 03:04:05")



def test_chunk_text(one):
    assert one(chunking.chunk_text, t="hello") == ["hello"]
    assert one(chunking.chunk_text, t="") == [""]
    big = one(chunking.chunk_text, t="line\n" * 2000)
    assert len(big) > 1 and all(len(c) <= 4096 for c in big)
    assert "".join(big).replace("\n", "") == "line" * 2000
    assert [len(c) for c in one(chunking.chunk_text, t="x" * 9000)] == [4096, 4096, 808]
    # a newline at the very start is no place to cut
    assert [len(c) for c in one(chunking.chunk_text, t="\n" + "y" * 4096)] == [4096, 1]


def test_chunk_text_with_header(one):
    split = lambda b: chunking.chunk_text_header(F.lit("**S** (by u)"), b)
    assert one(split, b="") == ["**S** (by u)\n\n"]
    assert one(split, b="x") == ["**S** (by u)\n\nx"]
    parts = one(split, b="word " * 1000 + "\n" + "tail")
    assert all(len(p) <= 2000 for p in parts)
    assert parts[0].startswith("**S** (by u)\n\n") and all(p.startswith("**S** (by u) (cont.)\n\n") for p in parts[1:])
    bodies = [p.split("\n\n", 1)[1] for p in parts]
    assert "".join(bodies).replace("\n", "") == "word " * 1000 + "tail"


def test_header_without_room_is_an_error(spark):
    df = spark.createDataFrame([("h" * 2000, "body")], "h string, b string")
    with pytest.raises(Exception, match="leaves no room"):
        df.select(chunking.chunk_text_header(F.col("h"), F.col("b"))).collect()


def test_chunks_are_made_a_slice_at_a_time():
    import pyarrow as pa

    from runweave.functions import chunking

    texts = pa.array([None if i % 7 == 0 else "x" * i for i in range(2 * chunking.ROWS + 3)])
    got = chunking._in_slices(lambda h, b: [h, b], pa.array(["h"] * len(texts)), texts)
    assert got.to_pylist() == [None if t is None else ["h", t] for t in texts.to_pylist()]
    assert chunking._in_slices(lambda t: [t], pa.array([], pa.string())).to_pylist() == []
