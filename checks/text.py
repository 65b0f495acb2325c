"""Text functions over documents, conversations and run tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import derived
from checks.derived import table
from runweave.functions import chunking, text as text_fn

_MESSAGES = {
    "F": "concat('step (psycopg2.errors.UndefinedTable) relation ', o_orderkey, ' does not exist  ', {nl}, 'LINE 1')",
    "O": "concat('psycopg2.OperationalError) could not connect to ', o_custkey)",
}


def _message(nl: str, pad: str) -> str:
    cases = " ".join(f"WHEN '{status}' THEN {text.format(nl=nl)}" for status, text in _MESSAGES.items())
    return f"CASE o_orderstatus {cases} ELSE concat(o_orderpriority, ' ', repeat('{pad}', 60), o_orderkey) END"


_ERROR_SPARK = _message("'\\n'", "no match ")
_ERROR_SQL = _message("chr(10)", "no match ")


def clean_error(spark, sf_dir):
    error = F.expr(_ERROR_SPARK)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text_fn.clean_error(error).alias("message"), text_fn.clean_error(error, summary=True).alias("summary"))


def tail_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(text_fn.tail_log(F.col("text")), "\n").alias("log_tail"),
        text_fn.tail_stderr(F.col("text"), 3).alias("stderr_tail"))


def chunk_text_header(spark, sf_dir):
    header = text_fn.alert_header(F.concat(F.lit("Document "), "doc_id"), F.col("source"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(chunking.chunk_text_header(header, F.col("text"))).alias("chunk_no", "chunk"))


def chunk_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(chunking.chunk_text(F.col("text"))).alias("chunk_no", "chunk"))


def escape_markup(spark, sf_dir):
    """Documents as they are, and with every bold or code mark a text can hold around its first line."""
    doc = F.col("text")
    first = F.substring_index(doc, "\n", 1)
    marked = F.concat(F.lit("**"), first, F.lit("** and `"), first, F.lit("` or ** open ` "), doc)
    return table(spark, sf_dir, "documents").select(
        "doc_id", text_fn.escape_markup(doc).alias("escaped"), text_fn.escape_markup(marked).alias("marked"))


def format_timestamps(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select(
        "event_id", text_fn.file_stamp(ts).alias("file_stamp"), text_fn.iso_seconds(ts).alias("iso"), text_fn.plain_stamp(ts).alias("plain"))


def failure_body(spark, sf_dir):
    steps = derived.steps(spark, sf_dir).withColumn(
        "error", F.expr("concat('(psycopg2.errors.X) step ', seq, ' has no table', '\\n', type)"))
    sql_hash = F.when(F.col("file").isNotNull(), F.left(F.sha2("sql_text", 256), F.lit(16)))
    return steps.select("manifest", "seq", text_fn.failure_body(
        F.col("name"), F.col("file"), F.col("transaction_group"), F.col("joined_group"), sql_hash, F.col("error")).alias("body"))


def hash_value(spark, sf_dir):
    """Hash values differ between engines, equality does not: distinct hashes per class."""
    hashed = table(spark, sf_dir, "orders").select("o_orderpriority", text_fn.hash_value(F.col("o_custkey"), F.col("o_orderstatus")).alias("h"))
    return hashed.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.countDistinct("h").alias("hashes"))


QUERIES = {
    "clean_error": clean_error,
    "tail_lines": tail_lines,
    "chunk_text_header": chunk_text_header,
    "chunk_text": chunk_text,
    "escape_markup": escape_markup,
    "format_timestamps": format_timestamps,
    "failure_body": failure_body,
    "hash_value": hash_value,
}

_BLANK = "concat(' ', chr(9), chr(10), chr(13))"


def _chunks_sql(text: str, first: str, later: str, limit: int) -> str:
    """Greedy cuts by recursion: a piece ends at the last newline that fits, else where the room ends."""
    return f"""
        WITH RECURSIVE docs AS (SELECT doc_id, {first} AS first, {later} AS later, {text} AS body FROM documents),
        cuts AS (
          SELECT doc_id, -1 AS chunk_no, '' AS chunk, first, later, body AS rest FROM docs
          UNION ALL
          SELECT doc_id, chunk_no + 1, concat(prefix, left(rest, cut)), first, later, ltrim(substring(rest, cut + 1), chr(10))
          FROM (
            SELECT *, CASE WHEN length(rest) <= room THEN length(rest)
                           WHEN length(rtrim_line) <= 1 THEN room ELSE length(rtrim_line) - 1 END AS cut
            FROM (SELECT *, regexp_extract(left(rest, room), '(?s)\\A(.*\\n)', 1) AS rtrim_line
                  FROM (SELECT *, {limit} - length(prefix) AS room
                        FROM (SELECT *, CASE WHEN chunk_no < 0 THEN first ELSE later END AS prefix FROM cuts WHERE rest <> ''))))
        )
        SELECT doc_id, chunk_no, chunk FROM cuts WHERE chunk_no >= 0"""


_TOKENS = r"(?s)\*\*.*?\*\*|`[^`]*`|[^*`]+|[*`]"
_SPECIAL = r"([_*\[\]()~`>#+\-=|{}.!])"


def _escaped_sql(text: str) -> str:
    return rf"""array_to_string(list_transform(regexp_extract_all({text}, '{_TOKENS}'), lambda t:
        CASE WHEN length(t) >= 4 AND starts_with(t, '**') AND ends_with(t, '**')
             THEN concat('*', regexp_replace(substring(t, 3, length(t) - 4), '{_SPECIAL}', '\\\1', 'g'), '*')
             WHEN length(t) >= 2 AND starts_with(t, '`') THEN t
             ELSE regexp_replace(t, '{_SPECIAL}', '\\\1', 'g') END), '')"""


ORACLE = {
    "clean_error": f"""
        SELECT o_orderkey,
               CASE o_orderstatus WHEN 'F' THEN concat('relation ', o_orderkey, ' does not exist')
                    WHEN 'O' THEN concat('could not connect to ', o_custkey) ELSE left(e, 300) END AS message,
               CASE o_orderstatus WHEN 'F' THEN concat('relation ', o_orderkey, ' does not exist') ELSE left(e, 500) END AS summary
        FROM (SELECT *, {_ERROR_SQL} AS e FROM orders)""",
    "tail_lines": f"""
        SELECT doc_id,
               array_to_string(list_transform(string_split(trim(text, {_BLANK}), chr(10))[-5:], lambda x: left(x, 120)), chr(10)) AS log_tail,
               array_to_string(string_split(CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10))[-3:], chr(10)) AS stderr_tail
        FROM documents""",
    "chunk_text_header": _chunks_sql(
        "text", "concat('**Document ', doc_id, '** (by ', source, ')', chr(10), chr(10))",
        "concat('**Document ', doc_id, '** (by ', source, ') (cont.)', chr(10), chr(10))", 2000),
    "chunk_text": _chunks_sql("text", "''", "''", 4096),
    "escape_markup": f"""
        SELECT doc_id, {_escaped_sql("text")} AS escaped, {_escaped_sql("marked_text")} AS marked
        FROM (SELECT *, concat('**', first, '** and `', first, '` or ** open ` ', text) AS marked_text
              FROM (SELECT *, string_split(text, chr(10))[1] AS first FROM documents))""",
    "format_timestamps": """
        SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS file_stamp, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso,
               strftime(ts, '%Y-%m-%d %H:%M:%S') AS plain FROM events""",
    "failure_body": f"""
        SELECT manifest, seq, concat('**Step:** `', name, '`', chr(10), '**File:** `', coalesce(file, 'unknown'), '`',
          CASE WHEN coalesce(transaction_group, joined_group) IS NOT NULL
               THEN concat(chr(10), '**Group:** `', coalesce(transaction_group, joined_group), '`') ELSE '' END,
          CASE WHEN file IS NOT NULL THEN concat(chr(10), '**SQL hash:** `', substring(sha256(sql_text), 1, 16), '`') ELSE '' END,
          chr(10), '**Error:** step ', seq, ' has no table') AS body
        FROM ({derived.STEPS_SQL}) s""",
    "hash_value": """
        SELECT o_orderpriority, count(*) AS n, count(DISTINCT (o_custkey, o_orderstatus)) AS hashes FROM orders GROUP BY o_orderpriority""",
}
