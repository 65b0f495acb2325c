"""Column functions over messages and log text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runweave.functions.sqltext import trim_blank

# Driver error prefixes, characters the chat markup reserves, line ends of str.splitlines() besides newline.
ERROR_CLASS_REGEX = r"(?dU)\(psycopg2\.errors\.\w+\)\s*(.+?)(?:\n|$)"
ERROR_DRIVER_REGEX = r"(?dU)psycopg2\.\w+\)\s*(.+?)(?:\n|$)"
MARKUP_SPECIAL = "_*[]()~`>#+-=|{}.!"
OTHER_LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"

MARKUP_SPECIAL_REGEX = "([" + "".join("\\" + c for c in MARKUP_SPECIAL) + "])"
MARKUP_TOKEN_REGEX = r"(?s)\*\*.*?\*\*|`[^`]*`|[^*`]+|[*`]"


def clean_error(error: Column, summary: bool = False) -> Column:
    """The message part of a database error, or its first 300 characters.

    The job summary form knows one prefix only and keeps 500 characters.
    """
    found = lambda regex: F.when(error.rlike(regex), trim_blank(F.regexp_extract(error, regex, 1)))
    if summary:
        return F.coalesce(found(ERROR_CLASS_REGEX), F.left(error, F.lit(500)))
    return F.coalesce(found(ERROR_CLASS_REGEX), found(ERROR_DRIVER_REGEX), F.left(error, F.lit(300)))


def tail_stderr(text: Column, n: int = 60) -> Column:
    """Last `n` lines joined by newline; a closing line end opens no extra line."""
    lines = F.translate(F.replace(text, F.lit("\r\n"), F.lit("\n")), OTHER_LINE_ENDS, "\n" * len(OTHER_LINE_ENDS))
    closed = F.when(F.endswith(lines, F.lit("\n")), F.left(lines, F.length(lines) - 1)).otherwise(lines)
    return F.substring_index(closed, "\n", -n)


def tail_log(text: Column, n: int = 5, width: int = 120) -> Column:
    """Last `n` lines of a log as an array, each cut to `width` characters."""
    tail = F.substring_index(trim_blank(text), "\n", -n)
    return F.transform(F.split(tail, "\n", -1), lambda line: F.left(line, F.lit(width)))


def escape_special(text: Column) -> Column:
    return F.regexp_replace(text, MARKUP_SPECIAL_REGEX, r"\\$1")


def escape_markup(text: Column) -> Column:
    """Escape reserved characters, turn `**b**` into `*b*` and leave code spans alone."""
    token_text = lambda t: (
        F.when((F.length(t) >= 4) & F.startswith(t, F.lit("**")) & F.endswith(t, F.lit("**")),
               F.concat(F.lit("*"), escape_special(F.substr(t, F.lit(3), F.length(t) - 4)), F.lit("*")))
        .when((F.length(t) >= 2) & F.startswith(t, F.lit("`")), t)
        .otherwise(escape_special(t))
    )
    tokens = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(MARKUP_TOKEN_REGEX), F.lit(0)), token_text), "")
    marked = F.contains(text, F.lit("**")) | F.contains(text, F.lit("`"))
    return F.when(marked, tokens).otherwise(escape_special(text))


def chat_message(subject: Column, body: Column, user: Column) -> Column:
    """A whole marked-up message: bold subject, escaped body, signature."""
    return F.concat(
        F.lit("*"), escape_special(subject), F.lit("*\n\n"), escape_markup(body),
        F.lit("\n\n_— "), escape_special(user), F.lit("_"),
    )


def alert_header(subject: Column, user: Column, ping: Column | None = None) -> Column:
    """Header line of a plain alert, with the mention first when one is given."""
    title = F.concat(F.lit("**"), subject, F.lit("** (by "), user, F.lit(")"))
    if ping is None:
        return title
    return F.concat(F.when(F.coalesce(ping, F.lit("")) != "", F.concat(F.lit("<@"), ping, F.lit("> "))).otherwise(""), title)


def file_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def plain_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def failure_body(
    name: Column, file: Column, transaction_group: Column, joined_group: Column, sql_hash: Column, error: Column
) -> Column:
    """Body of a failed-step alert; group and hash lines appear only when there is something to show."""
    some = lambda c: F.when(c != "", c)
    line = lambda label, value: F.coalesce(F.concat(F.lit(f"\n**{label}:** `"), some(value), F.lit("`")), F.lit(""))
    return F.concat(
        F.lit("**Step:** `"), name, F.lit("`\n**File:** `"), F.coalesce(some(file), F.lit("unknown")), F.lit("`"),
        line("Group", F.coalesce(some(transaction_group), joined_group)),
        line("SQL hash", sql_hash),
        F.lit("\n**Error:** "), clean_error(error),
    )


def hash_value(*columns: Column) -> Column:
    """64-bit hash of the values; equal rows get equal hashes."""
    return F.xxhash64(*columns)
