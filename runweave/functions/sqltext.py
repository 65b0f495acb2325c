"""Column functions over SQL text: guards, templates, splitting and hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statement keywords of the read-only guard and of the DDL test.
GUARDED_KEYWORDS = (
    "CREATE", "DROP", "ALTER", "TRUNCATE", "INSERT", "UPDATE", "DELETE",
    "MERGE", "GRANT", "REVOKE", "EXEC", "EXECUTE", "CALL",
)
DDL_KEYWORDS = (
    "CREATE", "DROP", "ALTER", "TRUNCATE", "GRANT", "REVOKE",
    "COPY", "VACUUM", "ANALYZE", "COMMENT", "REFRESH",
)

# The characters that Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# `d` keeps "\n" the only line end, `U` makes \s and \b follow Unicode. Blanks are taken within the
# keyword's own line, so a long run of empty lines is read once.
GUARD_REGEX = rf"(?imdU)^[^\S\n]*+({'|'.join(GUARDED_KEYWORDS)})\b"
# Possessive quantifiers keep the match iterative, so a long comment header cannot overflow the stack.
DDL_REGEX = rf"(?iU)\A\s*+(?:--[^\n]*+\n\s*+)*+(?:{'|'.join(DDL_KEYWORDS)})\b"
PLACEHOLDER_REGEX = r"\{\{\s*(\w+)\s*\}\}"
# Java needs the flag for names in any script, Python reads them so.
COLUMN_PLACEHOLDER_REGEX = f"(?U){PLACEHOLDER_REGEX}"


def trim_blank(text: Column) -> Column:
    """Remove white space of any script at both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def guard_keyword(sql: Column) -> Column:
    """First guarded keyword that starts a line, as written; empty string when the text is read-only."""
    return F.regexp_extract(sql, GUARD_REGEX, 1)


def is_ddl(sql: Column) -> Column:
    """Whether the statement after leading `--` comments is DDL or a utility command."""
    return sql.rlike(DDL_REGEX)


def render_template(text: Column, params: Column) -> Column:
    """Fill `{{ name }}` from a map column in one pass, so values are never expanded again.

    Unbound names become empty. Text without params stays as it is.
    """
    source = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\n\z", "")
    names = F.concat(
        F.regexp_extract_all(source, F.lit(COLUMN_PLACEHOLDER_REGEX), F.lit(1)), F.array(F.lit(None).cast("string"))
    )
    value = lambda name: F.when(F.map_contains_key(params, name), F.coalesce(F.try_element_at(params, name), F.lit("None")))
    pieces = F.zip_with(
        F.split(source, COLUMN_PLACEHOLDER_REGEX, -1),
        names,
        lambda piece, name: F.concat(piece, F.when(name.isNull(), "").otherwise(F.coalesce(value(name), F.lit("")))),
    )
    return F.when(F.coalesce(F.size(params), F.lit(0)) > 0, F.array_join(pieces, "")).otherwise(text)


def strip_terminator(sql: Column, every: bool = False) -> Column:
    """Trim, and drop the closing `;`: one of them with the blanks before it, or every one."""
    body = trim_blank(sql)
    if every:
        return F.rtrim(body, F.lit(";"))
    return F.when(F.endswith(body, F.lit(";")), trim_blank(F.left(body, F.length(body) - 1))).otherwise(body)


def fragment_body(sql: Column) -> Column:
    """A fragment without its closing blanks and `;`, ready to be joined to the next one."""
    return F.rtrim(F.rtrim(sql, F.lit(WHITESPACE)), F.lit(";"))


def sql_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the UTF-8 text or the bytes."""
    return F.left(F.sha2(text, 256), F.lit(16))


def split_statements(sql: Column) -> Column:
    """Statements in order. The split is textual: a `;` inside quotes splits too."""
    return F.filter(F.transform(F.split(sql, ";", -1), trim_blank), lambda s: s != "")
