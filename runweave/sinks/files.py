"""File writers. A path is a folder that every task writes its own part to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def python_text(column: Column, kind: T.DataType) -> Column:
    """The value as Python prints it: `True`, six digits of a second or none, and plain digits where
    Java uses an exponent. Null stays null."""
    text = column.cast("string")
    if isinstance(kind, T.BooleanType):
        return F.initcap(text)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        return F.when(F.date_format(column, "SSSSSS") == "000000", whole).otherwise(F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        size = F.abs(column)
        digits = lambda scale: F.regexp_replace(text.cast(f"decimal(38,{scale})").cast("string"), r"(\.\d+?)0+\z", "$1")
        exponent = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), r"E(\d)", "e+$1"), "E-", "e-")
        return (
            F.when((size >= 1e7) & (size < 1e16), digits(17))
            .when((size >= 1e-4) & (size < 1e-3), digits(22))
            .when(F.isnan(column), "nan")
            .when(size == float("inf"), F.when(column > 0, "inf").otherwise("-inf"))
            .when((size >= 1e16) | ((size < 1e-4) & (size > 0)), F.regexp_replace(exponent, r"e([+-])(\d)\z", "e$10$2"))
            .otherwise(text)
        )
    return text


def sink_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header in every part and quotes only where they are needed; blanks are kept."""
    plain = (T.StringType, T.IntegralType)
    texts = [
        F.col(f"`{f.name}`") if isinstance(f.dataType, plain) else python_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name)
        for f in df.schema
    ]
    (
        df.select(texts).write.mode(mode)
        .option("header", True).option("escape", '"').option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def sink_csv_plain(df: DataFrame, path: str, mode: str = "overwrite") -> bool:
    """Comma-joined text without quoting, the header as the first part; writes nothing without rows."""
    if df.isEmpty():
        return False
    values = [F.coalesce(python_text(F.col(f"`{f.name}`"), f.dataType), F.lit("None")) for f in df.schema]
    line = reduce(lambda left, right: F.concat(left, F.lit(","), right), values)
    header = df.sparkSession.range(1, numPartitions=1).select(F.lit(",".join(df.columns)).alias("value"))
    header.unionAll(df.select(line.alias("value"))).write.mode(mode).text(path)
    return True


def sink_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)
