"""CSV with line breaks inside quotes, read by many tasks.

A quoted field may hold line breaks, so where a record starts depends on all quotes before it. The file is read as lines by
byte ranges, as Spark splits any text. A line starts a record when the number of quotes before it is even:

1. Within a byte range a running sum over its lines tells the parity of quotes, counted from the start of the range.
2. One row for each range (parity, and how many records start in it under either parity before it) goes through a window
   over the file: a prefix XOR of the parities, and a prefix sum of the starts.
3. Joined back, they tell each line its record. A record of one line is complete where it is; only lines of records with
   line breaks are put together, where their byte range is; those that cross the end of one by file and record number. `from_csv` parses the records.

Quotes must be as RFC 4180 has them: a field with a quote is quoted, and quotes inside are doubled. A file that leaves a quote
open has one last record from there on, as for any reader. Blank lines between records are skipped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Every line with its file, byte range (`range_start`) and a number that rises within the range."""
    lines = spark.read.option("lineSep", "\n").text(list(paths))
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range_start"),
        F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))


def records(lines: DataFrame) -> DataFrame:
    """Records of `numbered_lines`: `file`, `record` (from 1 in each file) and its `text` with the line breaks inside."""
    ordered = Window.partitionBy("file", "range_start").orderBy("n")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    counted = lines.withColumn("quotes", F.regexp_count("line", F.lit('"')))
    local = (
        counted.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
        # How many records have started in the range up to this line, if it starts outside quotes, or inside.
        .withColumn("even", F.sum(1 - F.col("inside")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("odd", F.sum("inside").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    )
    files = Window.partitionBy("file").orderBy("range_start")
    earlier = files.rowsBetween(Window.unboundedPreceding, -1)
    summed = (
        local.groupBy("file", "range_start").agg(
            F.sum("quotes").alias("quotes"), F.max("even").alias("even"), F.max("odd").alias("odd"))
        .withColumn("open", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
        .withColumn("starts", F.when(F.col("open") == 0, F.col("even")).otherwise(F.col("odd")))
        .select("file", "range_start", "open", F.coalesce(F.sum("starts").over(earlier), F.lit(0)).alias("records"),
                "starts", ((F.col("open") + F.col("quotes")) % 2 == 1).alias("goes_on"))
    )
    record = F.col("records") + F.when(F.col("open") == 0, F.col("even")).otherwise(F.col("odd"))
    crosses = (F.col("open") == 1) & (record == F.col("records")) | F.col("goes_on") & (record == F.col("records") + F.col("starts"))
    placed = local.join(summed, ["file", "range_start"]).select(
        "file", "range_start", "n", "line", record.alias("record"), crosses.alias("crosses"),
        ((F.col("inside") + F.col("open") + F.col("quotes")) % 2 == 1).alias("open_after"),
        ((F.col("inside") + F.col("open")) % 2 == 1).alias("open_before"),
    )
    whole = ~F.col("open_before") & ~F.col("open_after")
    # Dealt by range already: only what crosses the end of a range is dealt anew, a record or two for each range.
    parts = placed.where(~whole).groupBy("file", "range_start", "record", "crosses").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("n", "line")))["line"], "\n").alias("text"))
    crossing = parts.where("crosses").groupBy("file", "record").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("range_start", "text")))["text"], "\n").alias("text"))
    return placed.where(whole).select("file", "record", F.col("line").alias("text")).unionByName(
        parts.where(~F.col("crosses")).select("file", "record", "text")).unionByName(crossing)


def scan_csv_quoted(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """CSV with a header in each file and line breaks in quotes, every value text; a missing value reads as empty text."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    options = {"escape": '"', "multiLine": "true"}
    # Reads the first record of one file.
    schema = spark.read.options(header=True, inferSchema=False, **options).csv(paths).schema
    if not schema.fields:
        return spark.createDataFrame([], schema)
    text = F.rtrim("text", F.lit("\r"))
    rows = records(numbered_lines(spark, paths)).where("record > 1").select(text.alias("text")).where("text <> ''")
    kinds = ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema)
    return rows.select(F.from_csv("text", F.lit(kinds), options).alias("row")).select("row.*").na.fill("")
