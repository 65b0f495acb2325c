"""Query requests that arrive as JSON lines."""

from __future__ import annotations

from datetime import datetime
from itertools import batched

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from runweave.functions.sqltext import WHITESPACE, trim_blank
from runweave.runs.query import run_sql
from runweave.sources.files import read_sql_file
from runweave.sources.targets import Targets

REQUEST_SCHEMA = (
    "id string, cmd string, sql_file string, target string, output string, `limit` string, _corrupt_record string"
)
RESPONSE_SCHEMA = "id bigint, ok boolean, rows bigint, error string"
ANSWER_SCHEMA = "id_json string, ok boolean, rows bigint, error string"
STOP_SCHEMA = "batch bigint, stopped_at timestamp, file_time timestamp, file string, range_start bigint, n bigint"
# Error texts that clients recognise.
BAD_JSON = "ERROR: bad request JSON: "
INCOMPLETE = "ERROR: request needs 'sql_file', 'target', and 'output'"
BAD_LIMIT = "ERROR: limit is no whole number: "
# Values of a limit that ask for none.
NO_LIMIT = ("", "0", "false")
# Where a line stands: files by the time they were written and their path, lines by byte range and place.
POSITION = ("file_time", "file", "range_start", "n")
# Answers the driver holds before it writes them.
ANSWERS_PER_FILE = 500


def request_lines(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Stream of request lines from files that land in a folder, with file, time of the file and byte range."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("file_time"),
        F.col("_metadata.file_block_start").alias("range_start"))


def classify_requests(lines: DataFrame) -> DataFrame:
    """Request columns per non-blank line, with `kind` (run, shutdown, error), the `error` text and `id_json`, the id as it
    was sent, whatever JSON value it is; `id` is its number, if it is one. Position columns pass through."""
    request = F.from_json(
        F.col("_line"), REQUEST_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    empty = lambda name: F.coalesce(F.col(name), F.lit("")) == ""
    sent = F.try_parse_json("_line")
    bad = F.col("_corrupt_record").isNotNull()
    stop = ~bad & F.coalesce(F.col("cmd") == "shutdown", F.lit(False))
    limit = F.when(~F.coalesce("limit", F.lit("")).isin(*NO_LIMIT), F.try_variant_get(sent, "$.limit", "bigint"))
    unreadable = ~F.coalesce("limit", F.lit("")).isin(*NO_LIMIT) & F.col("_number").isNull()
    error = (
        F.when(bad, F.concat(F.lit(BAD_JSON), F.col("_line")))
        .when(~stop & (empty("sql_file") | empty("target") | empty("output")), F.lit(INCOMPLETE))
        .when(~stop & unreadable, F.concat(F.lit(BAD_LIMIT), F.col("limit")))
    )
    where = [c for c in POSITION if c in lines.columns]
    return (
        lines.select(trim_blank(F.col("value")).alias("_line"), *where).where("_line != ''")
        .withColumn("_request", request).select("_line", *where, "_request.*")
        .withColumn("id_json", F.when(~bad, F.to_json(F.try_variant_get(sent, "$.id", "variant"))))
        .withColumn("id", F.when(~bad, F.col("id").try_cast("bigint")))
        .withColumn("_number", limit)
        .withColumn("error", error)
        .withColumn("limit", F.col("_number"))
        .withColumn("kind", F.when(stop, "shutdown").when(F.col("error").isNotNull(), "error").otherwise("run"))
        .drop("_line", "_corrupt_record", "cmd", "_number")
    )


def responses_of_errors(requests: DataFrame) -> DataFrame:
    """Answers to requests that cannot run."""
    return requests.where("kind = 'error'").select(
        "id_json", F.lit(False).alias("ok"), F.lit(0).cast("long").alias("rows"), "error")


def write_classified(lines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Classify a stream of lines into Parquet, once per line also after a restart."""
    return (
        classify_requests(lines).drop(*POSITION).writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def write_responses(answers: DataFrame, path: str) -> None:
    """One JSON object a line; the id stands there as it was sent."""
    rest = F.to_json(F.struct("ok", "rows", "error"), {"ignoreNullFields": "false"})
    line = F.concat(F.lit('{"id":'), F.coalesce("id_json", F.lit("null")), F.lit(","), F.substring(rest, 2, 1 << 30))
    answers.select(line.alias("value")).write.mode("overwrite").text(path)


def answer_request(spark: SparkSession, request, targets: Targets) -> tuple:
    """Run one request and write its CSV; a failure becomes the answer's error text."""
    try:
        sql = read_sql_file(spark, request["sql_file"]).strip(WHITESPACE).removesuffix(";").strip(WHITESPACE)
        result = run_sql(spark, sql, target=request["target"], targets=targets, limit=request["limit"])
        record = result.to_csv(request["output"])
        return request["id_json"], True, record["rows"], None
    except Exception as exc:
        message = f"SQL file not found: {request['sql_file']}" if "PATH_NOT_FOUND" in str(exc) and request["sql_file"] in str(exc) else str(exc)
        return request["id_json"], False, 0, f"ERROR: {message}"


def _stops(spark: SparkSession, responses: str) -> list:
    """Where earlier batches were told to stop; one row for each shutdown request that cut a batch."""
    try:
        return spark.read.schema(STOP_SCHEMA).json(f"{responses}/_stop/*").collect()
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return []


def _behind(stop) -> Column:
    """Lines that were there when the stop was handled and stand behind the shutdown request."""
    here, there = F.struct(*POSITION), F.struct(*[F.lit(stop[c]).alias(c) for c in POSITION])
    return (here > there) & (F.col("file_time") <= F.lit(stop["stopped_at"]))


def serve_requests(
    spark: SparkSession, folder: str, responses: str, checkpoint: str, targets: Targets, max_files: int | None = None
) -> StreamingQuery:
    """Answer every request in the folder, then stop. One response file set per micro-batch.

    A shutdown request, with or without an id, cuts by position: what stands behind it in its file, and every later file
    that was there when it was handled, is not answered, in this batch, in later ones and after a restart. Its position is
    kept below the responses before the batch is answered. Files that are written after it are a new session's.
    Requests run in the order of their positions; each answer carries the id as it was sent. A batch that is run again after a
    failure cuts at the same place and overwrites its own responses.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        # Lines of one byte range are numbered in the order in which they are read.
        requests = classify_requests(batch.withColumn("n", F.monotonically_increasing_id())).persist()
        stops = _stops(spark, responses)
        earlier = [s for s in stops if s["batch"] < batch_id]
        live = requests
        for stop in earlier:
            live = live.where(~_behind(stop))
        own = [s for s in stops if s["batch"] == batch_id]
        first = None if own else live.where("kind = 'shutdown'").orderBy(*POSITION).select(*POSITION).first()
        if first is not None:
            stop = (batch_id, datetime.now(), *first)
            row = spark.createDataFrame([stop], STOP_SCHEMA)
            row.coalesce(1).write.mode("overwrite").json(f"{responses}/_stop/batch-{batch_id}")
            own = row.collect()
        for stop in own:
            live = live.where(~_behind(stop))
        out = f"{responses}/batch={batch_id}"
        write_responses(responses_of_errors(live), f"{out}/kind=error/slice=0")
        queue = live.where("kind = 'run'").orderBy(*POSITION).toLocalIterator()
        for i, part in enumerate(batched(queue, ANSWERS_PER_FILE)):
            answers = [answer_request(spark, request, targets) for request in part]
            write_responses(spark.createDataFrame(answers, ANSWER_SCHEMA).coalesce(1), f"{out}/kind=run/slice={i}")
        requests.unpersist()

    return (
        request_lines(spark, folder, max_files).writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_responses(spark: SparkSession, responses: str, id_type: str = "bigint") -> DataFrame:
    """All answers; with `id_type` "string" ids of any kind, numbers and objects as their JSON text."""
    schema = RESPONSE_SCHEMA.replace("id bigint", f"id {id_type}")
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(f"{responses}/batch=*").select("id", "ok", "rows", "error")
