"""Run the steps of a manifest in order.

The driver walks the steps of one manifest, which a person wrote; the data each step touches stays
on the executors. Steps that share a group publish their outputs together.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from itertools import count, groupby
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from runweave.functions.sqltext import PLACEHOLDER_REGEX, WHITESPACE
from runweave.functions.text import failure_body
from runweave.operators.grouping import RAW_JOINT, STATEMENT_JOINT, plan_listing
from runweave.operators.jobs import resume_pending
from runweave.operators.steps import (
    CatalogError, dialect_folder, resolve_sql_ids, resolve_variants, typed_steps, unresolved_sql_ids, validate_catalog, validate_steps)
from runweave.plans.report import report_rows
from runweave.runs.measure import Measured, measured
from runweave.runs.query import hash_text, run_script
from runweave.sinks.publish import PublishGroup
from runweave.sinks.runlog import ERROR_CHARS, append_json, append_run_log, sink_report
from runweave.sinks.tables import drop_table, truncate_table
from runweave.sources.files import read_sql_file, scan_catalog, scan_manifests

STEP_LOG_SCHEMA = (
    "manifest string, seq bigint, name string, type string, `group` string, "
    "duration double, ts string, status string, error string"
)
REPORT_TASK_SCHEMA = (
    "run_id string, task_no bigint, task_name string, db_type string, duration_ms double, db_cpu_ms double, db_io_ms double, "
    "parallel_degree int, plan_content string, rendered_sql string"
)

# Plan text of steps that have no plan of their own.
NO_PLAN = "(profiling disabled for this step)"
FUSED_PLAN = "(part of joined_group '{}', {} fragments)"

# Name of the catalog beside a manifest, seconds from which a completion is told unasked, and message texts.
CATALOG_FILE = "sql-catalog.yaml"
TOLD_SECONDS = 5
STEP_COMPLETED = ("Step Completed", "Step '{}' completed in {:.2f}s.{}")
GROUP_COMPLETED = ("Joined Group Completed", "joined_group '{}' ({} steps) completed in {:.2f}s.")
JOB_FINISHED = ("Job Finished", "Job finished successfully.\n\n**Total Duration:** {:.2f}s\n\n**Executed tasks:**\n{}")
JOB_FAILED = ("Job Failed", "Job execution stopped.\n\n**Failed Step:** {}\n**Total Duration:** {:.2f}s\n\n**Executed tasks:**\n{}"
                            "\n\n**Failed at:** `{}`\n**Error:** {}")

#: Messages of a run name so many flaws, and say how many there are.
NAMED_FLAWS = 10


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    """Typed steps of a YAML manifest; the first broken rule raises. `manifest` is the path as given."""
    raw = scan_manifests(spark, path).withColumn("manifest", F.lit(path))
    broken = validate_steps(raw).orderBy("seq", "rule_no").first()
    if broken is not None:
        raise ValueError(f"{path}, step {broken['seq']}: {broken['problem']}")
    return typed_steps(raw)


class StepFailed(RuntimeError):
    """A step of a manifest failed; `failed_step` names it and `body` is the alert text."""

    def __init__(self, failed_step: str, cause: Exception, body: str, error: str | None = None) -> None:
        super().__init__(f"step {failed_step!r} failed: {cause}")
        self.failed_step = failed_step
        self.body = body
        self.error = str(cause)[:ERROR_CHARS] if error is None else error


def _summary(records: list[dict[str, Any]]) -> str:
    """A numbered line per step that ran, or per run of steps of one group, with its seconds."""
    alone = count()
    lines = []
    for label, unit in groupby(records, key=lambda r: ("group", r["group"]) if r["group"] is not None else ("step", next(alone))):
        unit = list(unit)
        title = f"Group {label[1]} ({len(unit)} steps)" if label[0] == "group" else unit[0]["name"]
        lines.append(f"Task {len(lines) + 1} - {title} - time taken: {sum(r['duration'] for r in unit):.2f}s")
    return "\n".join(lines) or "None"


def render_sql(text: str, params: Mapping[str, Any] | None) -> str:
    """Fill `{{ name }}` in one SQL text, as `render_template` does for a column of them."""
    if not params:
        return text
    source = re.sub(r"\n\Z", "", re.sub(r"\r\n?", "\n", text))
    return re.sub(PLACEHOLDER_REGEX, lambda m: str(params.get(m.group(1), "")), source)


def fuse_sql(texts: list[str], glue: str | None) -> str:
    """One SQL text from the fragments of a fused group."""
    if glue == "raw":
        return RAW_JOINT.join(texts)
    if glue not in (None, "statement"):
        raise ValueError(f"unknown joined_glue {glue!r}")
    return STATEMENT_JOINT.join(t.rstrip(WHITESPACE).rstrip(";") + "\n;" for t in texts)


@dataclass
class StepRunner:
    """Where steps read SQL from, what python steps may call, and where outputs and records go.

    `sql_texts` maps a file name to its text; other names are read as files. A python step names a
    function in `functions`, called with the session and the step's params; a DataFrame it returns
    is an output of the step.

    With `dialect`, a SQL step reads the dialect's translation of its file where `sql_texts` or the folder `variants_dir`
    has one. `tell`, if given, is called with subject and text when a slow or marked step, a fused group or the run ends.
    """

    spark: SparkSession
    publish_dir: str
    log_dir: str
    sql_texts: Mapping[str, str] = field(default_factory=dict)
    functions: Mapping[str, Callable[..., DataFrame | None]] = field(default_factory=dict)
    catalog: DataFrame | None = None
    dialect: str | None = None
    variants_dir: str | None = None
    tell: Callable[[str, str], None] | None = None
    report_dir: str | None = None
    report_tasks: list[dict[str, Any]] = field(default_factory=list)
    run_id: str = field(default_factory=lambda: time.strftime("%Y%m%d_%H%M%S"))

    def run(self, steps: DataFrame, manifest: str, enable_all: bool = False) -> list[dict[str, Any]]:
        """Run what is enabled and not logged as done; returns the records of the steps that ran.

        With `report_dir`, the report rows of the run are appended there, also when a step fails.
        """
        ran: list[dict[str, Any]] = []
        start = time.monotonic()
        try:
            for records in self._run(steps, manifest, enable_all):
                ran += records
            self._tell(JOB_FINISHED, time.monotonic() - start, _summary(ran))
            return ran
        except StepFailed as exc:
            self._tell(JOB_FAILED, exc.failed_step, time.monotonic() - start, _summary(ran), exc.failed_step, exc.error)
            raise
        finally:
            if self.report_dir and self.report_tasks:
                tasks = self.spark.createDataFrame(self.report_tasks, REPORT_TASK_SCHEMA)
                sink_report(report_rows(tasks, "task_no"), self.report_dir)
                self.report_tasks = []

    def listing(self, steps: DataFrame, manifest: str, enable_all: bool = False) -> DataFrame:
        """What `run` would do now, as lines: catalog and step log are read, no step runs."""
        pending = self._pending(steps, manifest, enable_all)
        return plan_listing(pending if "description" in pending.columns else pending.withColumn("description", F.lit(None).cast("string")))

    def _run(self, steps: DataFrame, manifest: str, enable_all: bool) -> Iterator[list[dict[str, Any]]]:
        for unit in self._units(list(self._pending(steps, manifest, enable_all).orderBy("seq").toLocalIterator())):
            yield self._run_unit(steps, unit, enable_all)

    # A group is a run of steps with one joined label, else one transaction label; a step with
    # neither is a group of its own.
    def _units(self, queue: list[Row]) -> list[list[Row]]:
        alone = count()
        label = lambda s: ("joined", s["joined_group"]) if s["joined_group"] else (
            ("group", s["transaction_group"]) if s["transaction_group"] else ("step", next(alone)))
        return [list(unit) for _, unit in groupby(queue, key=label)]

    def _pending(self, steps: DataFrame, manifest: str, enable_all: bool) -> DataFrame:
        own = steps.where(F.col("manifest") == manifest)
        if self.catalog is not None:
            flaws = validate_catalog(self.catalog)
            self._refuse("catalog", flaws.select(F.concat_ws(" ", "problem", "sql_id").alias("flaw")))
            lost = unresolved_sql_ids(own, self.catalog)
            self._refuse("sql_id not found in catalog", lost.select(F.col("sql_id").alias("flaw")).distinct())
            own = resolve_sql_ids(own, self.catalog)
        if self.dialect and dialect_folder(self.dialect):
            own = self._translated(own, dialect_folder(self.dialect))
        return own if enable_all else resume_pending(own, self._step_log())

    def _refuse(self, what: str, flaws: DataFrame) -> None:
        """Raise where there are flaws, naming the first and telling how many there are."""
        named = sorted(row["flaw"] for row in flaws.orderBy("flaw").limit(NAMED_FLAWS).collect())
        if named:
            total = len(named) if len(named) < NAMED_FLAWS else flaws.count()
            raise CatalogError(f"{what}: {named}" + (f" and {total - len(named)} more" if total > len(named) else ""))

    def _translated(self, own: DataFrame, folder: str) -> DataFrame:
        """Steps with the file that holds the dialect's translation, where there is one."""
        index = self.spark.createDataFrame([(name,) for name in self.sql_texts], "path string")
        if self.variants_dir:
            root = f"{self.variants_dir.rstrip('/')}/{folder}"
            try:
                found = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
            except AnalysisException as exc:
                if exc.getCondition() != "PATH_NOT_FOUND":
                    raise
            else:
                # What follows the last place of the folder's name is the path inside it.
                index = index.unionByName(found.select(F.concat(F.lit(f"{folder}/"), F.substring_index("path", f"/{folder}/", -1)).alias("path")))
        at = F.col("resolved")
        if self.variants_dir:
            in_texts = at.isin(*self.sql_texts) if self.sql_texts else F.lit(False)
            at = F.when(in_texts | at.eqNullSafe(F.col("file")), at).otherwise(F.concat(F.lit(f"{self.variants_dir.rstrip('/')}/"), at))
        file = F.when(F.col("type").isin("python", "manifest"), F.col("file")).otherwise(at)
        return resolve_variants(own, index, self.dialect).withColumn("file", file).drop("resolved")

    def _step_log(self) -> DataFrame:
        try:
            return self.spark.read.schema(STEP_LOG_SCHEMA).json(self.log_dir)
        except Exception as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            return self.spark.createDataFrame([], STEP_LOG_SCHEMA)

    def _run_unit(self, steps: DataFrame, unit: list[Row], enable_all: bool) -> list[dict[str, Any]]:
        outputs = PublishGroup(self.spark, self.publish_dir)
        records, step = [], unit[0]
        try:
            if step["joined_group"]:
                records = self._run_joined(unit, outputs)
            else:
                for step in unit:
                    start = time.monotonic()
                    self._run_step(steps, step, outputs, enable_all)
                    records.append(self._record(step, time.monotonic() - start))
                    more = step.asDict()
                    if more.get("notify") or records[-1]["duration"] > TOLD_SECONDS:
                        about = f"\n{more['description']}" if more.get("description") else ""
                        self._tell(STEP_COMPLETED, step["name"], records[-1]["duration"], about)
            outputs.publish()
        except Exception as exc:
            outputs.discard()
            inner = getattr(exc, "failed_step", None)
            failed = self._record(step, 0.0, "error", str(exc)[:ERROR_CHARS])
            append_run_log(self.spark, self.log_dir, [failed], STEP_LOG_SCHEMA)
            raise StepFailed(inner or step["name"], exc, self._failure_body(step, exc), getattr(exc, "error", None)) from exc
        # Resuming relies on these rows, so a failure to write them is an error.
        append_json(self.spark.createDataFrame(records, STEP_LOG_SCHEMA).coalesce(1), self.log_dir)
        return records

    def _run_joined(self, unit: list[Row], outputs: PublishGroup) -> list[dict[str, Any]]:
        label = unit[0]["joined_group"]
        types = sorted({s["type"] for s in unit})
        if types != ["psql"]:
            raise RuntimeError(f"joined_group {label!r} must contain only psql steps, got {types}")
        for step in unit:
            self._cleanup(step)
        text = fuse_sql([render_sql(self._read(s["file"]), s["params"]) for s in unit], unit[0]["joined_glue"])
        took = self._run_text(text, unit[-1], outputs)
        share = took.duration_ms / 1000.0 / len(unit)
        for step in unit:
            self._report(step, took, FUSED_PLAN.format(label, len(unit)), text, len(unit))
        if took.duration_ms > TOLD_SECONDS * 1000.0:
            self._tell(GROUP_COMPLETED, label, len(unit), took.duration_ms / 1000.0)
        return [self._record(s, share) for s in unit]

    def _run_step(self, steps: DataFrame, step: Row, outputs: PublishGroup, enable_all: bool) -> None:
        self._cleanup(step)
        kind, file, params = step["type"], step["file"], step["params"]
        if kind == "manifest":
            as_file = file.endswith((".yaml", ".yml"))
            for _ in self._run(read_steps(self.spark, file) if as_file else steps, file, enable_all):
                pass
        elif kind == "python":
            if file not in self.functions:
                raise FileNotFoundError(f"Python function not found: {file}")
            result = self.functions[file](self.spark, **(params or {}))
            if result is not None:
                outputs.stage(step["output_file"] or step["name"], result, "parquet")
        else:
            text = render_sql(self._read(file), params)
            if kind == "bulk_insert":
                for statement in filter(None, (s.strip(WHITESPACE) for s in text.split(";"))):
                    self.spark.sql(statement)
                return
            took = self._run_text(text, step, outputs)
            self._report(step, took, took.plan or NO_PLAN if step.asDict().get("profile") else NO_PLAN, text)

    def _run_text(self, text: str, step: Row, outputs: PublishGroup) -> Measured:
        """Run a script; its last result is staged, or only run where the step is profiled and has no output."""
        if not self.report_dir:
            start = time.monotonic()
            self._run_script(text, step, outputs)
            return Measured(duration_ms=(time.monotonic() - start) * 1000.0)
        with measured(self.spark) as took:
            self._run_script(text, step, outputs)
        return took

    def _run_script(self, text: str, step: Row, outputs: PublishGroup) -> None:
        result = run_script(self.spark, text)
        if result is None or not result.columns:
            return
        if step["output_file"]:
            outputs.stage(step["output_file"], result, "csv_plain")
        elif self.report_dir and step.asDict().get("profile"):
            result.write.format("noop").mode("overwrite").save()

    def _report(self, step: Row, took: Measured, plan: str, text: str, steps: int = 1) -> None:
        """Note what a step took; steps that ran as one statement share it equally."""
        self.report_tasks.append({
            "run_id": self.run_id, "task_no": len(self.report_tasks) + 1, "task_name": step["name"], "db_type": "SPARK",
            "duration_ms": took.duration_ms / steps, "db_cpu_ms": took.db_cpu_ms / steps, "db_io_ms": took.db_io_ms / steps,
            "parallel_degree": took.parallel_degree, "plan_content": plan, "rendered_sql": text,
        })

    def _tell(self, message: tuple[str, str], *values: Any) -> None:
        if self.tell:
            self.tell(message[0], message[1].format(*values))

    def _cleanup(self, step: Row) -> None:
        target = step["cleanup_target"]
        if target and step["cleanup_mode"] == "truncate":
            truncate_table(self.spark, target)
        elif target:
            drop_table(self.spark, target)

    def _read(self, file: str) -> str:
        if file in self.sql_texts:
            return self.sql_texts[file]
        return read_sql_file(self.spark, file)

    def _record(self, step: Row, duration: float, status: str = "done", error: str | None = None) -> dict[str, Any]:
        return {
            "manifest": step["manifest"], "seq": step["seq"], "name": step["name"], "type": step["type"],
            "group": step["transaction_group"], "duration": duration,
            "ts": time.strftime("%Y-%m-%dT%H:%M:%S"), "status": status, "error": error,
        }

    def _failure_body(self, step: Row, exc: Exception) -> str:
        try:
            sql_hash = hash_text(self._read(step["file"])) if step["file"] and step["type"] != "python" else ""
        except Exception:
            sql_hash = ""
        values = (step["name"], step["file"], step["transaction_group"], step["joined_group"], sql_hash, str(exc))
        return self.spark.range(1).select(failure_body(*[F.lit(v).cast("string") for v in values])).first()[0]


def run_steps(
    spark: SparkSession, steps: DataFrame, manifest: str, publish_dir: str, log_dir: str, *, enable_all: bool = False, **how: Any
) -> list[dict[str, Any]]:
    """Run a manifest with a `StepRunner`."""
    return StepRunner(spark, publish_dir, log_dir, **how).run(steps, manifest, enable_all)


def beside_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The SQL catalog in the folder of a manifest, if there is one."""
    folder, _, _ = path.rpartition("/")
    try:
        return scan_catalog(spark, f"{folder}/{CATALOG_FILE}" if folder else CATALOG_FILE)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def run_manifest(
    spark: SparkSession, path: str, publish_dir: str, log_dir: str, *, enable_all: bool = False, dry_run: bool = False, **how: Any
) -> list[dict[str, Any]]:
    """Run a YAML manifest file, with the catalog beside it unless `catalog` names one.

    With `dry_run`, print what would run and run nothing.
    """
    how.setdefault("catalog", beside_manifest(spark, path))
    steps = read_steps(spark, path)
    if not dry_run:
        return run_steps(spark, steps, path, publish_dir, log_dir, enable_all=enable_all, **how)
    for row in StepRunner(spark, publish_dir, log_dir, **how).listing(steps, path, enable_all).orderBy("item_no").toLocalIterator():
        print(row["line"])
    return []


def apply_step(df: DataFrame, function: Callable[..., DataFrame], params: Mapping[str, Any] | None = None) -> DataFrame:
    """A python step over a table: a registered DataFrame function with the step's params."""
    return df.transform(function, **(params or {}))
