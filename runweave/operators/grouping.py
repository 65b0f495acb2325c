"""Consecutive groups of steps: run items, listings, durations, alerts and fused SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runweave.functions.sqltext import fragment_body
from runweave.operators.ordering import BLOCK_ROWS, consecutive_runs

# Fixed value: seconds above which a step or fused group is reported.
ALERT_SECONDS = 5

STATEMENT_JOINT = "\n\n"
RAW_JOINT = "\n"


def _item_label() -> Column:
    """Joined label first, then transaction label; the kind is part of the label."""
    return F.when(F.col("joined_group").isNotNull(), F.concat(F.lit("joined:"), F.col("joined_group"))).otherwise(
        F.concat(F.lit("group:"), F.col("transaction_group")))


def consecutive_groups(steps: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add the plan item of each step: `item_no` and `item_kind` (joined, group or step)."""
    kind = F.when(F.col("joined_group").isNotNull(), "joined").when(F.col("transaction_group").isNotNull(), "group").otherwise("step")
    return (
        consecutive_runs(steps, ["manifest"], "seq", _item_label(), out="item_no", block_rows=block_rows)
        .withColumn("item_kind", kind)
        .drop("run_start")
    )


def plan_listing(steps: DataFrame) -> DataFrame:
    """Dry-run lines per manifest: one per plan item, then a total (`item_no` one past the last)."""
    shown = F.when(F.col("description") != "", F.col("description"))
    items = consecutive_groups(steps).groupBy("manifest", "item_no", "item_kind").agg(
        F.count("*").alias("steps"),
        F.min_by(shown, F.when(shown.isNotNull(), F.col("seq"))).alias("description"),
        F.max(F.coalesce("joined_group", "transaction_group")).alias("label"),
        F.max(F.when(F.col("item_kind") == "step", F.struct("name", "type", "cleanup_mode", "cleanup_target"))).alias("only"),
    )
    cleanup = F.when(
        F.coalesce(F.col("only.cleanup_target"), F.lit("")) != "",
        F.concat(F.lit(" - Cleanup("), F.col("only.cleanup_mode"), F.lit("): "), F.col("only.cleanup_target")),
    )
    title = (
        F.when(F.col("item_kind") == "joined",
               F.concat(F.lit("JOINED '"), F.col("label"), F.lit("' ("), F.col("steps"), F.lit(" psql steps fused)")))
        .when(F.col("item_kind") == "group",
              F.concat(F.lit("GROUP "), F.col("label"), F.lit(" ("), F.col("steps"), F.lit(" steps)")))
        .otherwise(F.concat(F.upper("only.type"), F.lit(": "), F.col("only.name"), F.coalesce(cleanup, F.lit(""))))
    )
    text = F.coalesce(F.concat(F.lit("\n     "), F.col("description")), F.lit(""))
    lines = items.select("manifest", "item_no", F.concat(F.lit("["), F.col("item_no"), F.lit("] "), title, text).alias("line"), "steps")
    # Lines are groups of one item; the set without the item is the total, so items are made once.
    listed = lines.groupingSets([["manifest", "item_no", "line"], ["manifest"]], "manifest", "item_no", "line").agg(
        F.grouping("item_no").alias("_total"), F.count("*").alias("_n"), F.sum("steps").alias("_steps"))
    total = F.concat(F.lit("--- "), F.col("_n"), F.lit(" tasks ("), F.col("_steps"), F.lit(" steps) ---"))
    return listed.select(
        "manifest", F.when(F.col("_total") == 1, F.col("_n") + 1).otherwise(F.col("item_no")).alias("item_no"),
        F.when(F.col("_total") == 1, total).otherwise(F.col("line")).alias("line"))


def group_durations(steps: DataFrame) -> DataFrame:
    """Steps and seconds per run of one transaction label; steps without a label stand alone."""
    return (
        consecutive_runs(steps, ["manifest"], "seq", F.col("transaction_group"), carry=["name"], out="task_no")
        .groupBy("manifest", "task_no", "transaction_group", F.col("run_name").alias("first_step"))
        .agg(F.count("*").alias("steps"), F.sum("duration").alias("seconds"))
    )


def summary_line(task_no: Column, transaction_group: Column, first_step: Column, steps: Column, seconds: Column) -> Column:
    """Line of the run summary for a row of `group_durations`."""
    subject = F.when(transaction_group.isNull(), first_step).otherwise(
        F.concat(F.lit("Group "), transaction_group, F.lit(" ("), steps, F.lit(" steps)")))
    return F.concat(F.lit("Task "), task_no, F.lit(" - "), subject, F.lit(" - time taken: "),
                    F.format_string("%.2f", seconds), F.lit("s"))


def even_split(steps: DataFrame, walls: DataFrame, keys: list[str], wall: str = "wall") -> DataFrame:
    """Give each step of a fused group an equal share of the group's wall time.

    The group size comes from a partial aggregate that is joined back, not from a window over the group; the steps of a
    very large group lie on the long side of a left join, which AQE splits.
    """
    sizes = steps.groupBy(*keys).agg(F.count("*").alias("group_steps")).join(walls.select(*keys, wall), keys, "left")
    return steps.join(sizes, keys, "left").withColumn("duration", F.col(wall) / F.col("group_steps")).drop(wall)


def alerting_steps(steps: DataFrame) -> DataFrame:
    """Single steps that ask for a notice or took too long."""
    return steps.where(F.col("joined_group").isNull() & (F.col("notify") | (F.col("duration") > ALERT_SECONDS)))


def alerting_groups(steps: DataFrame) -> DataFrame:
    """Fused groups whose total took too long: `manifest`, `run_no`, `joined_group`, `steps`, `seconds`."""
    return (
        consecutive_runs(steps, ["manifest"], "seq", F.col("joined_group"))
        .where("joined_group is not null")
        .groupBy("manifest", "run_no", "joined_group")
        .agg(F.count("*").alias("steps"), F.sum("duration").alias("seconds"))
        .where(F.col("seconds") > ALERT_SECONDS)
    )


def mixed_groups(steps: DataFrame) -> DataFrame:
    """Fused groups that hold other step types than psql, which may not run."""
    return (
        consecutive_runs(steps, ["manifest"], "seq", F.col("joined_group"))
        .where("joined_group is not null")
        .groupBy("manifest", "run_no", "joined_group")
        .agg(F.array_sort(F.collect_set("type")).alias("types"))
        .where(~((F.size("types") == 1) & F.array_contains("types", "psql")))
    )


def fragment_rows(steps: DataFrame, sql: str = "sql_text") -> DataFrame:
    """The fused text of every group, one row per fragment: `joint` (what stands before it, empty for the first) and `piece`.

    The glue is that of the group's first step: `statement` ends every fragment as a statement of its own, `raw` joins pieces
    of one statement. Joints and pieces in the order of `seq` are the whole text; no row grows with the group.
    """
    raw = F.col("glue") == "raw"
    joint = F.when(F.col("seq").eqNullSafe(F.col("run_start")), "").when(raw, RAW_JOINT).otherwise(STATEMENT_JOINT)
    return (
        consecutive_runs(steps, ["manifest"], "seq", F.col("joined_group"), carry=["joined_glue"])
        .where("joined_group is not null")
        .withColumn("glue", F.coalesce("run_joined_glue", F.lit("statement")))
        .select(
            "manifest", "run_no", "joined_group", "glue", "seq", joint.alias("joint"),
            F.when(raw, F.col(sql)).otherwise(F.concat(fragment_body(F.col(sql)), F.lit("\n;"))).alias("piece"))
    )


def fuse_fragments(steps: DataFrame, sql: str = "sql_text", segment_rows: int | None = None) -> DataFrame:
    """One SQL text per fused group, from `fragment_rows`.

    A caller that must bound its rows names `segment_rows`: the text is then cut at multiples of it in `seq`, in further rows
    numbered by `segment`, and `joint` is what stands between their texts.
    """
    segment = F.lit(0) if segment_rows is None else F.expr(f"seq div {int(segment_rows)}")
    fused = (
        fragment_rows(steps, sql).groupBy("manifest", "run_no", "joined_group", "glue", segment.cast("long").alias("segment"))
        .agg(F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("_pieces"))
    )
    joint = F.when(F.col("glue") == "raw", RAW_JOINT).otherwise(STATEMENT_JOINT)
    return fused.select(
        "manifest", "run_no", "joined_group", "glue", "segment",
        F.size("_pieces").alias("fragments"),
        joint.alias("joint"),
        F.when(F.col("glue") == "raw", F.array_join("_pieces.piece", RAW_JOINT))
        .otherwise(F.array_join("_pieces.piece", STATEMENT_JOINT)).alias("sql_text"),
    )
