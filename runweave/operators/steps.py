"""Step tables: validation, typing, catalog lookup, file variants and nesting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.operators.ordering import broadcast_if_small, spread_nulls
from runweave.session import shared_dir

# Step types, step keys, and the allowed values of two of them.
STEP_TYPES = ("sql", "plsql", "psql", "bulk_insert", "python", "manifest")
STEP_KEYS = (
    "name", "type", "enabled", "description", "file", "sql_id", "params",
    "transaction_group", "joined_group", "joined_glue", "cleanup_target", "cleanup_mode",
    "profile", "output_file", "notify", "ping_on_end", "ping_on_error",
)
GLUES = ("statement", "raw")
CLEANUP_MODES = ("drop", "truncate")

# Folder of the translated files of each dialect, in the order they are looked up.
DIALECT_FOLDERS = {
    "postgresql": "postgres-pipeline",
    "psycopg2": "postgres-pipeline",
    "clickhouse": "clickhouse-pipeline",
    "duckdb": "duckdb-pipeline",
}


class CatalogError(ValueError):
    """A SQL id that the catalog cannot resolve."""


def enabled_filter(steps: DataFrame, enable_all: bool = False) -> DataFrame:
    return steps if enable_all else steps.where("enabled")


# -- validation ---------------------------------------------------------------------------------


def _one_of(values) -> str:
    return ", ".join(sorted(values))


def validate_steps(raw: DataFrame, raw_col: str = "raw") -> DataFrame:
    """One row per broken rule of a raw step, a map of text: `rule_no`, `problem`.

    Rules are numbered in the order they are checked; rule 1 of a step is the one a strict loader
    would stop at.
    """
    step = F.col(raw_col)
    value = lambda key: F.try_element_at(step, F.lit(key))
    has = lambda key: F.map_contains_key(step, key)
    some = lambda key: F.coalesce(value(key), F.lit("")) != ""
    unknown = F.array_sort(F.array_except(F.map_keys(step), F.array(*map(F.lit, STEP_KEYS))))
    bad = lambda key, allowed: value(key).isNotNull() & ~value(key).isin(*allowed)

    rules = [
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown keys "), F.array_join(unknown, ", "))),
        F.when(~has("name"), F.lit("missing required name")),
        F.when(~has("type"), F.lit("missing required type")),
        F.when(has("type") & ~F.coalesce(value("type").isin(*STEP_TYPES), F.lit(False)),
               F.concat(F.lit("type "), F.coalesce(value("type"), F.lit("None")), F.lit(f" is not one of {_one_of(STEP_TYPES)}"))),
        F.when(some("file") & some("sql_id"), F.lit("set either file or sql_id, not both")),
        F.when(bad("joined_glue", GLUES), F.concat(F.lit(f"joined_glue must be one of {_one_of(GLUES)}, got "), value("joined_glue"))),
        F.when(has("cleanup_mode") & ~F.coalesce(value("cleanup_mode").isin(*CLEANUP_MODES), F.lit(False)),
               F.concat(F.lit(f"cleanup_mode must be one of {_one_of(CLEANUP_MODES)}, got "), F.coalesce(value("cleanup_mode"), F.lit("None")))),
    ]
    others = [c for c in raw.columns if c != raw_col]
    return (
        raw.select(*others, F.posexplode(F.array_compact(F.array(*rules))).alias("_pos", "problem"))
        .select(*others, (F.col("_pos") + 1).alias("rule_no"), "problem")
    )


def typed_steps(raw: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Typed step columns with their defaults from raw steps; empty group labels become null."""
    step = F.col(raw_col)
    value = lambda key: F.try_element_at(step, F.lit(key))
    truth = lambda key, default: F.when(
        F.map_contains_key(step, key), ~F.lower(F.coalesce(value(key), F.lit(""))).isin("", "false", "no", "off", "0")
    ).otherwise(default)
    label = lambda key: F.when(~value(key).isin("", "0"), value(key))
    columns = {
        "name": value("name"),
        "type": value("type"),
        "enabled": truth("enabled", True),
        "description": value("description"),
        "file": value("file"),
        "sql_id": value("sql_id"),
        "params": F.coalesce(F.from_json(value("params"), "map<string,string>"), F.create_map().cast("map<string,string>")),
        "transaction_group": label("transaction_group"),
        "joined_group": label("joined_group"),
        "joined_glue": value("joined_glue"),
        "cleanup_target": value("cleanup_target"),
        "cleanup_mode": F.coalesce(value("cleanup_mode"), F.lit("drop")),
        "profile": truth("profile", False),
        "output_file": value("output_file"),
        "notify": truth("notify", False),
        "ping_on_end": value("ping_on_end"),
        "ping_on_error": value("ping_on_error"),
    }
    others = [c for c in raw.columns if c != raw_col]
    return raw.select(*others, *[c.alias(name) for name, c in columns.items()])


# -- catalog ------------------------------------------------------------------------------------


def validate_catalog(entries: DataFrame) -> DataFrame:
    """Catalog problems with the number of entries concerned: `problem`, `sql_id`, `entries`.

    Ids are counted among the entries that name a file.
    """
    incomplete = F.when(F.col("sql_id").isNull(), "missing id").when(F.col("file").isNull(), "missing file")
    return (
        entries.select("sql_id", incomplete.alias("problem"))
        .groupBy("sql_id", "problem").agg(F.count("*").alias("entries"))
        .withColumn("problem", F.coalesce("problem", F.when(F.col("entries") > 1, "duplicate id")))
        .where("problem is not null")
        .select("problem", "sql_id", "entries")
    )


def resolve_sql_ids(steps: DataFrame, catalog: DataFrame, unique: str = "seq") -> DataFrame:
    """Fill `file` from the catalog and clear `sql_id`; an id that stays is unresolved.

    No broadcast is forced: Catalyst and AQE broadcast the catalog while it is below the size
    threshold and shuffle both sides beyond it. Steps without an id are spread over the tasks.
    """
    entries = catalog.select(F.col("sql_id").alias("_key"), F.col("file").alias("_file"))
    keyed = steps.withColumn("_key", spread_nulls(F.col("sql_id"), *[F.col(c) for c in {"manifest", unique} & set(steps.columns)]))
    found = keyed.join(entries, "_key", "left")
    return found.select(
        *[
            F.coalesce("_file", "file").alias("file") if c == "file"
            else F.when(F.col("_file").isNull(), F.col("sql_id")).alias("sql_id") if c == "sql_id"
            else F.col(c)
            for c in steps.columns
        ]
    )


def unresolved_sql_ids(steps: DataFrame, catalog: DataFrame) -> DataFrame:
    """Steps whose `sql_id` the catalog does not hold."""
    return steps.where("sql_id is not null").join(catalog.select("sql_id"), "sql_id", "left_anti")


# -- files --------------------------------------------------------------------------------------


def dialect_folder(dialect: str) -> str | None:
    """Folder with the translated files of a dialect; none for Oracle or an unknown one."""
    if not dialect or "oracle" in dialect:
        return None
    return next((folder for key, folder in DIALECT_FOLDERS.items() if key in dialect), None)


def resolve_variants(files: DataFrame, index: DataFrame, dialect: str, file_col: str = "file") -> DataFrame:
    """Add `resolved`: the first file that exists among the dialect's four candidates, else the original.

    `index` holds the existing paths in `path`. It is reduced to one row per base name first, so the
    requested files are joined twice and never multiplied by the candidates.
    """
    folder = dialect_folder(dialect)
    if folder is None:
        return files.withColumn("resolved", F.col(file_col))
    path = F.col("path")
    available = (
        index.where(F.startswith(path, F.lit(folder + "/")))
        .select(F.expr(f"substring(path, {len(folder) + 2})").alias("_rest"))
        .select(
            F.regexp_replace("_rest", r"\Aschemas/", "").alias("_name"),
            F.startswith(F.col("_rest"), F.lit("schemas/")).alias("_nested"),
        )
        .where(~F.contains("_name", F.lit("/")))
        .groupBy("_name").agg(F.bool_or(~F.col("_nested")).alias("_top"), F.bool_or("_nested").alias("_sub"))
    )
    name = F.regexp_extract(file_col, r"(?s)[^/]*\z", 0)
    underscored = F.replace(F.replace(F.col("_as_is"), F.lit(" - "), F.lit("_")), F.lit(" "), F.lit("_"))
    named = files.withColumn("_as_is", name).withColumn("_under", underscored)
    as_is = available.select(F.col("_name").alias("_as_is"), F.col("_top").alias("_a_top"), F.col("_sub").alias("_a_sub"))
    under = available.select(F.col("_name").alias("_under"), F.col("_top").alias("_u_top"), F.col("_sub").alias("_u_sub"))
    joined = named.join(as_is, "_as_is", "left").join(under, "_under", "left")
    candidates = [
        F.when(F.col("_a_top"), F.concat(F.lit(f"{folder}/"), F.col("_as_is"))),
        F.when(F.col("_u_top"), F.concat(F.lit(f"{folder}/"), F.col("_under"))),
        F.when(F.col("_a_sub"), F.concat(F.lit(f"{folder}/schemas/"), F.col("_as_is"))),
        F.when(F.col("_u_sub"), F.concat(F.lit(f"{folder}/schemas/"), F.col("_under"))),
    ]
    return joined.select(*files.columns, F.coalesce(*candidates, F.col(file_col)).alias("resolved"))


# -- nesting ------------------------------------------------------------------------------------


def expand_manifests(steps: DataFrame, root: str, enable_all: bool = False) -> DataFrame:
    """Steps of `root` with every manifest step replaced, in place, by the steps of its child.

    Adds `path`, the array of `seq` values from the root down; sorting by it gives run order.
    The rounds, one per nesting depth, join only manifest steps with each other, on checkpoints; the
    step table is read once more at the end, when every inclusion of a manifest is known.
    """
    shared_dir(steps.sparkSession)
    queue = enabled_filter(steps, enable_all)
    nested = F.col("type") == "manifest"
    calls = queue.where(nested).select(F.col("manifest").alias("_child"), "seq", "file").checkpoint()

    frontier = steps.sparkSession.range(1, numPartitions=1).select(
        F.lit(root).alias("_child"), F.array().cast("array<bigint>").alias("_path"), F.array(F.lit(root)).alias("_seen"))
    inclusions = [frontier]
    while True:
        frontier = broadcast_if_small(frontier).join(calls, "_child").select(
            F.col("file").alias("_child"),
            F.concat("_path", F.array("seq")).alias("_path"),
            F.concat("_seen", F.array("file")).alias("_seen"),
        ).checkpoint()
        cyclic = F.size(F.array_distinct("_seen")) < F.size("_seen")
        found = frontier.agg(F.count("*").alias("n"), F.bool_or(cyclic).alias("cyclic")).first()
        if found["cyclic"]:
            raise ValueError(f"manifest {root!r} includes itself")
        if not found["n"]:
            break
        inclusions.append(frontier)
    included = broadcast_if_small(reduce(DataFrame.unionByName, inclusions).select("_child", "_path"))
    leaves = queue.where(~nested).withColumn("_child", F.col("manifest"))
    return included.join(leaves, "_child").select(*queue.columns, F.concat("_path", F.array("seq")).alias("path"))
