"""Running SQL: parameters, limits, guards, templates, scripts and ordered steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import derived
from checks.derived import table
from runweave.functions import sqltext
from runweave.operators import grouping, steps as step_ops
from runweave.runs.query import limit_wrap as cap_rows
from runweave.runs.query import lower_headers as to_lower
from runweave.runs.query import profile_query as profile
from runweave.runs.query import run_script as run_statements
from runweave.runs.query import run_sql
from runweave.runs.steps import apply_step, run_steps as run_manifest_steps
from runweave.session import new_run_dir
from runweave.sinks.publish import read_published
from runweave.sinks.tables import create_scratch_database


def run_sql_params(spark, sf_dir):
    result = run_sql(
        spark,
        "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM IDENTIFIER(:t) "
        "WHERE o_totalprice >= :low AND o_orderstatus <> :status GROUP BY o_orderpriority",
        tables={"run_orders": table(spark, sf_dir, "orders")},
        params={"t": "run_orders", "low": 1000.0, "status": "P"},
        dql_only=True,
    )
    return result.data


def limit_wrap(spark, sf_dir):
    """The limit is the feature: the 100 dearest orders."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return cap_rows(orders.orderBy(F.desc("o_totalprice"), "o_orderkey"), 100)


def dql_guard(spark, sf_dir):
    return derived.corpus(spark, sf_dir).select("o_orderkey", sqltext.guard_keyword(F.col("sql_text")).alias("keyword"))


def ddl_classify(spark, sf_dir):
    return derived.corpus(spark, sf_dir).select("o_orderkey", sqltext.is_ddl(F.col("sql_text")).alias("is_ddl"))


def render_template(spark, sf_dir):
    params = F.when(F.col("o_orderkey") % 3 != 0, F.create_map(
        F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority")))
    return derived.corpus(spark, sf_dir).select(
        "o_orderkey", sqltext.render_template(F.col("sql_text"), params).alias("sql_text"))


def strip_terminator(spark, sf_dir):
    text = F.col("sql_text")
    return derived.corpus(spark, sf_dir).select(
        "o_orderkey", sqltext.strip_terminator(text).alias("one"),
        sqltext.strip_terminator(text, every=True).alias("every"), sqltext.fragment_body(text).alias("fragment"))


def sql_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sqltext.sql_hash(F.col("text")).alias("sql_hash"))


def split_statements(spark, sf_dir):
    return derived.corpus(spark, sf_dir).select(
        "o_orderkey", F.posexplode(sqltext.split_statements(F.col("sql_text"))).alias("statement_no", "statement"))


def lower_headers(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("O_ORDERKEY"), F.col("o_orderstatus").alias("Status"), F.col("o_totalprice").alias("totalPrice"))
    return to_lower(orders)


def run_script(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("script_orders")
    return run_statements(spark, """
        -- the last statement's rows; a ';' in a comment or text ends nothing
        CREATE OR REPLACE TEMP VIEW script_open AS
          SELECT o_custkey, o_totalprice, 'a;b' AS tag FROM script_orders WHERE o_orderstatus <> 'F';
        CREATE OR REPLACE TEMP VIEW script_totals AS
          SELECT o_custkey, tag, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM script_open GROUP BY o_custkey, tag;
        SELECT o_custkey, tag, n, total FROM script_totals WHERE n > 1;
    """)


def fuse_fragments(spark, sf_dir):
    return grouping.fuse_fragments(derived.steps(spark, sf_dir), segment_rows=256).drop("joint")


def fragment_rows(spark, sf_dir):
    return grouping.fragment_rows(derived.steps(spark, sf_dir))


def fuse_fragments_run(spark, sf_dir):
    """Raw glue: the fragments of one statement are fused, and Catalyst plans them as one query."""
    from runweave.runs.steps import fuse_sql

    table(spark, sf_dir, "orders").createOrReplaceTempView("fuse_orders")
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("fuse_lineitem")
    return spark.sql(fuse_sql([
        "WITH heads AS (SELECT o_orderkey, o_orderstatus FROM fuse_orders WHERE o_totalprice > 100000),",
        "lines AS (SELECT l_orderkey, l_quantity FROM fuse_lineitem WHERE l_returnflag = 'R')",
        "SELECT o_orderstatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity "
        "FROM heads JOIN lines ON l_orderkey = o_orderkey GROUP BY o_orderstatus",
    ], "raw"))


def run_steps(spark, sf_dir):
    """A manifest: stage orders, fuse two psql steps over them, run a python step and a nested manifest."""
    database = create_scratch_database(spark)
    table(spark, sf_dir, "orders").createOrReplaceTempView("manifest_orders")
    texts = {
        "stage.sql": f"CREATE TABLE {database}.staging AS SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM manifest_orders",
        "view.sql": f"CREATE OR REPLACE TEMP VIEW manifest_staged AS SELECT * FROM {database}.staging WHERE o_orderstatus <> '{{{{ skip }}}}';",
        "count.sql": "CREATE OR REPLACE TEMP VIEW manifest_counts AS SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total "
                     "FROM manifest_staged GROUP BY o_custkey;",
    }
    rows = [
        ("main", 1, "stage", "sql", "stage.sql", None, None, f"{database}.staging"),
        ("main", 2, "view", "psql", "view.sql", {"skip": "P"}, "counts", None),
        ("main", 3, "count", "psql", "count.sql", None, "counts", None),
        ("main", 4, "publish", "manifest", "child", None, None, None),
        ("child", 1, "customer_counts", "python", "counts", {"least": "2"}, None, None),
    ]
    manifest = (
        spark.createDataFrame(rows, "manifest string, seq bigint, name string, type string, file string, "
                                    "params map<string,string>, joined_group string, cleanup_target string")
        .selectExpr("*", "true AS enabled", "cast(null AS string) AS transaction_group", "cast(null AS string) AS joined_glue",
                    "'drop' AS cleanup_mode", "cast(null AS string) AS output_file", "cast(null AS string) AS sql_id")
    )
    folder = new_run_dir(spark, "steps")
    run_manifest_steps(
        spark, manifest, "main", f"{folder}/out", f"{folder}/log", sql_texts=texts,
        functions={"counts": lambda session, least: session.table("manifest_counts").where(F.col("n") >= int(least))},
    )
    return read_published(spark, f"{folder}/out", "customer_counts")


def python_step(spark, sf_dir):
    def shift(df, column, by):
        return df.withColumn(column, F.round(F.col(column) + float(by), 2))

    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return apply_step(events, shift, {"column": "value", "by": "2.5"})


def nested_steps(spark, sf_dir):
    """Region manifests call nation manifests, these call customer manifests, whose steps are the orders."""
    call = lambda df, manifest, seq, file: df.select(
        F.concat(*manifest).alias("manifest"), F.col(seq).cast("bigint").alias("seq"), F.concat(*file).alias("file"), F.lit("manifest").alias("type"))
    regions = call(table(spark, sf_dir, "region"), [F.lit("all")], "r_regionkey", [F.lit("r"), "r_regionkey"])
    nations = call(table(spark, sf_dir, "nation"), [F.lit("r"), "n_regionkey"], "n_nationkey", [F.lit("n"), "n_nationkey"])
    customers = call(table(spark, sf_dir, "customer"), [F.lit("n"), "c_nationkey"], "c_custkey", [F.lit("c"), "c_custkey"])
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), "o_custkey").alias("manifest"), F.col("o_orderkey").alias("seq"), F.lit("o.sql").alias("file"), F.lit("sql").alias("type"))
    return regions.unionByName(nations).unionByName(customers).unionByName(orders).withColumn("enabled", F.lit(True))


def expand_manifest(spark, sf_dir):
    leaves = step_ops.expand_manifests(nested_steps(spark, sf_dir), "all")
    return leaves.select("manifest", "seq", F.array_join(F.transform("path", lambda p: p.cast("string")), "/").alias("path"))


def plan_listing(spark, sf_dir):
    return grouping.plan_listing(step_ops.enabled_filter(derived.steps(spark, sf_dir)))


def profile_query(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("profile_lineitem")
    profiled = profile(spark, "SELECT l_returnflag, l_linestatus, count(*) AS n FROM profile_lineitem GROUP BY ALL;")
    return profiled.select("rows", "rows_read", F.contains("plan_content", F.lit("HashAggregate")).alias("aggregates"), (F.col("duration_ms") > 0).alias("timed"))


QUERIES = {
    "run_sql_params": run_sql_params,
    "limit_wrap": limit_wrap,
    "dql_guard": dql_guard,
    "ddl_classify": ddl_classify,
    "render_template": render_template,
    "strip_terminator": strip_terminator,
    "sql_hash": sql_hash,
    "split_statements": split_statements,
    "lower_headers": lower_headers,
    "run_script": run_script,
    "fuse_fragments": fuse_fragments,
    "fragment_rows": fragment_rows,
    "fuse_fragments_run": fuse_fragments_run,
    "run_steps": run_steps,
    "python_step": python_step,
    "expand_manifest": expand_manifest,
    "plan_listing": plan_listing,
    "profile_query": profile_query,
}

_CORPUS = f"({derived.CORPUS_SQL}) c"
_BLANK = "concat(' ', chr(9), chr(10), chr(13))"
_KEYWORDS = "|".join(sqltext.GUARDED_KEYWORDS)
_DDL = "|".join(sqltext.DDL_KEYWORDS)

RUNS_SQL = """
marked AS (
  SELECT *, CASE WHEN {label} IS NOT NULL AND lag({label}) OVER (PARTITION BY manifest ORDER BY seq) = {label} THEN 0 ELSE 1 END AS starts
  FROM {steps}),
runs AS (
  SELECT *, CAST(sum(starts) OVER (PARTITION BY manifest ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_no FROM marked)
"""

ORACLE = {
    "run_sql_params": "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders "
                      "WHERE o_totalprice >= 1000 AND o_orderstatus <> 'P' GROUP BY o_orderpriority",
    "limit_wrap": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    "dql_guard": rf"SELECT o_orderkey, regexp_extract(sql_text, '(?im)^\s*({_KEYWORDS})\b', 1) AS keyword FROM {_CORPUS}",
    "ddl_classify": rf"SELECT o_orderkey, regexp_matches(sql_text, '(?i)\A\s*(?:--[^\n]*\n\s*)*(?:{_DDL})\b') AS is_ddl FROM {_CORPUS}",
    "render_template": f"""
        SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN sql_text ELSE
          replace(replace(replace(regexp_replace(sql_text, '\\n\\z', ''), '{{{{ status }}}}', o_orderstatus),
                  '{{{{priority}}}}', o_orderpriority), '{{{{ cap }}}}', '') END AS sql_text FROM {_CORPUS}""",
    "strip_terminator": f"""
        SELECT o_orderkey,
               CASE WHEN ends_with(t, ';') THEN trim(left(t, length(t) - 1), {_BLANK}) ELSE t END AS one,
               rtrim(t, ';') AS every, rtrim(rtrim(sql_text, {_BLANK}), ';') AS fragment
        FROM (SELECT *, trim(sql_text, {_BLANK}) AS t FROM {_CORPUS})""",
    "sql_hash": "SELECT doc_id, substring(sha256(text), 1, 16) AS sql_hash FROM documents",
    "split_statements": f"""
        WITH split AS (
          SELECT o_orderkey, list_filter(list_transform(string_split(sql_text, ';'), lambda s: trim(s, {_BLANK})), lambda s: s <> '') AS parts
          FROM {_CORPUS})
        SELECT o_orderkey, CAST(i - 1 AS INT) AS statement_no, parts[i] AS statement
        FROM (SELECT o_orderkey, parts, unnest(range(1, len(parts) + 1)) AS i FROM split)""",
    "lower_headers": "SELECT o_orderkey, o_orderstatus AS status, o_totalprice AS totalprice FROM orders",
    "run_script": """
        SELECT o_custkey, 'a;b' AS tag, count(*) AS n, round(sum(o_totalprice), 2) AS total
        FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey HAVING count(*) > 1""",
    "fuse_fragments": f"""
        WITH steps AS ({derived.STEPS_SQL}),
        {RUNS_SQL.format(label="joined_group", steps="steps")},
        glued AS (
          SELECT *, coalesce(first_value(joined_glue) OVER (PARTITION BY manifest, run_no ORDER BY seq), 'statement') AS glue
          FROM runs WHERE joined_group IS NOT NULL)
        SELECT manifest, run_no, joined_group, glue, seq // 256 AS segment, CAST(count(*) AS INT) AS fragments,
               CASE WHEN glue = 'raw' THEN string_agg(sql_text, chr(10) ORDER BY seq)
                    ELSE string_agg(concat('SELECT ', seq, ' AS k ', chr(10), ';'), concat(chr(10), chr(10)) ORDER BY seq) END AS sql_text
        FROM glued GROUP BY manifest, run_no, joined_group, glue, seq // 256""",
    "fragment_rows": f"""
        WITH steps AS ({derived.STEPS_SQL}),
        {RUNS_SQL.format(label="joined_group", steps="steps")},
        glued AS (
          SELECT *, coalesce(first_value(joined_glue) OVER (PARTITION BY manifest, run_no ORDER BY seq), 'statement') AS glue,
                 row_number() OVER (PARTITION BY manifest, run_no ORDER BY seq) AS place
          FROM runs WHERE joined_group IS NOT NULL)
        SELECT manifest, run_no, joined_group, glue, seq,
               CASE WHEN place = 1 THEN '' WHEN glue = 'raw' THEN chr(10) ELSE concat(chr(10), chr(10)) END AS joint,
               CASE WHEN glue = 'raw' THEN sql_text ELSE concat('SELECT ', seq, ' AS k ', chr(10), ';') END AS piece
        FROM glued""",
    "fuse_fragments_run": """
        SELECT o_orderstatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey
        WHERE o_totalprice > 100000 AND l_returnflag = 'R' GROUP BY o_orderstatus""",
    "run_steps": """
        SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
        WHERE o_orderstatus <> 'P' GROUP BY o_custkey HAVING count(*) >= 2""",
    "python_step": "SELECT event_id, event_type, round(value + 2.5, 2) AS value FROM events",
    "expand_manifest": """
        SELECT concat('c', o_custkey) AS manifest, o_orderkey AS seq,
               concat(n_regionkey, '/', n_nationkey, '/', c_custkey, '/', o_orderkey) AS path
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "profile_query": """
        SELECT count(*) AS rows, (SELECT count(*) FROM lineitem) AS rows_read, TRUE AS aggregates, TRUE AS timed
        FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)""",
    "plan_listing": f"""
        WITH steps AS (
          SELECT *, CASE WHEN joined_group IS NOT NULL THEN concat('J', joined_group)
                         WHEN transaction_group IS NOT NULL THEN concat('G', transaction_group) END AS label
          FROM ({derived.STEPS_SQL}) s WHERE enabled),
        {RUNS_SQL.format(label="label", steps="steps")},
        items AS (
          SELECT manifest, run_no, count(*) AS n, max(label) AS label, max(joined_group) AS jg, max(transaction_group) AS tg,
                 max(type) AS type, max(name) AS name, max(cleanup_target) AS target, max(cleanup_mode) AS mode,
                 arg_min(description, seq) FILTER (WHERE description IS NOT NULL) AS description
          FROM runs GROUP BY manifest, run_no)
        SELECT manifest, run_no AS item_no, concat('[', run_no, '] ',
                 CASE WHEN jg IS NOT NULL THEN concat('JOINED ''', jg, ''' (', n, ' psql steps fused)')
                      WHEN tg IS NOT NULL THEN concat('GROUP ', tg, ' (', n, ' steps)')
                      ELSE concat(upper(type), ': ', name, CASE WHEN target IS NOT NULL THEN concat(' - Cleanup(', mode, '): ', target) ELSE '' END) END,
                 CASE WHEN description IS NOT NULL THEN concat(chr(10), '     ', description) ELSE '' END) AS line
        FROM items
        UNION ALL
        SELECT manifest, count(*) + 1, concat('--- ', count(*), ' tasks (', sum(n), ' steps) ---') FROM items GROUP BY manifest""",
}
