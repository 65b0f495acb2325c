import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runweave.operators import ordering
from runweave.operators.ordering import as_of, consecutive_runs, number_rows, spread_nulls


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    rows = []
    for key in range(4):
        label = None
        for seq in range(150):
            if rng.random() < 0.3:
                label = rng.choice(["a", "b", None])
            if key == 3:
                label = "one long run"
            elif rng.random() < 0.1:
                continue
            rows.append((key, seq, label, f"g{seq}" if seq % 3 else None))
    return rows


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "k int, s bigint, l string, g string").repartition(3)


@pytest.mark.parametrize("block_rows", [1, 2, 7, 50, 1 << 20])
def test_consecutive_runs_do_not_depend_on_blocks(rows, table, block_rows):
    want = {}
    for key, group in itertools.groupby(sorted(rows, key=lambda r: r[:2]), key=lambda r: r[0]):
        number, last, first = 0, None, None
        for r in group:
            if r[2] is None or r[2] != last:
                number, first = number + 1, r
            last = r[2]
            want[key, r[1]] = (number, first[1], first[3])
    got = consecutive_runs(table, ["k"], "s", F.col("l"), ["g"], block_rows=block_rows)
    assert {(r.k, r.s): (r.run_no, r.run_start, r.run_g) for r in got.collect()} == want


@pytest.mark.parametrize("block_rows", [1, 7, 1 << 20])
def test_number_rows(rows, table, block_rows):
    got = {(r.k, r.s): r.seq for r in number_rows(table, ["k"], "s", block_rows=block_rows).collect()}
    want = {}
    for key, group in itertools.groupby(sorted(rows, key=lambda r: r[:2]), key=lambda r: r[0]):
        want |= {(key, r[1]): i for i, r in enumerate(group, 1)}
    assert got == want


def test_a_key_with_most_rows_is_cut_into_blocks(spark):
    """One key holds all but a few rows: it goes the blocked way, the others do not."""
    hot = spark.range(0, 20_000).select(
        F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(F.lit(-1)).alias("k"), F.col("id").alias("s"), F.lit("x").alias("l"))
    runs = consecutive_runs(hot, ["k"], "s", F.col("l"), block_rows=500)
    assert runs.where("run_no <> 1").isEmpty() and runs.count() == 20_000
    assert runs.where("k = -1 and run_start <> 1").isEmpty()
    rows = runs.collect()
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert len(rows) == 20_000 and "_block" in plan.split("Initial Plan")[0]


def test_light_keys_need_one_window_only(spark):
    table = spark.range(0, 5_000).select((F.col("id") % 7).alias("k"), F.col("id").alias("s"), (F.col("id") % 3).alias("l"))
    runs = consecutive_runs(table, ["k"], "s", F.col("l"))
    runs.collect()
    final = runs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "_block" not in final


def test_rows_without_a_key_are_kept(spark):
    table = spark.createDataFrame([(None, 1, "a"), (None, 2, "a"), (1, 1, "a")], "k int, s bigint, l string")
    assert sorted((r.s, r.run_no) for r in consecutive_runs(table, ["k"], "s", F.col("l"), block_rows=1).collect()) == [(1, 1), (1, 1), (2, 1)]
    assert sorted((r.s, r.seq) for r in number_rows(table, ["k"], "s").collect()) == [(1, 1), (1, 1), (2, 2)]


@pytest.mark.parametrize("block_rows", [1, 2, 1 << 20])
def test_rows_without_an_order_value_come_first(spark, block_rows):
    table = spark.createDataFrame(
        [(k, s, "a" if s is None or s < 3 else "b") for k in (None, 1) for s in (None, -4, 2, 3, 10**12)], "k int, s bigint, l string")
    runs = consecutive_runs(table, ["k"], "s", F.col("l"), block_rows=block_rows)
    wanted = [(None, 1, None), (-4, 1, None), (2, 1, None), (3, 2, 3), (10**12, 2, 3)]
    numbered = number_rows(table, ["k"], "s", block_rows=block_rows)
    for key in (F.col("k").isNull(), F.col("k") == 1):
        assert {(r.s, r.run_no, r.run_start) for r in runs.where(key).collect()} == set(wanted) and runs.where(key).count() == 5
        assert sorted((r.seq, r.s or 0) for r in numbered.where(key).collect()) == [(1, 0), (2, -4), (3, 2), (4, 3), (5, 10**12)]


@pytest.mark.parametrize("block_rows", [1, 1 << 20])
def test_the_order_must_be_an_integer(spark, block_rows):
    with pytest.raises(ValueError, match="must be an integer"):
        number_rows(spark.createDataFrame([(1, "x")], "k int, s string"), ["k"], "s", block_rows=block_rows)


def brute_runs(rows):
    """Runs and numbers by a plain loop; ties of the order value go by label, then by `x`."""
    rank = lambda v: (v is not None, v if v is not None else 0)
    out = []
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (rank(r[0]), rank(r[1]), (r[2] is not None, r[2] or ""), rank(r[3]))), key=lambda r: r[0]):
        run, last, start = 0, None, None
        for number, r in enumerate(group, 1):
            if r[2] is None or r[2] != last:
                run, start = run + 1, r[1]
            last = r[2]
            out.append((*r, number, run, start))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_rows", [1, 2, 7, 1 << 40])
def test_one_rule_at_every_block_size(spark, block_rows):
    """Null, negative, sparse and repeated order values, null keys and labels, rows that are equal."""
    rng = random.Random(11)
    orders = [None, None, -(2**62), -5, -5, -5, 0, 3, 3, 10**9, 2**62]
    rows = [(key, rng.choice(orders), rng.choice(["a", "a", "b", None]), x % 9) for key in (None, 1, 2) for x in range(40)] + [(7, 1, "a", 0)]
    table = spark.createDataFrame(rows, "k int, s bigint, l string, x int").repartition(3)
    table = table.withColumn("m", F.create_map(F.lit("p"), F.col("x")))  # cannot be ordered
    runs = consecutive_runs(table, ["k"], "s", F.col("l"), block_rows=block_rows).drop("m")
    numbers = number_rows(table, ["k"], "s", block_rows=block_rows).drop("m")
    want = brute_runs(rows)
    assert sorted((tuple(r[c] for c in ("k", "s", "l", "x", "run_no", "run_start")) for r in runs.collect()), key=repr) == sorted(
        ((*w[:4], *w[5:]) for w in want), key=repr)
    assert sorted((tuple(r[c] for c in ("k", "s", "l", "x", "seq")) for r in numbers.collect()), key=repr) == sorted((w[:5] for w in want), key=repr)


def test_sparse_order_values_make_full_ranges(spark):
    """Ranges follow the counted rows: far apart order values do not give each row a range of its own."""
    table = spark.range(0, 4_000).select(F.lit(1).alias("k"), (F.col("id") * 10**9 + F.col("id") % 3).alias("s"))
    _, ranges = ordering._cut_heavy(table, ["k"], "s", 500)
    sizes = [r["count"] for r in ranges.groupBy("_block").count().collect()]
    assert sum(sizes) == 4_000 and len(sizes) <= 8 and max(sizes) <= 1_000
    numbered = number_rows(table, ["k"], "s", block_rows=500)
    assert "broadcast" not in numbered._jdf.queryExecution().analyzed().toString().lower()
    assert numbered.where("seq <> s div 1000000000 + 1").isEmpty() and numbered.count() == 4_000


def test_spread_nulls_never_matches(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, None)], "i int, k string")
    keys = {r.i: r.x for r in df.select("i", spread_nulls(F.col("k"), F.col("i")).alias("x")).collect()}
    assert keys[1] == "a" and len({keys[2], keys[3], "a"}) == 3


@pytest.mark.parametrize("block_rows", [1, 3, 1 << 20])
def test_as_of_takes_the_newest_point_that_is_not_later(spark, block_rows):
    day = lambda n: None if n is None else datetime(2024, 1, 1) + timedelta(days=n)
    series = [(None, 1, "a"), (None, 5, "b"), (1, 2, "c"), (1, 4, None), (1, None, "x"), (2, 3, "d"), *((3, i, f"p{i}") for i in range(0, 60, 2))]
    asked = [(key, t) for key in (None, 1, 2, 4) for t in (None, 0, 2, 3, 4, 9)] + [(3, i) for i in range(40)] * 2
    points = spark.createDataFrame([(k, day(t), v) for k, t, v in series], "k int, at timestamp, v string").repartition(3)
    rows = spark.createDataFrame([(k, day(t)) for k, t in asked], "k int, t timestamp").repartition(3).withColumn("m", F.create_map(F.lit(1), "k"))
    got = sorted(((r.k, r.t, r.found) for r in as_of(rows, points, ["k"], "t", "at", "v", "found", block_rows).collect()), key=repr)
    newest = lambda k, t: max(((at, v) for key, at, v in series if key == k and at is not None and t is not None and at <= t), default=(0, None))[1]
    assert got == sorted(((k, day(t), newest(k, t)) for k, t in asked), key=repr)
