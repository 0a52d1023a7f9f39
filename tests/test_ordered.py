"""The run-based windows against plain Spark windows, on skewed keys, ties and nulls."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import ordered, windows


def rows_with(seed, n, hot_key, hot_value, nulls=0.0):
    """A third or more of the rows in one key and one order value."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rnd.random() < hot_key else f"k{rnd.randrange(6)}"
        value = 7.0 if rnd.random() < hot_value else float(rnd.randrange(12))
        metric = None if rnd.random() < nulls else float(rnd.randrange(1, 100))
        out.append((key, value, metric, i))
    return out


SCHEMA = "k string, v double, m double, id long"
CASES = [(1, 400, 0.9, 0.9, 0.0), (2, 300, 0.4, 0.0, 0.1), (3, 60, 0.0, 0.5, 0.0), (4, 5, 1.0, 1.0, 0.0), (5, 200, 1.0, 1.0, 0.2)]


def bag(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("desc", [False, True])
def test_positions_equal_plain_windows(spark, case, desc):
    df = spark.createDataFrame(rows_with(*case), SCHEMA)
    order = F.desc("v") if desc else F.asc("v")
    peers = Window.partitionBy("k").orderBy(order)
    rows = Window.partitionBy("k").orderBy(order, "id")
    want = df.select(
        "k", "v", "m", "id",
        F.row_number().over(rows).alias("rn"), F.rank().over(peers).alias("rk"), F.dense_rank().over(peers).alias("dr"),
        F.count("*").over(Window.partitionBy("k")).alias("n"), F.count("*").over(peers).alias("up"),
        F.sum("m").over(rows.rowsBetween(Window.unboundedPreceding, 0)).alias("rs"),
        F.sum("m").over(peers).alias("ps"), F.sum("m").over(Window.partitionBy("k")).alias("ts"),
        F.size(F.collect_set("v").over(Window.partitionBy("k"))).alias("dv"),
    )
    runs = ordered.split_runs(df, ["k"], "v", ["id"], desc=desc, runs=16)
    got = ordered.positions(
        runs,
        {"rn": "row_number", "rk": "rank", "dr": "dense_rank", "n": "total", "up": "upto", "rs": "running_sum", "ps": "range_sum", "ts": "total_sum", "dv": "distinct"},
        metric="m",
    )
    assert bag(got.select(*want.columns)) == bag(want)


@pytest.mark.parametrize("case", CASES)
def test_whole_table_order(spark, case):
    df = spark.createDataFrame(rows_with(*case), SCHEMA)
    want = df.select("id", F.row_number().over(Window.orderBy("v", "id")).alias("rn"))
    runs = ordered.split_runs(df, [], "v", ["id"], runs=16)
    assert bag(ordered.positions(runs, {"rn": "row_number"}).select("id", "rn")) == bag(want)


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("desc", [False, True])
def test_opposite_order_within_another_key(spark, case, desc):
    df = spark.createDataFrame(rows_with(*case), SCHEMA).withColumn("k", F.when(F.col("k") != "k1", F.col("k")))
    df = df.withColumn("v", F.when(F.col("v") != 3, F.col("v")))
    whole = Window.orderBy(F.desc("v") if desc else F.asc("v"), "id")
    peers = Window.partitionBy("k").orderBy(F.asc("v") if desc else F.desc("v"))
    want = df.select(
        "k", "id", F.row_number().over(whole).alias("rn"), F.rank().over(peers).alias("rk"),
        F.count("*").over(peers).alias("up"), F.count("*").over(Window.partitionBy("k")).alias("n"),
    )
    runs = ordered.split_runs(df, [], "v", ["id"], desc=desc, runs=16)
    rows = ordered.positions(runs, {"rn": "row_number"}, keep_runs=True)
    got = ordered.reversed_positions(runs, ["k"], {"rk": "rank", "up": "upto", "n": "total"}, rows)
    assert set(got.columns) == {"k", "v", "m", "id", "rn", "rk", "up", "n"}
    assert bag(got.select(*want.columns)) == bag(want)


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("n_runs", [3, 40])
def test_neighbours_equal_plain_windows(spark, case, n_runs):
    """With more runs than rows a window reaches over several (also empty) runs."""
    df = spark.createDataFrame(rows_with(*case), SCHEMA)
    w = Window.partitionBy("k").orderBy("v", "id")
    makers = {
        "lag": lambda w: F.lag("m").over(w),
        "lead": lambda w: F.lead("m").over(w),
        "back": lambda w: F.sum("m").over(w.rowsBetween(-4, 0)),
        "ahead": lambda w: F.sum("m").over(w.rowsBetween(0, 2)),
    }
    want = df.select("k", "id", *[f(w).alias(n) for n, f in makers.items()])
    runs = ordered.split_runs(df, ["k"], "v", ["id"], runs=n_runs)
    got = ordered.neighbours(runs, makers, back=4, ahead=2)
    assert bag(got.select(*want.columns)) == bag(want)


def test_null_keys_and_order_values(spark):
    data = [(None, None, 1.0, 1), (None, 2.0, 1.0, 2), ("a", None, 1.0, 3), ("a", None, 1.0, 4), ("a", 5.0, 1.0, 5)]
    df = spark.createDataFrame(data, SCHEMA)
    for desc in (False, True):
        w = Window.partitionBy("k").orderBy(F.desc("v") if desc else F.asc("v"))
        want = df.select("id", F.rank().over(w).alias("rk"))
        got = ordered.positions(ordered.split_runs(df, ["k"], "v", ["id"], desc=desc, runs=8), {"rk": "rank"})
        assert bag(got.select("id", "rk")) == bag(want)


def test_runs_are_even_when_one_key_and_value_hold_everything(spark):
    df = spark.range(4000).selectExpr("'x' as k", "1.0 as v", "id")
    runs = ordered.split_runs(df, ["k"], "v", ["id"], runs=8)
    sizes = [r["n"] for r in runs.rows.groupBy(ordered.RUN).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1000


ORDERS = {
    "double": [None, float("nan"), float("-inf"), float("inf"), -0.5, 2.0],
    "string": [None, "", "a", "b", "aa", "é"],
    "date": [None, "1970-01-01", "2024-02-29", "1900-01-01"],
    "bigint": [None, -(2**63), 2**63 - 1, 0, 5],
}


@pytest.mark.parametrize("kind", ORDERS)
@pytest.mark.parametrize("desc", [False, True])
def test_order_values_of_any_type(spark, kind, desc):
    """NaN, nulls, texts, dates and the smallest long, in runs that cut equal values."""
    rnd = random.Random(11)
    rows = [(rnd.choice(["x", "y", None]), i, rnd.choice(ORDERS[kind]), i % 7) for i in range(160)]
    first = "string" if kind == "date" else kind
    df = spark.createDataFrame(rows, f"k string, id long, v {first}, __keep int").withColumn("v", F.col("v").cast(kind))
    order = F.desc("v") if desc else F.asc("v")
    peers = Window.partitionBy("k").orderBy(order)
    want = df.select(
        "k", "id", "__keep", F.row_number().over(Window.partitionBy("k").orderBy(order, "id")).alias("rn"), F.rank().over(peers).alias("rk"),
        F.dense_rank().over(peers).alias("dr"), F.count("*").over(peers).alias("up"),
    )
    runs = ordered.split_runs(df, ["k"], "v", ["id"], desc=desc, runs=12)
    got = ordered.positions(runs, {"rn": "row_number", "rk": "rank", "dr": "dense_rank", "up": "upto"})
    assert bag(got.select(*want.columns)) == bag(want)
    whole = ordered.split_runs(df, [], "v", ["id"], desc=not desc, runs=12)
    got = ordered.reversed_positions(whole, ["k"], {"rk": "rank", "up": "upto"})
    assert bag(got.select("k", "id", "__keep", "rk", "up")) == bag(want.select("k", "id", "__keep", "rk", "up"))


@pytest.mark.parametrize("shape", [windows.row_number_percent_rank_cume, windows.ntile_dense_rank])
def test_two_orders_from_one_range_exchange(spark, shape, monkeypatch):
    """The rows are cut into runs once and written once; the plan left moves them by run only."""
    df = spark.createDataFrame(rows_with(*CASES[0]), SCHEMA)
    cuts, split = [], ordered.split_runs
    monkeypatch.setattr(ordered, "split_runs", lambda *a, **k: cuts.append(split(*a, **k)) or cuts[-1])
    out = shape(df, "k", "k", "m", None, None, ["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(cuts) == 1 and "rangepartitioning" not in plan
    assert plan.count("hashpartitioning") == 1
    assert out.count() == df.count()
