"""Percentiles by bucket selection against sorted values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordered, selection

QS = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
NAMES = [f"q{i}" for i in range(len(QS))]


def values(seed: int) -> list[tuple]:
    """Groups with one value, few values, a hot value, close values, wide ranges, both signs, nulls and a null group."""
    rng = random.Random(seed)
    rows = [("one", 3.5), ("nothing", None), ("two", 1.0), ("two", -2.0)]
    rows += [(None, float(rng.randrange(5))) for _ in range(40)]
    rows += [("hot", 7.0)] * 300 + [("hot", rng.random()) for _ in range(60)]
    rows += [("close", 1.0 + i * 2**-52) for i in range(200)]
    rows += [("wide", rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300)) for _ in range(200)]
    rows += [("small", rng.random() * 1e-9) for _ in range(200)]
    rows += [("money", round(rng.lognormvariate(8, 2), 2)) for _ in range(500)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [200_000, 3])
def test_percentiles_are_those_of_sorted_values(spark, monkeypatch, limit):
    monkeypatch.setattr(selection, "SORTED", limit)
    monkeypatch.setattr(ordered, "split_runs", None)  # nothing is range-sorted
    rows = values(1)
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: [r[n] for n in NAMES] for r in selection.percentiles(df, ["k"], "v", QS, NAMES).collect()}
    assert set(got) == {k for k, v in rows if v is not None}
    for key in got:
        assert np.allclose(got[key], np.quantile([v for k, v in rows if k == key and v is not None], QS), rtol=1e-14, atol=0), key
    whole = selection.percentiles(df, [], "v", QS, NAMES).collect()
    assert len(whole) == 1 and np.allclose(whole[0], np.quantile([v for _, v in rows if v is not None], QS))


def test_percentiles_of_other_types_and_ends(spark):
    ints = spark.range(101).selectExpr("id % 2 = 0 as even", "cast(id as decimal(18,2)) as v")
    assert [tuple(r) for r in selection.percentiles(ints, ["even"], "v", [0.5, 1], ["a", "b"]).orderBy("even").collect()] == [(False, 50.0, 99.0), (True, 50.0, 100.0)]
    ends = spark.createDataFrame([(x,) for x in (math.inf, -math.inf, 0.0, math.nan, 5.0)], "v double")
    row = selection.percentiles(ends, [], "v", [0, 0.25, 0.5, 0.75, 1], list("abcde")).first()
    assert row[:4] == (-math.inf, 0.0, 5.0, math.inf) and math.isnan(row[4])
    assert selection.percentiles(ends.limit(0), [], "v", [0.5], ["a"]).collect() == []


def test_buckets_keep_the_order(spark):
    rng = random.Random(2)
    sample = sorted([rng.uniform(-1, 1) * 10.0 ** rng.randint(-20, 20) for _ in range(2000)] + [0.0, -math.inf, math.inf])
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(sample)], "i int, v double").select("i", selection.log_bucket(F.col("v")).alias("b"))
    found = [r["b"] for r in rows.orderBy("i").collect()]
    assert found == sorted(found) and len(set(found)) > 500
