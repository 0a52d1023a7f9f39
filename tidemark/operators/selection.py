"""Exact percentiles by bucket selection: the input is counted, never sorted.

A first pass counts rows per (group, bucket of the value), with the smallest and largest value of
each bucket; counts are combined within tasks, so what is shuffled is bucket tables.  Running
counts over the buckets of a group tell which ones hold the wanted positions.  While such a
bucket has more than SORTED rows of different values, another pass cuts it into BUCKETS parts
between its smallest and largest value.  Then only the rows of the wanted buckets are counted by
value and put in order, one bucket at a time.

The first buckets are equal steps of the logarithm, so they need no pass over the data to find its
range; within one of them values agree in sign and to about one and a half percent, so that
four more passes tell any two doubles apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.support import join_null_safe
from tidemark.session import discard, materialise

#: Steps of the natural logarithm in a unit, parts of a bucket, rows of a bucket that are put in order.
STEPS, BUCKETS, SORTED = 64, 4096, 200_000
_ALL = "__all"


def log_bucket(v: Column) -> Column:
    """Bucket of a double; larger values never have a smaller one, NaN is the largest."""
    step = F.floor(F.signum(v) * F.log1p(F.abs(v)) * STEPS)
    return F.when(F.isnan(v), F.lit(1 << 40)).when(F.abs(v) == float("inf"), F.signum(v).cast("long") * (1 << 39)).otherwise(step)


def _part(v: Column, lo: Column, hi: Column) -> Column:
    return F.when(hi > lo, F.least(F.floor((v - lo) / (hi - lo) * BUCKETS), F.lit(BUCKETS - 1))).otherwise(F.lit(0).cast("long"))


def _positions(total: Column, qs: Sequence[float]) -> Column:
    """Places (from 0) of the rows that the percentiles lie between."""
    at = [F.lit(float(q)) * (total - 1) for q in qs]
    return F.array_distinct(F.array(*[f(a).cast("long") for a in at for f in (F.floor, F.ceil)]))


def _holding(counts: DataFrame, path: list[str], order: str, qs: Sequence[float]) -> DataFrame:
    """Buckets with a wanted position: ``counts (path, order, n, lo, hi, __first, __total)`` with ``__before`` and ``__at``."""
    earlier = F.sum("n").over(Window.partitionBy(*path).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    placed = counts.withColumn("__before", F.col("__first") + F.coalesce(earlier, F.lit(0)))
    here = F.filter(_positions(F.col("__total"), qs), lambda i: (i >= F.col("__before")) & (i < F.col("__before") + F.col("n")))
    return placed.withColumn("__at", here).filter(F.size("__at") > 0)


def percentiles(df: DataFrame, part: Sequence[str], value: str, qs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Exact linearly interpolated percentiles per group of ``part`` as doubles, nulls left out.

    NaN counts as the largest value; a null group is a group.  Without rows there is no group.
    """
    part = list(part)
    key = part or [_ALL]
    rows = df.filter(F.col(value).isNotNull()).select(*part, *([] if part else [F.lit(0).alias(_ALL)]), F.col(value).cast("double").alias("__v"))
    measures = [F.count(F.lit(1)).alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi")]
    path, step = list(key), "__c0"
    rows = rows.withColumn(step, log_bucket(F.col("__v")))
    counts = rows.groupBy(*path, step).agg(*measures)
    counts = counts.withColumns({"__total": F.sum("n").over(Window.partitionBy(*key)), "__first": F.lit(0).cast("long")})
    cells = materialise(_holding(counts, path, step, qs))
    spent = [cells]
    while True:
        path.append(step)
        rows = join_null_safe(rows, cells.select(*path, "lo", "hi"), path)
        if not cells.filter((F.col("n") > SORTED) & (F.col("lo") < F.col("hi"))).limit(1).count():
            break
        step = f"__c{len(path) - len(key)}"
        rows = rows.withColumn(step, _part(F.col("__v"), F.col("lo"), F.col("hi"))).drop("lo", "hi")
        counts = rows.groupBy(*path, step).agg(*measures)
        counts = join_null_safe(counts, cells.select(*path, "__total", F.col("__before").alias("__first")), path)
        cells = materialise(_holding(counts, path, step, qs))
        spent.append(cells)
    values = rows.groupBy(*path, "__v").agg(F.count(F.lit(1)).alias("n"))
    values = join_null_safe(values, cells.select(*path, "__total", F.col("__before").alias("__first")), path)
    found = _holding(values, path, "__v", qs).select(*key, "__v", "__total", F.explode("__at").alias("__i"))
    picks = []
    for q, name in zip(qs, names):
        at = F.lit(float(q)) * (F.col("__total") - 1)
        low = F.max(F.when(F.col("__i") == F.floor(at), F.col("__v")))
        high = F.max(F.when(F.col("__i") == F.ceil(at), F.col("__v")))
        # equal neighbours need no interpolation, which infinities would spoil
        picks.append(F.when(low == high, low).otherwise(low + (high - low) * F.max(at - F.floor(at))).alias(name))
    out = materialise(found.groupBy(*key).agg(*picks).select(*part, *names))
    discard(*spent)
    return out
