"""Set operations between one value column of each of two tables.

Both sides are reduced to distinct (or per-value) rows before they meet, so a value that
fills a third of a table costs one row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.support import as_type_of, since_filter


def _values(df: DataFrame, value: str) -> DataFrame:
    return df.select(F.col(value).alias("value"))


def union_distinct_values(left: DataFrame, right: DataFrame, v1: str, v2: str) -> DataFrame:
    both = _values(left, v1).distinct().union(_values(right, v2).distinct())
    return both.filter(F.col("value").isNotNull()).distinct()


def intersect(left: DataFrame, right: DataFrame, v1: str, v2: str) -> DataFrame:
    return _values(left, v1).distinct().intersect(_values(right, v2).distinct())


def except_(left: DataFrame, right: DataFrame, v1: str, v2: str) -> DataFrame:
    return _values(left, v1).distinct().subtract(_values(right, v2).distinct())


def union_all_counts(left: DataFrame, right: DataFrame, v1: str, v2: str) -> DataFrame:
    def counts(df, v):
        return _values(df, v).groupBy("value").agg(F.count(F.lit(1)).alias("n_rows"))

    return counts(left, v1).unionByName(counts(right, v2)).orderBy(F.desc("n_rows"))


def topn_each_side(left, right, v1, v2, m1, m2, d1, d2, since, n: int) -> DataFrame:
    def top(df, v, m, d):
        rows = since_filter(df, d, since).select(F.col(v).alias("value"), F.col(m).alias("metric"))
        return rows.orderBy(F.desc("metric"), "value").limit(n)

    return top(left, v1, m1, d1).unionByName(top(right, v2, m2, d2)).orderBy(F.desc("metric"))


def overlap_summary(left, right, v1, v2, left_name: str, right_name: str) -> DataFrame:
    """Three counts from one grouping of the distinct keys (nulls are one value, as in set operations)."""
    a = _values(left, v1).distinct().withColumn("side", F.lit(1))
    b = _values(right, v2).distinct().withColumn("side", F.lit(2))
    sides = a.unionByName(b).groupBy("value").agg(F.sum("side").alias("s"))
    counts = sides.agg(*[F.count_if(F.col("s") == k).alias(f"c{k}") for k in (1, 2, 3)])
    label = f"'Only in {left_name}', c1, 'Only in {right_name}', c2, 'In both tables', c3"
    return counts.selectExpr(f"stack(3, {label}) as (source, n_values)")


def activity_status(left, right, v1, v2, d1, d2, since, left_name: str, right_name: str) -> DataFrame:
    a = _values(since_filter(left, d1, since), v1).distinct().withColumn("status", F.lit(f"Active in {left_name}"))
    b = _values(since_filter(right, d2, since), v2).distinct().withColumn("status", F.lit(f"Active in {right_name}"))
    return a.unionByName(b).distinct().orderBy("value", "status")


def max_each_side(left, right, v1, v2, m1, m2) -> DataFrame:
    def top(df, v, m):
        return df.groupBy(F.col(v).alias("value")).agg(F.max(m).alias("max_value"))

    return top(left, v1, m1).unionByName(top(right, v2, m2)).orderBy("value", F.desc("max_value"))


def intersect_above(left, right, v1, v2, m1, m2, threshold: float) -> DataFrame:
    a = _values(left.filter(F.col(m1) > threshold), v1).distinct()
    b = _values(right.filter(F.col(m2) > threshold), v2).distinct()
    return a.intersect(b)


def singletons_of_union(left, right, v1, v2) -> DataFrame:
    both = _values(left, v1).union(_values(right, v2))
    return both.groupBy("value").agg(F.count(F.lit(1)).alias("frequency")).filter(F.col("frequency") == 1)


def labelled_totals(left, right, v1, v2, m1, m2, d1, d2, since, left_name: str, right_name: str) -> DataFrame:
    def totals(df, v, m, d, name):
        sums = since_filter(df, d, since).groupBy(F.col(v).alias("value")).agg(F.sum(m).alias("total"))
        return sums.select(F.lit(name).alias("source"), "value", "total")

    both = totals(left, v1, m1, d1, left_name).unionByName(totals(right, v2, m2, d2, right_name))
    return both.orderBy("value", "source")


def new_vs_old_except(left, right, v1, v2, d1, d2, since) -> DataFrame:
    new = _values(since_filter(left, d1, since), v1).distinct()
    old = _values(right.filter(F.col(d2) < as_type_of(right, d2, since)), v2).distinct()
    return new.subtract(old)


def union_high_avg(left, right, v1, v2, m1, m2, threshold: float) -> DataFrame:
    def high(df, v, m):
        means = df.groupBy(F.col(v).alias("value")).agg(F.avg(m).alias("avg_metric"))
        return means.filter(F.col("avg_metric") > threshold)

    return high(left, v1, m1).unionByName(high(right, v2, m2)).distinct().orderBy(F.desc("avg_metric"))


def common_vs_unique(left, right, v1, v2, left_name: str) -> DataFrame:
    """Every left value labelled by whether the right side has it; the set has one record per value."""
    a = _values(left, v1).distinct().withColumn("side", F.lit(1))
    b = _values(right, v2).distinct().withColumn("side", F.lit(2))
    sides = a.unionByName(b).groupBy("value").agg(F.sum("side").alias("s")).filter(F.col("s") != 2)
    label = F.when(F.col("s") == 3, "Common").otherwise(f"Unique to {left_name}")
    return sides.select("value", label.alias("category"), F.lit(1).cast("long").alias("record_count"))


def union_topn(left, right, v1, v2, m1, m2, d1, d2, since, threshold: float, n: int) -> DataFrame:
    def pairs(df, v, m, d):
        rows = since_filter(df.filter(F.col(m) >= threshold), d, since)
        return rows.select(F.col(v).alias("value"), F.col(m).alias("metric"))

    both = pairs(left, v1, m1, d1).unionByName(pairs(right, v2, m2, d2)).distinct()
    return both.orderBy(F.desc("metric"), "value").limit(n)
