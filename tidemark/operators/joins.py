"""Fact-to-dimension join shapes.

``fact`` carries the foreign key, ``dim`` the primary key.  Where the result is an
aggregate, the fact side is aggregated by (foreign key, group) before the join, so a
foreign key that holds a third of the rows reaches the join as a few rows; the join
itself is left to Catalyst (broadcast when the dimension is small by its file
statistics, otherwise a shuffle join with AQE skew splitting).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import ordered, selection
from tidemark.operators.support import as_type_of, attach, join_null_safe, since_filter
from tidemark.session import materialise


def _dim(dim: DataFrame, pk: str, *cols: str) -> DataFrame:
    return dim.select(F.col(pk).alias("__pk"), *cols)


def _joined(fact, dim, fk, pk, *dim_cols, how="inner") -> DataFrame:
    return fact.join(_dim(dim, pk, *dim_cols), F.col(fk) == F.col("__pk"), how)


def inner_total_topn(fact, dim, fk, pk, g1, g2, metric, date, since, n: int) -> DataFrame:
    part = since_filter(fact, date, since).groupBy(fk, g1).agg(F.sum(metric).alias("__s"))
    totals = _joined(part, dim, fk, pk, g2).groupBy(g1, g2).agg(F.sum("__s").alias("total"))
    return totals.orderBy(F.desc("total"), g1, g2).limit(n)


def left_matched_avg(fact, dim, fk, pk, g1, g2, metric, min_rows: int = 3) -> DataFrame:
    part = fact.groupBy(fk, g1).agg(
        F.sum(metric).alias("__s"), F.count(metric).alias("__c"), F.count(F.lit(1)).alias("__n")
    )
    both = _joined(part, dim, fk, pk, g2, how="left").filter(F.col("__pk").isNotNull())
    return (
        both.groupBy(g1, g2)
        .agg((F.try_divide(F.sum("__s"), F.sum("__c"))).alias("avg_metric"), F.sum("__n").alias("record_count"))
        .filter(F.col("record_count") >= min_rows)
        .orderBy(F.desc("avg_metric"))
    )


def related_distinct_count(fact, dim, fk, pk, g1, metric, date, since, threshold: float) -> DataFrame:
    part = since_filter(fact, date, since).groupBy(g1, fk).agg(F.max(metric).alias("__mx"))
    both = _joined(part, dim, fk, pk)
    return (
        both.groupBy(g1)
        .agg(F.count_distinct("__pk").alias("related_count"), F.max("__mx").alias("max_metric"))
        .filter(F.col("max_metric") > threshold)
    )


def share_of_total(fact, dim, fk, pk, g1, g2, metric, date, since, threshold: float) -> DataFrame:
    part = since_filter(fact, date, since).groupBy(fk, g1).agg(F.sum(metric).alias("__s"))
    pairs = (
        _joined(part, dim, fk, pk, g2)
        .groupBy(g1, g2)
        .agg(F.sum("__s").alias("total"))
        .filter(F.col("total") > threshold)
    )
    grand = pairs.agg(F.sum("total")).scalar()
    return pairs.withColumn("percentage", F.round(F.col("total") * 100.0 / grand, 2)).orderBy(F.desc("percentage"))


def right_stats(fact, dim, fk, pk, g1, g2, metric, date) -> DataFrame:
    both = _joined(fact.select(fk, g1, metric, date), dim, fk, pk, g2, how="right").filter(F.col(date).isNotNull())
    return (
        both.groupBy(g1, g2)
        .agg(
            F.avg(metric).alias("avg_metric"),
            F.min(metric).alias("min_metric"),
            F.max(metric).alias("max_metric"),
            F.stddev_samp(metric).alias("stddev_metric"),
        )
        .orderBy(F.desc("avg_metric"))
    )


def full_outer_activity(fact, dim, fk, pk, pk1, g1, g2, metric, d1, d2, since) -> DataFrame:
    """Full outer join written as left join plus unmatched right rows.

    AQE can split a skewed key of a left join but not of a full outer join.
    """
    since1, since2 = as_type_of(fact, d1, since), as_type_of(dim, d2, since)
    right = dim.select(F.col(pk).alias("__pk"), F.col(g2), F.col(d2).alias("__d2"))
    matched = fact.select(fk, F.col(pk1).alias("__pk1"), g1, metric, F.col(d1).alias("__d1")).join(
        right, F.col(fk) == F.col("__pk"), "left"
    )
    kept = matched.filter((F.col("__d1") >= since1) | (F.col("__d2") >= since2)).select(g1, g2, "__pk1", metric)
    keys = fact.select(F.col(fk).alias("__pk")).distinct()
    lonely = right.filter(F.col("__d2") >= since2).join(keys, "__pk", "left_anti")
    lonely = lonely.select(
        *[F.lit(None).cast(fact.schema[c].dataType).alias(c) for c in (g1,)],
        g2,
        F.lit(None).cast(fact.schema[pk1].dataType).alias("__pk1"),
        F.lit(None).cast(fact.schema[metric].dataType).alias(metric),
    )
    return (
        kept.unionByName(lonely)
        .groupBy(g1, g2)
        .agg(F.count_distinct("__pk1").alias("unique_records"), F.sum(metric).alias("total_metric"))
        .orderBy(F.desc_nulls_last("total_metric"))
    )


def above_avg_with_group_avg(fact, dim, fk, pk, g1, g2, metric, date, since) -> DataFrame:
    """Rows above the mean of the whole table, next to the mean of such rows in their partner group."""
    mean = fact.agg(F.avg(metric)).scalar()
    rows = since_filter(fact, date, since).filter(F.col(metric) > mean)
    both = _joined(rows, dim, fk, pk, g2).select(g1, g2, F.col(metric).alias("table1_metric"))
    stats = both.groupBy(g2).agg(F.avg("table1_metric").alias("avg_by_table2"))
    return attach(both, stats, g2).select(g1, g2, "table1_metric", "avg_by_table2")


def high_value_rate(fact, dim, fk, pk, pk1, g2, metric, date, since, threshold: float) -> DataFrame:
    """Fact keys per group, their rows above the threshold and the share of these in the left join's rows.

    Facts are added up by foreign key before they meet the dimension, distinct keys are counted
    in two levels, and dimension rows without facts are a part of their own.
    """
    recent = fact.filter((F.col(date) >= as_type_of(fact, date, since)) | F.col(date).isNull())
    high = F.count_if(F.col(metric) > threshold)
    dims = _dim(dim, pk, g2)
    sums = recent.groupBy(F.col(fk).alias("__fk")).agg(high.alias("high"), F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    matched = dims.join(sums, F.col("__pk") == F.col("__fk")).select(g2, zero.alias("related"), "high", "n")
    keys = recent.filter(F.col(pk1).isNotNull()).select(F.col(fk).alias("__fk"), F.col(pk1).alias("__pk1")).distinct()
    related = dims.join(keys, F.col("__pk") == F.col("__fk")).select(g2, "__pk1").distinct().select(g2, F.lit(1).cast("long").alias("related"), zero.alias("high"), zero.alias("n"))
    known = fact.select(F.col(fk).alias("__fk")).distinct()
    alone = dims.join(known, F.col("__pk") == F.col("__fk"), "left_anti").select(g2, zero.alias("related"), zero.alias("high"), F.lit(1).cast("long").alias("n"))
    both = matched.unionByName(related).unionByName(alone)
    return (
        both.groupBy(g2)
        .agg(F.sum("related").alias("related_count"), F.sum("high").alias("high_value_count"), F.sum("n").alias("__n"))
        .filter(F.col("related_count") > 0)
        .withColumn("high_value_pct", F.round(F.col("high_value_count") * 100.0 / F.col("__n"), 2))
        .drop("__n")
    )


def activity_span(fact, dim, fk, pk, g1, g2, metric, date, since, min_days: int = 30) -> DataFrame:
    part = (
        since_filter(fact, date, since)
        .groupBy(fk, g1)
        .agg(F.min(date).alias("__lo"), F.max(date).alias("__hi"), F.sum(metric).alias("__s"))
    )
    spans = (
        _joined(part, dim, fk, pk, g2)
        .groupBy(g1, g2)
        .agg(F.min("__lo").alias("first_date"), F.max("__hi").alias("last_date"), F.sum("__s").alias("total_metric"))
    )
    return (
        spans.withColumn("days_span", F.datediff("last_date", "first_date"))
        .filter(F.col("days_span") >= min_days)
        .orderBy(F.desc("days_span"))
    )


def rank_within_group(fact, dim, fk, pk, g1, g2, metric, date, since, n: int) -> DataFrame:
    """Ranks up to n only, so each map task forwards just its own leading rows."""
    both = _joined(since_filter(fact, date, since), dim, fk, pk, g2).select(g2, g1, metric)
    w = Window.partitionBy(g2).orderBy(F.desc(metric))
    return both.withColumn("rank_within_group", F.rank().over(w)).filter(F.col("rank_within_group") <= n)


def category_list(fact, dim, fk, pk, g1, g2, metric, date, since, min_categories: int = 2, page: int = 1000) -> DataFrame:
    """The categories of each group in pages of ``page`` names, so that a group with very many is several rows.

    A name's place in its group comes from range-partitioned runs; no task holds a group.
    """
    part = since_filter(fact, date, since).groupBy(fk, g1).agg(F.sum(metric).alias("__s"), F.count(metric).alias("__c"))
    pairs = materialise(_joined(part, dim, fk, pk, g2, how="left").groupBy(g1, g2).agg(F.sum("__s").alias("__s"), F.sum("__c").alias("__c")))
    groups = pairs.groupBy(g1).agg(F.count(g2).alias("distinct_categories"), F.try_divide(F.sum("__s"), F.sum("__c")).alias("avg_metric"))
    groups = materialise(groups.filter(F.col("distinct_categories") >= min_categories))
    named = pairs.filter(F.col(g2).isNotNull()).select(g1, g2)
    places = ordered.positions(ordered.split_runs(named, [g1], g2, []), {"place_": "row_number"})
    pages = places.groupBy(g1, F.floor((F.col("place_") - 1) / page).alias("page")).agg(F.array_join(F.array_sort(F.collect_list(g2)), ", ").alias("category_list"))
    both = join_null_safe(pages, groups, [g1])
    return both.select(g1, "page", "distinct_categories", "category_list", "avg_metric").orderBy(F.desc("distinct_categories"), g1, "page")


def tier_counts(fact, dim, fk, pk, g2, metric, date, since, threshold: float) -> DataFrame:
    m, third = F.col(metric), threshold / 3
    part = (
        since_filter(fact, date, since)
        .groupBy(fk)
        .agg(
            F.count_if(m.between(0, third)).alias("__lo"),
            F.count_if(m.between(third, 2 * threshold / 3)).alias("__mid"),
            F.count_if(m > 2 * threshold / 3).alias("__hi"),
        )
    )
    return (
        _joined(part, dim, fk, pk, g2)
        .groupBy(g2)
        .agg(F.sum("__lo").alias("low_tier"), F.sum("__mid").alias("mid_tier"), F.sum("__hi").alias("high_tier"))
    )


def deviation_filter(fact, dim, fk, pk, g1, g2, metric, date, since, threshold: float) -> DataFrame:
    both = _joined(since_filter(fact, date, since), dim, fk, pk, g2).select(g1, g2, metric)
    stats = both.groupBy(g2).agg(F.avg(metric).alias("__mu"))
    gap = F.col(metric) - F.col("__mu")
    return (
        attach(both, stats, g2)
        .withColumn("deviation_from_group_avg", gap)
        .filter(F.abs("deviation_from_group_avg") > threshold)
        .select(g1, g2, metric, "deviation_from_group_avg")
    )


def five_number_summary(fact, dim, fk, pk, g2, metric, date, since) -> DataFrame:
    """Exact quartiles by bucket selection."""
    both = _joined(since_filter(fact, date, since), dim, fk, pk, g2).select(g2, metric)
    names = ["min_value", "q1", "median", "q3", "max_value"]
    return selection.percentiles(both, [g2], metric, [0.0, 0.25, 0.5, 0.75, 1.0], names).orderBy(F.desc("median"))


def recent_active_count(fact, dim, fk, pk, g1, g2, date, as_of, days: int = 90) -> DataFrame:
    """A group's latest date is in the window exactly when one of its dates is, so the scan needs no others."""
    start = F.date_sub(F.lit(str(as_of)).cast("date"), days).cast(fact.schema[date].dataType)
    part = fact.filter(F.col(date) >= start).groupBy(fk, g1).agg(F.max(date).alias("__d"))
    last = _joined(part, dim, fk, pk, g2).groupBy(g1, g2).agg(F.max("__d").alias("last_activity"))
    return (
        last.groupBy(g2)
        .agg(F.count(F.lit(1)).alias("active_count"))
        .orderBy(F.desc("active_count"))
    )
