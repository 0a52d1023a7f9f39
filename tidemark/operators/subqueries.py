"""Subquery shapes, rewritten as aggregates, semi joins and scalar subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import selection
from tidemark.operators.support import as_type_of, attach, since_filter
from tidemark.session import materialise


def above_global_avg(df: DataFrame, group: str, metric: str, date: str, since) -> DataFrame:
    mean = df.agg(F.avg(metric)).scalar()
    return since_filter(df, date, since).filter(F.col(metric) > mean).select(group, metric)


def correlated_child_stats(parent, child, pk, fk, group, metric, metric2) -> DataFrame:
    """One aggregation of the child replaces three correlated subqueries over it."""
    stats = child.groupBy(F.col(fk).alias(pk)).agg(
        F.count(F.lit(1)).alias("related_count"), F.avg(metric2).alias("avg_related")
    )
    return parent.select(pk, group, metric).join(stats, pk).select(group, metric, "related_count", "avg_related")


def ge_latest_in_group(df, group, metric, date, since, tie) -> DataFrame:
    latest = df.groupBy(group).agg(F.max_by(metric, F.struct(date, *tie)).alias("__latest"))
    rows = since_filter(df, date, since).select(group, metric, date)
    return attach(rows, latest, group).filter(F.col(metric) >= F.col("__latest")).select(group, metric, date)


def in_big_groups(df, group, metric, date, since, threshold: float) -> DataFrame:
    """Both levels read the same rows, so one grouping answers the IN and the outer aggregate."""
    return (
        since_filter(df, date, since)
        .groupBy(group)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.avg(metric).alias("avg_metric"),
            F.sum(metric).alias("__sum"),
        )
        .filter((F.col("__sum") > threshold) & F.col(group).isNotNull())
        .drop("__sum")
        .orderBy(F.desc("avg_metric"))
    )


def group_max_rows(df, group, metric, date, since) -> DataFrame:
    rows = since_filter(df, date, since).select(group, metric, date)
    top = rows.groupBy(group).agg(F.max(metric).alias("__max"))
    return attach(rows, top, group).filter(F.col(metric) == F.col("__max")).select(group, metric, date)


def gt_all_prior(df, group, metric, date, since, days: int = 90) -> DataFrame:
    """Rows above every value of their group in the previous ``days`` days.

    Time is cut into hours.  What a row looks back on is the whole hours in between, the
    part of its own hour before it and the part of the oldest hour within reach: the first
    comes from one maximum per (group, hour), the other two from windows within an hour.
    No window holds a whole group.  A null in the range makes the comparison unknown and
    drops the row.
    """
    unit = 3_600_000_000
    reach = days * 24
    micros = F.unix_micros(F.col(date).cast("timestamp"))
    seen = df
    if since is not None:  # rows from `since` on look back this far
        seen = df.filter(F.col(date) >= F.date_sub(F.lit(str(since)).cast("date"), days).cast(df.schema[date].dataType))
    peaks = (
        seen.filter(F.col(date).isNotNull() & F.col(group).isNotNull())
        .groupBy(group, date)
        .agg(F.max(metric).alias("__peak"), F.max(F.col(metric).isNull()).alias("__null"))
        .withColumn("__t", micros)
        .withColumn("__u", F.floor(F.col("__t") / F.lit(unit)))
    )
    hours = peaks.groupBy(group, "__u").agg(F.max("__peak").alias("__peak"), F.max("__null").alias("__null"))
    between = Window.partitionBy(group).orderBy("__u").rangeBetween(-(reach - 1), -1)  # one row per hour
    hours = hours.select(
        group, "__u", F.max("__peak").over(between).alias("__mid"), F.max("__null").over(between).alias("__mid_null")
    )
    # the oldest hour, moved forward by the reach, meets the rows that look back on it
    old = peaks.withColumns({"__t": F.col("__t") + F.lit(reach * unit), "__u": F.col("__u") + reach, "__own": F.lit(False)})
    both = peaks.withColumn("__own", F.lit(True)).unionByName(old)
    hour = Window.partitionBy(group, "__u").orderBy("__t")
    before = hour.rangeBetween(Window.unboundedPreceding, -1)
    within = hour.rangeBetween(0, Window.unboundedFollowing)

    def own(c):
        return F.max(F.when(F.col("__own"), F.col(c))).over(before)

    def aged(c):
        return F.max(F.when(~F.col("__own"), F.col(c))).over(within)

    bars = (
        both.withColumns({"__cur": own("__peak"), "__cur_null": own("__null"), "__far": aged("__peak"), "__far_null": aged("__null")})
        .filter("__own")
        .join(hours, [group, "__u"])
        .select(
            group,
            date,
            F.greatest("__mid", "__cur", "__far").alias("__bar"),
            F.greatest(*[F.coalesce(F.col(c), F.lit(False)) for c in ("__mid_null", "__cur_null", "__far_null")]).alias("__unknown"),
        )
    )
    rows = since_filter(df, date, since).select(group, date, metric)
    kept = rows.join(bars, [group, date]).filter(~F.col("__unknown") & (F.col("__bar").isNull() | (F.col(metric) > F.col("__bar"))))
    return kept.select(group, metric)


def _greater_counts(values: DataFrame, metric: str, bars: DataFrame, name: str) -> DataFrame:
    """For the few rows of ``bars``: how many of ``values`` exceed their metric.

    One scan; each value is counted under the number of bars it beats.
    """
    bar_list = bars.agg(F.array_sort(F.collect_set(metric))).scalar()
    beaten = (
        values.select(metric, bar_list.alias("bars"))
        .filter(F.col(metric) > F.element_at("bars", 1))
        .select(F.size(F.filter("bars", lambda b: b < F.col(metric))).alias("k"))
        .groupBy("k")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    counts = beaten.agg(F.collect_list(F.struct("k", "c"))).scalar()
    place = F.array_position("__bars", F.col(metric))
    above = F.filter("__counts", lambda e: e["k"] >= place)
    total = F.aggregate(above, F.lit(0).cast("long"), lambda acc, e: acc + e["c"])
    return (
        bars.withColumn("__bars", bar_list)
        .withColumn("__counts", counts)
        .withColumn(name, total)
        .drop("__bars", "__counts")
    )


def overall_rank_topn(df, group, metric, date, since, n: int, tie) -> DataFrame:
    """Rank over the whole table of the best n rows since a date.

    The rank falls as the metric rises, so the n rows are known before any rank is; only
    their n values are compared with the table.
    """
    best = since_filter(df, date, since).select(group, metric, *tie).orderBy(F.desc(metric), *tie).limit(n)
    best = materialise(best)
    ranked = _greater_counts(df, metric, best, "__greater")
    return ranked.select(group, metric, (F.col("__greater") + 1).alias("overall_rank")).orderBy("overall_rank")


def above_q3(df, group, metric, date, since, q: float = 0.75) -> DataFrame:
    rows = since_filter(df, date, since)
    bar = selection.percentiles(rows, [], metric, [q], ["q"]).scalar()
    return rows.select(group, metric, date).filter(F.col(metric) > bar)


def group_vs_overall_avg(df, group, metric, date, since) -> DataFrame:
    overall = df.agg(F.avg(metric)).scalar()
    return (
        since_filter(df, date, since)
        .groupBy(group)
        .agg(F.count(F.lit(1)).alias("total_records"), F.avg(metric).alias("avg_metric"))
        .withColumn("overall_avg", overall)
        .withColumn("avg_difference", F.col("avg_metric") - F.col("overall_avg"))
        .filter(F.col("avg_difference") > 0)
        .orderBy(F.desc("avg_difference"))
    )


def exists_high_child(parent, child, pk, fk, cols, metric2, threshold: float) -> DataFrame:
    high = child.filter(F.col(metric2) > threshold).select(F.col(fk).alias(pk)).distinct()
    return parent.select(pk, *cols).join(high, pk, "left_semi").select(*cols)


def distinct_better_groups(df, group, metric, date, since, n: int, tie) -> DataFrame:
    """A group beats a row when its maximum does, so only group maxima are compared."""
    best = since_filter(df, date, since).select(group, metric, *tie).orderBy(F.desc(metric), *tie).limit(n)
    best = materialise(best)
    maxima = df.groupBy(group).agg(F.max(metric).alias(metric)).filter(F.col(group).isNotNull())
    groups = df.agg(F.count_distinct(group)).scalar()
    scored = _greater_counts(maxima, metric, best, "better_count").withColumn("total_count", groups)
    return scored.select(
        group,
        metric,
        "better_count",
        "total_count",
        F.round(F.col("better_count") * 100.0 / F.col("total_count"), 2).alias("percentile"),
    ).orderBy("percentile")


def pct_of_total_ge(df, group, metric, date, since, min_pct: float = 5.0) -> DataFrame:
    sums = since_filter(df, date, since).groupBy(group).agg(F.sum(metric).alias("total_metric"))
    grand = sums.agg(F.sum("total_metric")).scalar()
    return (
        sums.withColumn("grand_total", grand)
        .filter(F.col("total_metric") * 100.0 / F.col("grand_total") >= min_pct)
        .withColumn("pct_of_total", F.round(F.col("total_metric") * 100.0 / F.col("grand_total"), 2))
        .orderBy(F.desc("pct_of_total"))
    )


def repeated_metric_rows(df, group, metric, date, since, min_times: int = 2) -> DataFrame:
    rows = since_filter(df, date, since).select(group, metric, date)
    often = rows.groupBy(metric).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= min_times).select(metric)
    return rows.join(often, metric, "left_semi").select(group, metric, date)


def recent_and_lifetime(parent, child, pk, fk, group, metric, metric2, d2, since, min_recent: int = 3) -> DataFrame:
    recent = F.count_if(F.col(d2) >= as_type_of(child, d2, since))
    stats = (
        child.groupBy(F.col(fk).alias(pk))
        .agg(recent.alias("recent_count"), F.sum(metric2).alias("lifetime_total"))
        .filter(F.col("recent_count") >= min_recent)
    )
    both = parent.select(pk, group, metric).join(stats, pk)
    return both.select(group, metric, "recent_count", "lifetime_total").orderBy(F.desc("recent_count"))


def group_avg_far_from_mean(df, group, metric, date, since, k: float = 1.0) -> DataFrame:
    rows = since_filter(df, date, since)
    overall = rows.agg(F.struct(F.avg(metric).alias("mu"), F.stddev_samp(metric).alias("sd"))).scalar()
    return (
        rows.groupBy(group)
        .agg(F.avg(metric).alias("avg_metric"))
        .withColumn("__o", overall)
        .withColumn("overall_stddev", F.col("__o.sd"))
        .withColumn("__gap", F.abs(F.col("avg_metric") - F.col("__o.mu")))
        .filter(F.col("__gap") > k * F.col("overall_stddev"))
        .orderBy(F.desc("__gap"))
        .select(group, "avg_metric", "overall_stddev")
    )
