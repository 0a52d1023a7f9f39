"""Multi-step aggregates: the common-table-expression shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import ordered
from tidemark.operators.support import as_type_of, attach, since_filter, year_bounds


def total_above_threshold(df: DataFrame, group: str, metric: str, date: str, since, threshold: float) -> DataFrame:
    return (
        since_filter(df, date, since)
        .groupBy(group)
        .agg(F.sum(metric).alias("total"))
        .filter(F.col("total") > threshold)
        .orderBy(F.desc("total"))
    )


def topn_then_avg(df: DataFrame, group: str, metric: str, n: int, tie: list[str]) -> DataFrame:
    """Average of the n largest rows per group; rows beyond n are pruned before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc(metric), *tie)
    top = df.select(group, metric, *tie).withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n)
    return top.groupBy(group).agg(F.avg(metric).alias("avg_metric"), F.count(F.lit(1)).alias("n_rows"))


def year_summary_having(df: DataFrame, group: str, metric: str, date: str, year: int, min_rows: int = 2) -> DataFrame:
    return (
        df.filter(year_bounds(df, date, year))
        .groupBy(group)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.max(metric).alias("max_metric"),
            F.min(metric).alias("min_metric"),
        )
        .filter(F.col("n_rows") > min_rows)
        .orderBy(F.desc("max_metric"))
    )


def recent_avg_vs_min(df: DataFrame, group: str, metric: str, date: str, as_of, months: int = 6, factor: float = 1.5) -> DataFrame:
    start = F.add_months(F.lit(str(as_of)).cast("date"), -months).cast(df.schema[date].dataType)
    return (
        df.filter(F.col(date) >= start)
        .groupBy(group)
        .agg(F.avg(metric).alias("avg_metric"), F.min(metric).alias("min_metric"), F.max(metric).alias("max_metric"))
        .filter(F.col("avg_metric") > F.col("min_metric") * factor)
    )


def best_month(df: DataFrame, group: str, metric: str, date: str, since) -> DataFrame:
    monthly = (
        since_filter(df, date, since)
        .groupBy(group, F.trunc(date, "month").alias("__m"))
        .agg(F.sum(metric).alias("monthly_total"))
    )
    w = Window.partitionBy(group).orderBy(F.desc("monthly_total"))
    return (
        monthly.withColumn("__r", F.rank().over(w))
        .filter(F.col("__r") == 1)
        .select(group, F.date_format("__m", "yyyy-MM").alias("month"), "monthly_total")
    )


def sigma_outlier_count(df: DataFrame, group: str, metric: str, date: str, since, k: float = 2.0) -> DataFrame:
    rows = since_filter(df, date, since).select(group, metric)
    stats = rows.groupBy(group).agg(F.avg(metric).alias("__mu"), F.stddev_samp(metric).alias("__sd"))
    far = F.abs(F.col(metric) - F.col("__mu")) > k * F.col("__sd")
    return attach(rows, stats, group).filter(far).groupBy(group).agg(F.count(F.lit(1)).alias("outlier_count"))


def half_year_change(df: DataFrame, group: str, metric: str, date: str, year: int) -> DataFrame:
    mid = as_type_of(df, date, f"{year}-07-01")
    halves = (
        df.filter(year_bounds(df, date, year))
        .groupBy(group)
        .agg(
            F.sum(F.when(F.col(date) < mid, F.col(metric)).otherwise(0)).alias("first_half"),
            F.sum(F.when(F.col(date) >= mid, F.col(metric)).otherwise(0)).alias("second_half"),
        )
        .filter(F.col("first_half") > 0)
    )
    change = F.col("second_half") - F.col("first_half")
    return halves.select(
        group,
        "first_half",
        "second_half",
        change.alias("difference"),
        F.round(F.try_divide(change, F.col("first_half")) * 100, 2).alias("pct_change"),
    ).orderBy(F.desc("pct_change"))


def yearly_growth_lag(df: DataFrame, group: str, metric: str, date: str, from_year: int) -> DataFrame:
    yearly = df.groupBy(F.year(date).alias("year"), group).agg(F.sum(metric).alias("yearly_total"))
    w = Window.partitionBy(group).orderBy("year")
    return (
        yearly.withColumn("prev_year_total", F.lag("yearly_total").over(w))
        .withColumn("growth", F.col("yearly_total") - F.col("prev_year_total"))
        .filter((F.col("year") >= from_year) & F.col("growth").isNotNull())
        .orderBy(F.desc("growth"))
    )


def significant_categories(
    df: DataFrame, group: str, metric: str, date: str, since, min_rows: int = 5, min_ratio: float = 0.2
) -> DataFrame:
    return (
        since_filter(df, date, since)
        .groupBy(group)
        .agg(
            F.count(F.lit(1)).alias("record_count"),
            F.avg(metric).alias("avg_metric"),
            F.stddev_samp(metric).alias("std_metric"),
        )
        .filter((F.col("record_count") >= min_rows) & (F.col("std_metric") > F.col("avg_metric") * min_ratio))
        .orderBy(F.desc("std_metric"))
    )


def top2_quarters(df: DataFrame, group: str, metric: str, date: str, year: int, n: int = 2) -> DataFrame:
    in_year = (F.col(date) >= as_type_of(df, date, f"{year}-01-01")) & (F.col(date) < as_type_of(df, date, f"{year + 1}-01-01"))
    quarterly = (
        df.filter(in_year)
        .groupBy(group, F.concat(F.year(date), F.lit("-Q"), F.quarter(date)).alias("quarter"))
        .agg(F.sum(metric).alias("quarterly_total"), F.count(F.lit(1)).alias("transaction_count"))
    )
    w = Window.partitionBy(group).orderBy(F.desc("quarterly_total"), "quarter")
    return quarterly.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def cohort_month_avg(df: DataFrame, group: str, metric: str, date: str, since) -> DataFrame:
    cohorts = (
        since_filter(df, date, since)
        .groupBy(group, F.trunc(date, "month").alias("__m"))
        .agg(F.avg(metric).alias("cohort_avg"))
    )
    return (
        cohorts.groupBy(F.date_format("__m", "yyyy-MM").alias("cohort_month"))
        .agg(
            F.avg("cohort_avg").alias("overall_avg"),
            F.max("cohort_avg").alias("max_avg"),
            F.min("cohort_avg").alias("min_avg"),
        )
        .orderBy("cohort_month")
    )


def milestone_date(df: DataFrame, group: str, metric: str, date: str, since, threshold: float) -> DataFrame:
    """First date at which the running total reaches the threshold (rows of one date are peers)."""
    daily = since_filter(df, date, since).groupBy(group, date).agg(F.sum(metric).alias("day_total"))
    runs = ordered.split_runs(daily, [group], date, [])
    running = ordered.positions(runs, {"running_sum": "running_sum"}, metric="day_total")
    return (
        running.filter(F.col("running_sum") >= threshold)
        .groupBy(group)
        .agg(F.min(date).alias("milestone_date"))
        .orderBy("milestone_date")
    )


def volatility_class(df: DataFrame, group: str, metric: str, date: str, since, high: float = 0.5, medium: float = 0.2) -> DataFrame:
    daily = since_filter(df, date, since).groupBy(group, F.to_date(date).alias("__d")).agg(F.sum(metric).alias("daily_total"))
    stats = daily.groupBy(group).agg(
        F.avg("daily_total").alias("avg_daily"),
        F.stddev_samp("daily_total").alias("std_daily"),
        (F.max("daily_total") - F.min("daily_total")).alias("range_daily"),
    )
    cv = F.try_divide(F.col("std_daily"), F.col("avg_daily"))
    label = F.when(cv > high, "High Volatility").when(cv > medium, "Medium Volatility").otherwise("Low Volatility")
    return stats.withColumn("volatility_category", label).orderBy(cv.desc())


def top_and_bottom(df: DataFrame, group: str, metric: str, date: str, since, n: int) -> DataFrame:
    totals = since_filter(df, date, since).groupBy(group).agg(F.sum(metric).alias("total"))
    top = totals.orderBy(F.desc("total"), group).limit(n).select(F.lit("Top Performers").alias("category"), group, "total")
    bottom = totals.orderBy("total", group).limit(n).select(F.lit("Bottom Performers").alias("category"), group, "total")
    return top.unionByName(bottom).orderBy(F.desc("category"), F.desc("total"))


def weekly_trend_corr(df: DataFrame, group: str, metric: str, date: str, since, min_weeks: int = 10) -> DataFrame:
    week = F.extract(F.lit("YEAROFWEEK"), F.col(date)) * 100 + F.weekofyear(date)
    weekly = since_filter(df, date, since).groupBy(group, week.alias("year_week")).agg(F.sum(metric).alias("weekly_total"))
    trend = (
        weekly.groupBy(group)
        .agg(F.corr("year_week", "weekly_total").alias("trend_correlation"), F.count(F.lit(1)).alias("week_count"))
        .filter(F.col("week_count") >= min_weeks)
    )
    c = F.col("trend_correlation")
    label = (
        F.when(c > 0.5, "Strong Upward").when(c > 0, "Weak Upward").when(c > -0.5, "Weak Downward").otherwise("Strong Downward")
    )
    return trend.select(group, "trend_correlation", label.alias("trend_direction")).orderBy(F.abs(c).desc())
