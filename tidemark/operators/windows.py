"""Window shapes.

A partition column may have three values, so no window here is keyed by it alone:

* values that are the same for a whole partition (mean, extremes, size, first, last) are
  aggregates attached to the rows;
* ``rank <= n`` filters prune every map task to its own leading rows;
* everything that depends on the order goes through :mod:`tidemark.operators.ordered`.

``tie`` names the columns that make the order total.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import ordered
from tidemark.operators.support import attach, since_filter


def rank_topn_with_avg(df, group, part, metric, date, since, n: int) -> DataFrame:
    rows = since_filter(df, date, since).select(*dict.fromkeys([group, part, metric]))
    w = Window.partitionBy(part).orderBy(F.desc(metric))
    top = rows.withColumn("rank", F.rank().over(w)).filter(F.col("rank") <= n)
    means = rows.groupBy(part).agg(F.avg(metric).alias("avg_metric"))
    return attach(top, means, part).select(group, metric, "rank", "avg_metric")


def lag_lead_change(df, group, metric, date, since, tie) -> DataFrame:
    rows = since_filter(df, date, since).select(group, date, metric, *tie)
    r = ordered.split_runs(rows, [group], date, tie)
    out = ordered.neighbours(
        r,
        {"prev_metric": lambda w: F.lag(metric).over(w), "next_metric": lambda w: F.lead(metric).over(w)},
        back=1,
        ahead=1,
    )
    return out.withColumn("change", F.col(metric) - F.col("prev_metric"))


def row_number_percent_rank_cume(df, group, part, metric, date, since, tie) -> DataFrame:
    rows = since_filter(df, date, since).select(*dict.fromkeys([group, part, metric, *tie]))
    r = ordered.split_runs(rows, [], metric, tie, desc=True)
    overall = ordered.positions(r, {"overall_rank": "row_number"}, keep_runs=True)
    # the partitions are ranked within the runs of the whole order
    out = ordered.reversed_positions(r, [part], {"rank_": "rank", "upto_": "upto", "total_": "total"}, overall)
    share = F.when(F.col("total_") > 1, (F.col("rank_") - 1) / (F.col("total_") - 1)).otherwise(F.lit(0.0))
    return out.select(
        group, metric, "overall_rank", share.alias("percentile"), (F.col("upto_") / F.col("total_")).alias("cumulative_dist")
    )


def running_total_mavg3(df, group, part, metric, date, since, tie) -> DataFrame:
    rows = since_filter(df, date, since).select(*dict.fromkeys([group, part, metric, date, *tie]))
    r = ordered.split_runs(rows, [part], date, tie)
    totals = ordered.positions(r, {"running_total": "running_sum"}, metric=metric, keep_runs=True)
    out = ordered.neighbours(
        replace(r, rows=totals), {"moving_avg_3": lambda w: F.avg(metric).over(w.rowsBetween(-2, 0))}, back=2
    )
    return out.select(group, metric, date, *tie, "running_total", "moving_avg_3")


def _bucket(buckets: int, row_number: str, total: str):
    """NTILE from position and group size: the first (total mod buckets) buckets get one row more."""
    size = F.floor(F.col(total) / buckets)
    extra = F.col(total) % buckets
    wide = extra * (size + 1)
    at = F.col(row_number) - 1
    inside = F.when(at < wide, F.floor(at / (size + 1))).otherwise(extra + F.floor((at - wide) / F.greatest(size, F.lit(1))))
    return (inside + 1).cast("int")


def ntile_dense_rank(df, group, part, metric, date, since, tie, buckets: int = 4) -> DataFrame:
    rows = since_filter(df, date, since).select(*dict.fromkeys([group, part, metric, *tie]))
    r = ordered.split_runs(rows, [part], metric, tie)
    # Descending ranks follow from ascending ones: rows above = total - rows up to and
    # including the peers; distinct values above = distinct values - ascending dense rank.
    wanted = {"rn_": "row_number", "total_": "total", "upto_": "upto", "dense_": "dense_rank", "depth_": "distinct"}
    out = ordered.positions(r, wanted)
    return out.select(
        *dict.fromkeys([group, part]),
        metric,
        _bucket(buckets, "rn_", "total_").alias("quartile"),
        (F.col("depth_") - F.col("dense_") + 1).cast("int").alias("dense_rank"),
        (F.col("total_") - F.col("upto_") + 1).cast("int").alias("rank"),
    )


def first_last_value(df, group, part, metric, date, since, tie) -> DataFrame:
    rows = since_filter(df, date, since).select(*dict.fromkeys([group, part, date, metric, *tie]))
    at = F.struct(date, *tie)
    ends = rows.groupBy(part).agg(
        F.min_by(metric, at).alias("period_start_value"), F.max_by(metric, at).alias("period_end_value")
    )
    out = attach(rows, ends, part).withColumn("change_from_start", F.col(metric) - F.col("period_start_value"))
    return out.select(group, date, metric, "period_start_value", "period_end_value", "change_from_start")


def sigma_category(df, group, part, metric, date, since) -> DataFrame:
    rows = since_filter(df, date, since).select(*dict.fromkeys([group, part, metric, date]))
    stats = rows.groupBy(part).agg(F.avg(metric).alias("__mu"), F.stddev_samp(metric).alias("__sd"))
    label = (
        F.when(F.col(metric) > F.col("__mu") + F.col("__sd"), "Above Avg")
        .when(F.col(metric) < F.col("__mu") - F.col("__sd"), "Below Avg")
        .otherwise("Within Avg")
    )
    out = attach(rows, stats, part)
    return out.select(
        *dict.fromkeys([group, part, metric, date]),
        (F.col(metric) - F.col("__mu")).alias("deviation_from_avg"),
        label.alias("performance_category"),
    )


def pct_total_to_date(df, group, part, metric, date, since, tie) -> DataFrame:
    rows = since_filter(df, date, since).select(*dict.fromkeys([group, part, date, metric, *tie]))
    r = ordered.split_runs(rows, [part], date, tie)
    out = ordered.positions(
        r, {"upto_": "range_sum", "all_": "total_sum", "period_number": "row_number"}, metric=metric
    )
    return out.select(
        group, date, metric, *tie, (F.try_divide("upto_", "all_") * 100).alias("pct_of_total_to_date"), "period_number"
    )


def pareto_cumulative(df, group, part, metric, date, since, tie) -> DataFrame:
    rows = since_filter(df, date, since).select(*dict.fromkeys([group, part, metric, date, *tie]))
    r = ordered.split_runs(rows, [part], metric, tie, desc=True)
    out = ordered.positions(r, {"upto_": "range_sum", "all_": "total_sum"}, metric=metric)
    return out.select(
        *dict.fromkeys([group, part, metric, date]),
        (F.try_divide(F.col(metric), F.col("all_")) * 100).alias("pct_of_partition"),
        (F.try_divide("upto_", "all_") * 100).alias("cumulative_pct"),
    )


def mavg7_deviation(df, group, metric, date, since, tie, width: int = 7) -> DataFrame:
    rows = since_filter(df, date, since).select(group, metric, date, *tie)
    r = ordered.split_runs(rows, [], date, tie)
    frame = -(width - 1)
    out = ordered.neighbours(r, {"moving_avg": lambda w: F.avg(metric).over(w.rowsBetween(frame, 0))}, back=width - 1)
    return out.withColumn("deviation_from_ma", F.col(metric) - F.col("moving_avg"))


def decile_bounds(df, group, part, metric, date, since, tie, buckets: int = 10) -> DataFrame:
    rows = since_filter(df, date, since).select(*dict.fromkeys([group, part, metric, *tie]))
    r = ordered.split_runs(rows, [part], metric, tie)
    out = ordered.positions(r, {"rn_": "row_number", "total_": "total"})
    out = out.withColumn("decile", _bucket(buckets, "rn_", "total_"))
    bounds = out.groupBy(part, "decile").agg(F.min(metric).alias("decile_min"), F.max(metric).alias("decile_max"))
    return attach(out, bounds, [part, "decile"]).select(
        *dict.fromkeys([group, part]), metric, "decile", "decile_min", "decile_max"
    )


def next_change_trend(df, group, metric, date, since, tie) -> DataFrame:
    rows = since_filter(df, date, since).select(group, date, metric, *tie)
    r = ordered.split_runs(rows, [group], date, tie)
    out = ordered.neighbours(r, {"next_": lambda w: F.lead(metric).over(w)}, ahead=1)
    step = F.col("next_") - F.col(metric)
    label = F.when(F.col("next_") > F.col(metric), "Increasing").when(F.col("next_") < F.col(metric), "Decreasing")
    return out.select(
        group, date, metric, *tie, step.alias("next_period_change"), label.otherwise("Stable").alias("trend_direction")
    )


def topn_percentile(df, group, part, metric, date, since, n: int, tie) -> DataFrame:
    rows = since_filter(df, date, since).select(*dict.fromkeys([group, part, metric, *tie]))
    w = Window.partitionBy(part).orderBy(F.desc(metric), *tie)
    top = rows.withColumn("row_num", F.row_number().over(w)).filter(F.col("row_num") <= n)
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("partition_size"))
    out = attach(top, sizes, part)
    return out.select(
        *dict.fromkeys([group, part]),
        metric,
        "row_num",
        "partition_size",
        F.round(F.col("row_num") * 100.0 / F.col("partition_size"), 2).alias("percentile_rank"),
    )


def forward3_sum_avg(df, group, metric, date, since, tie) -> DataFrame:
    rows = since_filter(df, date, since).select(group, date, metric, *tie)
    r = ordered.split_runs(rows, [group], date, tie)
    return ordered.neighbours(
        r,
        {
            "forward_3period_sum": lambda w: F.sum(metric).over(w.rowsBetween(0, 2)),
            "forward_3period_avg": lambda w: F.avg(metric).over(w.rowsBetween(0, 2)),
        },
        ahead=2,
    )


def minmax_normalize(df, group, part, metric, date, since) -> DataFrame:
    rows = since_filter(df, date, since).select(*dict.fromkeys([group, part, metric, date]))
    ends = rows.groupBy(part).agg(F.min(metric).alias("__lo"), F.max(metric).alias("__hi"))
    out = attach(rows, ends, part)
    from_min = F.col(metric) - F.col("__lo")
    return out.select(
        *dict.fromkeys([group, part, metric, date]),
        from_min.alias("distance_from_min"),
        (F.col("__hi") - F.col(metric)).alias("distance_from_max"),
        F.try_divide(from_min, F.col("__hi") - F.col("__lo")).alias("normalized_score"),
    )
