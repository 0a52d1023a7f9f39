"""Counters, histograms, gauges and rates over an event table (batch or stream)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INF = float("inf")
# Upper bounds of the duration and chart-count buckets.
DURATION_BUCKETS = [0.5, 1.0, 2.5, 5.0, 10.0, 20.0, 30.0, 60.0, 120.0, INF]
ROW_BUCKETS = [0, 10, 50, 100, 500, 1000, 5000, 10000, 50000, INF]
RETRY_BUCKETS = [0, 1, 2, 3, 4, 5, INF]
CHART_BUCKETS = [0, 1, 2, 3, 5, 10, 15, 20, INF]


def le_name(bound: float) -> str:
    return "+Inf" if bound == INF else f"{bound:g}"


def counter(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias("total"))


def bucket_counts(col: str, buckets: Sequence[float]) -> list[Column]:
    return [
        (F.count(col) if b == INF else F.count_if(F.col(col) <= b)).alias(f"b{i}") for i, b in enumerate(buckets)
    ]


def unpivot_buckets(wide: DataFrame, keys: Sequence[str], buckets: Sequence[float], also: Sequence[str] = ()) -> DataFrame:
    cells = ", ".join(f"'{le_name(b)}', b{i}" for i, b in enumerate(buckets))
    return wide.selectExpr(*keys, *also, f"stack({len(buckets)}, {cells}) as (le, n_rows)")


def histogram(df: DataFrame, col: str, buckets: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """Cumulative buckets with sum and count, one row per label set and bound."""
    wide = df.groupBy(*labels).agg(
        *bucket_counts(col, buckets), F.sum(col).alias("sum_value"), F.count(col).alias("count_value")
    )
    return unpivot_buckets(wide, labels, buckets, ["sum_value", "count_value"])


def gauge_last(df: DataFrame, col: str, at: Sequence[str], labels: Sequence[str]) -> DataFrame:
    return df.groupBy(*labels).agg(F.max_by(col, F.struct(*at)).alias("last_value"), F.max(at[0]).alias("at"))


def request_rate(df: DataFrame, ts: str, seconds: int = 60) -> DataFrame:
    """Requests per second over the trailing window, at every event time (lower bound open).

    Events are counted per microsecond; a window reaches back into its own and the previous
    slice of time only, so slices, not the whole table, are ordered.
    """
    span = seconds * 1_000_000
    counts = (
        df.filter(F.col(ts).isNotNull())
        .groupBy(ts)
        .agg(F.count(F.lit(1)).alias("c"))
        .withColumn("t", F.unix_micros(F.col(ts).cast("timestamp")))
        .withColumn("own", F.floor(F.col("t") / F.lit(span)))
        .withColumn("slice", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    )
    w = Window.partitionBy("slice").orderBy("t").rangeBetween(-(span - 1), 0)
    rated = counts.withColumn("n", F.sum("c").over(w)).filter(F.col("slice") == F.col("own"))
    return rated.select(ts, F.col("c").alias("n_events"), (F.col("n") / seconds).alias("requests_per_second"))


def token_rates(df: DataFrame, tokens: str, seconds: str) -> DataFrame:
    """Tokens per second and seconds per token; null without a positive time, 0 per token without tokens."""
    timed = F.col(seconds) > 0
    return df.withColumns(
        {
            "tokens_per_second": F.when(timed, F.col(tokens) / F.col(seconds)),
            "time_per_token": F.when(timed, F.coalesce(F.try_divide(F.col(seconds), F.col(tokens)), F.lit(0.0))),
        }
    )


def retries(df: DataFrame, query: Sequence[str], failed: Column, succeeded: Column, max_retries: int = 3) -> DataFrame:
    """Failures per query and how it stands: success, retry (tries left) or end."""
    per = df.groupBy(*query).agg(F.count_if(failed).alias("retry_count"), F.max(succeeded).alias("ok"))
    state = F.when(F.col("ok"), "success").when(F.col("retry_count") < max_retries, "retry").otherwise("end")
    return per.select(*query, "retry_count", state.alias("outcome"))


def retry_distribution(df: DataFrame, buckets: Sequence[float] = tuple(RETRY_BUCKETS)) -> DataFrame:
    wide = df.groupBy("outcome").agg(*bucket_counts("retry_count", buckets))
    return unpivot_buckets(wide, ["outcome"], buckets)


def status_rate(df: DataFrame, labels: Sequence[str], success: Column) -> DataFrame:
    ok = F.count_if(success)
    n = F.count(F.lit(1))
    return df.groupBy(*labels).agg(ok.alias("n_success"), (n - ok).alias("n_failure"), (ok / n).alias("success_share"))


def charts_per_query(df: DataFrame, charts: str, intent: str, buckets: Sequence[float] = tuple(CHART_BUCKETS)) -> DataFrame:
    """Per intent: cumulative chart-count buckets, queries and charts."""
    wide = df.groupBy(intent).agg(
        *bucket_counts(charts, buckets), F.count(F.lit(1)).alias("n_queries"), F.sum(charts).alias("n_charts")
    )
    return unpivot_buckets(wide, [intent], buckets, ["n_queries", "n_charts"])
