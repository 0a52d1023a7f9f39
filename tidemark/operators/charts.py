"""Chart data: what a chart of the result would plot, computed where the rows are."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.draws import SPAN, draw
from tidemark.operators import selection
from tidemark.session import materialise

# Limits the chart rules use.
BINS = 30
UNIQUE_SHARE, MIN_CORR_UNIQUE, MIN_CORR = 0.95, 0.3, 0.5


def histogram(df: DataFrame, col: str, bins: int = BINS) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed; empty bins are kept."""
    v = F.col(col).cast("double")
    rows = df.select(v.alias("v")).filter(F.col("v").isNotNull())
    ends = rows.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()
    rows = rows.withColumn("e", ends)
    width = (F.col("e.hi") - F.col("e.lo")) / bins
    place = F.least(F.floor(F.try_divide(F.col("v") - F.col("e.lo"), width)), F.lit(bins - 1))
    counts = rows.select(F.coalesce(place, F.lit(0)).cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n_rows"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), ends.alias("e"))
    step = (F.col("e.hi") - F.col("e.lo")) / bins
    return frame.join(counts, "bin", "left").select(
        "bin", (F.col("e.lo") + F.col("bin") * step).alias("bin_start"),
        (F.col("e.lo") + (F.col("bin") + 1) * step).alias("bin_end"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
    )


def _five(df: DataFrame, by: list[str], col: str) -> DataFrame:
    five = selection.percentiles(df, by, col, [0, 0.25, 0.5, 0.75, 1], ["min_value", "q1", "median", "q3", "max_value"])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return materialise(five.withColumns({"lower_fence": F.col("q1") - reach, "upper_fence": F.col("q3") + reach}))


def box(df: DataFrame, col: str) -> DataFrame:
    """Five numbers, fences at 1.5 IQR and the number of rows outside them."""
    rows = df.select(F.col(col).cast("double").alias("v"))
    five = _five(rows, [], "v")
    fences = five.select(F.struct("lower_fence", "upper_fence")).scalar()
    outside = (
        rows.withColumn("f", fences)
        .filter((F.col("v") < F.col("f.lower_fence")) | (F.col("v") > F.col("f.upper_fence")))
        .agg(F.count(F.lit(1)))
        .scalar()
    )
    return five.withColumn("n_outliers", outside)


def box_outliers(df: DataFrame, col: str, keep: Sequence[str]) -> DataFrame:
    """The rows outside the fences."""
    five = _five(df.select(F.col(col).cast("double").alias("v")), [], "v")
    fences = five.select(F.struct("lower_fence", "upper_fence")).scalar()
    rows = df.select(*keep, col).withColumn("f", fences)
    return rows.filter((F.col(col) < F.col("f.lower_fence")) | (F.col(col) > F.col("f.upper_fence"))).drop("f")


def box_by_category(df: DataFrame, num: str, cat: str) -> DataFrame:
    """A box per category; how many categories a chart can take is the caller's choice."""
    rows = df.select(cat, F.col(num).cast("double").alias("v")).filter(F.col(cat).isNotNull())
    five = _five(rows, [cat], "v")
    outside = (F.col("v") < F.col("lower_fence")) | (F.col("v") > F.col("upper_fence"))
    counts = rows.join(five.select(cat, "lower_fence", "upper_fence"), cat).groupBy(cat).agg(F.count_if(outside).alias("n_outliers"))
    return five.join(counts, cat)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value, without nulls."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n_rows"))


def frequency_bar(df: DataFrame, col: str) -> DataFrame:
    return value_counts(df, col).orderBy(F.desc("n_rows"), col)


def top_n_bar(df: DataFrame, col: str, n: int) -> DataFrame:
    return value_counts(df, col).orderBy(F.desc("n_rows"), col).limit(n)


def word_frequencies(df: DataFrame, col: str, n: int) -> DataFrame:
    return value_counts(df, col).orderBy(F.desc("n_rows"), col).limit(n)


def metric_bar(df: DataFrame, x: str, y: str, tie: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(F.desc(y), *tie).limit(n).select(x, y)


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson over pairwise complete rows, every pair in one aggregation, in long form."""
    pairs = list(combinations(cols, 2))
    row = df.agg(
        *[F.corr(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)],
        *[F.corr(c, c).alias(f"d{i}") for i, c in enumerate(cols)],
    )
    cells = [f"'{a}', '{b}', p{i}" for i, (a, b) in enumerate(pairs)]
    cells += [f"'{b}', '{a}', p{i}" for i, (a, b) in enumerate(pairs)]
    cells += [f"'{c}', '{c}', d{i}" for i, c in enumerate(cols)]
    return row.selectExpr(f"stack({len(cells)}, {', '.join(cells)}) as (x, y, correlation)")


def scatter_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairs worth a scatter plot: |r| > 0.3 when both are near-unique, > 0.5 otherwise."""
    pairs = list(combinations(cols, 2))
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.corr(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)],
        *[F.count_distinct(c).alias(f"u_{c}") for c in cols],
    )
    cells = ", ".join(
        f"'{a}', '{b}', p{i}, (u_{a} / n > {UNIQUE_SHARE} and u_{b} / n > {UNIQUE_SHARE})" for i, (a, b) in enumerate(pairs)
    )
    long = row.selectExpr(f"stack({len(pairs)}, {cells}) as (x, y, correlation, near_unique)")
    bar = F.when(F.col("near_unique"), MIN_CORR_UNIQUE).otherwise(MIN_CORR)
    return long.filter(F.abs("correlation") > bar).withColumn("show_regression", ~F.col("near_unique"))


def regression_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line over rows where both values are present."""
    return df.agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n_rows")
    )


def line_over_time(df: DataFrame, date: str, metric: str) -> DataFrame:
    """Daily means, the form a time line takes for any number of rows."""
    return (
        df.filter(F.col(date).isNotNull())
        .groupBy(F.to_date(date).alias("day"))
        .agg(F.avg(metric).alias("avg_metric"), F.count(metric).alias("n_rows"))
        .orderBy("day")
    )


def line_points(df: DataFrame, date: str, metric: str) -> DataFrame:
    """Every point, in time order.  The metric breaks ties, so that the range sort can cut a busy date."""
    return df.select(date, metric).orderBy(date, metric)


def scatter_colored(df: DataFrame, x: str, y: str, cat: str) -> DataFrame:
    return df.select(x, y, cat)


def sample_share(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """A seeded share of the rows, whatever their number.

    A row is drawn by its key, so re-runs and any partitioning agree.
    """
    return df.filter(draw(F.col(key), seed) < int(share * SPAN))
