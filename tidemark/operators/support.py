"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise


def as_type_of(df: DataFrame, column: str, value) -> Column:
    """``value`` as a literal of the column's own type, so the filter reaches the scan."""
    return F.lit(str(value)).cast(df.schema[column].dataType)


def since_filter(df: DataFrame, date: str | None, since) -> DataFrame:
    """Rows with ``date >= since``; unchanged when either is None."""
    if date is None or since is None:
        return df
    return df.filter(F.col(date) >= as_type_of(df, date, since))


def year_bounds(df: DataFrame, date: str, year: int) -> Column:
    return F.col(date).between(
        as_type_of(df, date, f"{year}-01-01"), as_type_of(df, date, f"{year}-12-31")
    )


def attach(df: DataFrame, stats: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Join per-group statistics back to their rows.

    The statistics are computed once and written, so their size is known when the join is
    planned: within ``spark.sql.autoBroadcastJoinThreshold`` they are broadcast, the row
    side is not shuffled and a hot group costs nothing; beyond it the join is a shuffle
    join, in which AQE splits hot keys.
    """
    return df.join(materialise(stats), on, how)


def per_class(df: DataFrame, cls: str, *aggs: Column) -> DataFrame:
    """``groupBy(cls).agg(...)`` without the null class.

    The null group is dropped by its count after aggregation.  A filter on the class itself
    would be pushed below and evaluate a derived class twice per row.
    """
    grouped = df.groupBy(cls).agg(*aggs, F.count(cls).alias("__n"))
    return grouped.filter(F.col("__n") > 0).drop("__n")


def join_null_safe(df: DataFrame, other: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Inner or semi join on columns whose nulls are equal; the columns of ``other`` follow those of ``df``."""
    names = {c: f"__on{i}" for i, c in enumerate(on)}
    other = other.withColumnsRenamed(names)
    rule = F.lit(True)
    for c, renamed in names.items():
        rule = rule & F.col(c).eqNullSafe(F.col(renamed))
    return df.join(other, rule, how).drop(*names.values())
