"""The five ways a query shape may restrict its date column, and the aggregate choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.support import as_type_of, year_bounds

AGGREGATES = {"SUM": F.sum, "AVG": F.avg, "MAX": F.max, "MIN": F.min, "COUNT": F.count}


def date_filters(df: DataFrame, date: str, day, year: int, month: int, as_of, last_days: int) -> dict[str, Column]:
    """Predicates by style; each is a range on the raw column, so each reaches the scan."""
    kind = df.schema[date].dataType
    col = F.col(date)
    after = F.date_sub(F.lit(str(as_of)).cast("date"), last_days).cast(kind)
    return {
        "since_day": col >= as_type_of(df, date, day),
        "calendar_year_between": year_bounds(df, date, year),
        "year_equals": (col >= as_type_of(df, date, f"{year}-01-01")) & (col < as_type_of(df, date, f"{year + 1}-01-01")),
        "since_month_start": col >= as_type_of(df, date, f"{year}-{month:02d}-01"),
        "last_n_days": col > after,
    }


def date_filter_styles(df: DataFrame, date: str, **choice) -> DataFrame:
    """Row count under each style, from one scan."""
    preds = date_filters(df, date, **choice)
    counts = df.agg(*[F.count_if(p).alias(name) for name, p in preds.items()])
    pairs = ", ".join(f"'{name}', {name}" for name in preds)
    return counts.selectExpr(f"stack({len(preds)}, {pairs}) as (style, n_rows)")


def aggregate_variants(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Every aggregate that may take the place of SUM in a shape."""
    return df.groupBy(group).agg(*[fn(metric).alias(f"{name.lower()}_metric") for name, fn in AGGREGATES.items()])
