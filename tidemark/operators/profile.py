"""Column profiles of any DataFrame.

Columns are sorted into id / numeric / datetime / categorical from the schema alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import selection
from tidemark.session import materialise


def is_id(name: str) -> bool:
    low = name.lower()
    return name in ("id", "ID", "index", "Index") or "_id" in low or "id_" in low or name.endswith(("Id", "ID"))


def column_kinds(df: DataFrame) -> dict[str, list[str]]:
    kinds: dict[str, list[str]] = {"numeric": [], "categorical": [], "datetime": [], "ids": []}
    for field in df.schema.fields:
        if is_id(field.name):
            kinds["ids"].append(field.name)
        elif isinstance(field.dataType, (T.NumericType, T.BooleanType)):
            kinds["numeric"].append(field.name)
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            kinds["datetime"].append(field.name)
        else:
            kinds["categorical"].append(field.name)
    return kinds


def overview(df: DataFrame) -> DataFrame:
    """Per column: type, non-null and null counts, with the table's row and column counts."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    counts = df.agg(F.count(F.lit(1)).alias("total_rows"), *[F.count(c).alias(f"n_{c}") for c in df.columns])
    rows = ", ".join(f"'{c}', '{types[c]}', `n_{c}`" for c in df.columns)
    return counts.selectExpr(
        "total_rows", f"stack({len(df.columns)}, {rows}) as (column_name, dtype, non_null)"
    ).select(
        "column_name", "dtype", "non_null", (F.col("total_rows") - F.col("non_null")).alias("null_count"),
        "total_rows", F.lit(len(df.columns)).alias("total_columns"),
    )


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, sd and exact quartiles per numeric column.

    The columns are stacked to (column, value) once, so moments and quartiles of all of
    them come from the same scan; quartiles are found by bucket selection, not in one buffer.
    """
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in cols)
    long = df.selectExpr(f"stack({len(cols)}, {pairs}) as (column_name, v)").filter(F.col("v").isNotNull())
    moments = long.groupBy("column_name").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")
    )
    quarts = selection.percentiles(long, ["column_name"], "v", [0, 0.25, 0.5, 0.75, 1], ["min", "q25", "median", "q75", "max"])
    return moments.join(quarts, "column_name")


def missing(df: DataFrame, min_pct: float = 1.0) -> DataFrame:
    """Columns whose share of nulls reaches ``min_pct`` percent."""
    table = overview(df)
    pct = F.try_divide(F.col("null_count"), F.col("total_rows")) * 100
    return (
        table.select("column_name", F.col("null_count").alias("missing_count"), pct.alias("missing_percentage"))
        .filter((F.col("missing_count") > 0) & (F.col("missing_percentage") >= min_pct))
    )


def high_cardinality(df: DataFrame, col: str, n: int = 5) -> DataFrame:
    """Top and bottom n values, singletons and mode of a column; ``total_unique`` says whether it has many values.

    (section, position, value, n_rows, percentage); equal counts are ordered by value.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
    counts = materialise(counts)  # read five times below
    facts = counts.agg(
        F.count(F.lit(1)).alias("total_unique"), F.count_if(F.col("n_rows") == 1).alias("singleton_count")
    )
    rows = df.agg(F.count(F.lit(1))).scalar()

    def ends(section: str, order):
        few = counts.orderBy(*order).limit(n)  # n rows, so one ordered task is enough
        return few.select(F.lit(section).alias("section"), F.row_number().over(Window.orderBy(*order)).alias("position"), "value", "n_rows")

    top = ends("top", [F.desc("n_rows"), F.asc("value")])
    bottom = ends("bottom", [F.asc("n_rows"), F.desc("value")])
    summary = facts.selectExpr("stack(2, 'total_unique', total_unique, 'singletons', singleton_count) as (section, n_rows)").select(
        "section", F.lit(0).alias("position"), F.lit(None).cast("string").alias("value"), "n_rows"
    )
    mode = top.filter(F.col("position") == 1).withColumn("section", F.lit("mode"))
    return (
        top.unionByName(bottom).unionByName(summary).unionByName(mode)
        .withColumn("percentage", F.when(F.col("value").isNotNull(), F.col("n_rows") / rows * 100))
    )


def sanitize(df: DataFrame) -> DataFrame:
    """Decimals to double; NaN and infinities to null, also inside arrays and structs."""

    def fix(c, t):
        if isinstance(t, T.DecimalType):
            return c.cast("double")
        if isinstance(t, (T.DoubleType, T.FloatType)):
            bad = F.isnan(c) | c.isin(float("inf"), float("-inf"))
            return F.when(~bad, c)
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda e: fix(e, t.elementType))
        if isinstance(t, T.StructType):
            inner = F.struct(*[fix(c.getField(f.name), f.dataType).alias(f.name) for f in t.fields])
            return F.when(c.isNotNull(), inner)
        return c

    return df.select(*[fix(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])
