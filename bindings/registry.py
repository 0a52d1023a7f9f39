"""Registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def cents(df: DataFrame, column: str) -> DataFrame:
    """Money as DECIMAL: means of few amounts in cents fall on rounding boundaries too often as doubles."""
    return df.withColumn(column, F.col(column).cast("decimal(18,2)"))


def register(key: str, oracle: str | None = None, digits: dict[str, int] | None = None):
    """Bind ``fn(tables) -> DataFrame`` to ``key``.

    ``digits`` rounds floating-point results on both sides: the order of summation
    differs between engines.
    """
    digits = digits or {}

    def bind(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(Tables(spark, sf_dir))
            return df.withColumns({c: F.round(F.col(c).cast("double"), n) for c, n in digits.items()}) if digits else df

        QUERIES[key] = run
        if oracle is not None:
            swaps = ", ".join(f"round({c}, {n}) AS {c}" for c, n in digits.items())
            sql = oracle.strip().rstrip(";")
            ORACLES[key] = f"SELECT * REPLACE ({swaps}) FROM (\n{sql}\n) result" if digits else sql
        return fn

    return bind
