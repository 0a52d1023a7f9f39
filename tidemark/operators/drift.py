"""Comparison of a corpus with its previous snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASS_LIMIT, LENGTH_LIMIT = 10.0, 5.0  # percent, strict


def _tagged(cur: DataFrame, prev: DataFrame, *cols: str) -> DataFrame:
    """Both snapshots in one pass: ``now`` is 1 for the current one."""
    return cur.select(*cols, F.lit(1).alias("__now")).unionByName(prev.select(*cols, F.lit(0).alias("__now")))


def class_stats(cur: DataFrame, prev: DataFrame, cls: str, text: str) -> DataFrame:
    """Rows and length statistics per class (null is one) and snapshot, from one pass over both.

    All that the functions below report follows from these few rows: write them once and hand them on as ``stats``.
    """
    rows = _tagged(cur, prev, cls, text).select(cls, "__now", F.length(text).alias("__len"))
    # lengths have few distinct values, so the exact median keeps a small count map
    return rows.groupBy(cls, "__now").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("__len").alias("mean"), F.percentile("__len", F.lit(0.5)).alias("median"), F.stddev_samp("__len").alias("std"),
        F.min("__len").alias("min"), F.max("__len").alias("max"),
    )


def _counts(stats: DataFrame, *by: str) -> DataFrame:
    """Rows then and now, per group."""
    now = F.col("__now")
    return stats.groupBy(*by).agg(F.sum(F.col("n") * now).alias("__c"), F.sum(F.col("n") * (1 - now)).alias("__p"))


def class_drift(cur: DataFrame, prev: DataFrame, cls: str, limit: float = CLASS_LIMIT) -> DataFrame:
    """Share of each class then and now.

    Shares are of non-null rows.  A class that was absent changes by 100 percent.
    """
    return shares_of(_tagged(cur, prev, cls).groupBy(cls, "__now").agg(F.count(F.lit(1)).alias("n")), cls, limit)


def shares_of(stats: DataFrame, cls: str, limit: float = CLASS_LIMIT) -> DataFrame:
    """:func:`class_drift` from ``class_stats``."""
    n = _counts(stats.filter(F.col(cls).isNotNull()), cls)
    total = n.agg(F.struct(F.sum("__c").alias("__c"), F.sum("__p").alias("__p"))).scalar()
    n = n.withColumn("__t", total)
    share_c = F.coalesce(F.try_divide(F.col("__c"), F.col("__t.__c")), F.lit(0.0)) * 100
    share_p = F.coalesce(F.try_divide(F.col("__p"), F.col("__t.__p")), F.lit(0.0)) * 100
    n = n.select(cls, share_p.alias("__pp"), share_c.alias("__cp"))
    change = F.when(F.col("__pp") > 0, (F.col("__cp") - F.col("__pp")) / F.col("__pp") * 100).otherwise(
        F.when(F.col("__cp") > 0, 100.0).otherwise(0.0)
    )
    return n.select(
        cls, F.round("__pp", 2).alias("previous_pct"), F.round("__cp", 2).alias("current_pct"),
        F.round(F.col("__cp") - F.col("__pp"), 2).alias("pct_point_change"), F.round(change, 2).alias("pct_change"),
        (F.abs(change) > limit).alias("exceeds"),
    )


def length_drift(cur: DataFrame, prev: DataFrame, cls: str, text: str, limit: float = LENGTH_LIMIT) -> DataFrame:
    """Length statistics of classes present in both snapshots."""
    return lengths_of(class_stats(cur, prev, cls, text), cls, limit)


def lengths_of(stats: DataFrame, cls: str, limit: float = LENGTH_LIMIT) -> DataFrame:
    """:func:`length_drift` from ``class_stats``."""
    stats = stats.filter(F.col(cls).isNotNull())

    def side(now: int, name: str):
        return F.max(F.when(F.col("__now") == now, F.struct("mean", "median", "std", "min", "max"))).alias(name)

    both = stats.groupBy(cls).agg(side(1, "__c"), side(0, "__p")).filter(F.col("__c").isNotNull() & F.col("__p").isNotNull())
    mean = (F.col("__c.mean") - F.col("__p.mean")) / F.col("__p.mean") * 100
    median = (F.col("__c.median") - F.col("__p.median")) / F.col("__p.median") * 100
    return both.select(
        cls,
        F.round("__p.mean", 2).alias("previous_mean_length"), F.round("__c.mean", 2).alias("current_mean_length"),
        F.round(mean, 2).alias("mean_pct_change"),
        F.round("__p.median", 2).alias("previous_median_length"), F.round("__c.median", 2).alias("current_median_length"),
        F.round(median, 2).alias("median_pct_change"),
        F.round("__p.std", 2).alias("previous_std_length"), F.round("__c.std", 2).alias("current_std_length"),
        F.col("__p.min").alias("previous_min_length"), F.col("__c.min").alias("current_min_length"),
        F.col("__p.max").alias("previous_max_length"), F.col("__c.max").alias("current_max_length"),
        (F.abs(mean) > limit).alias("exceeds"),
    )


def size_change(cur: DataFrame, prev: DataFrame) -> DataFrame:
    return sizes_of(_tagged(cur, prev).groupBy("__now").agg(F.count(F.lit(1)).alias("n")))


def sizes_of(stats: DataFrame) -> DataFrame:
    """:func:`size_change` from ``class_stats``."""
    n = _counts(stats).select(F.coalesce("__p", F.lit(0)).alias("previous_rows"), F.coalesce("__c", F.lit(0)).alias("current_rows"))
    change = F.try_divide(F.col("current_rows") - F.col("previous_rows"), F.col("previous_rows")) * 100
    return n.withColumn("size_change_pct", F.round(change, 2))


def reasons(cur: DataFrame, prev: DataFrame, cls: str, text: str, class_limit=CLASS_LIMIT, length_limit=LENGTH_LIMIT) -> DataFrame:
    """One row per exceeded limit."""
    return reasons_of(class_stats(cur, prev, cls, text), cls, class_limit, length_limit)


def reasons_of(stats: DataFrame, cls: str, class_limit=CLASS_LIMIT, length_limit=LENGTH_LIMIT) -> DataFrame:
    """:func:`reasons` from ``class_stats``."""
    a = shares_of(stats, cls, class_limit).filter("exceeds")
    b = lengths_of(stats, cls, length_limit).filter("exceeds")
    return a.select(F.lit("class_share").alias("kind"), F.col(cls).alias("cls"), F.col("pct_change").alias("pct_change")).unionByName(
        b.select(F.lit("text_length").alias("kind"), F.col(cls).alias("cls"), F.col("mean_pct_change").alias("pct_change"))
    )


def decision(cur: DataFrame, prev: DataFrame, cls: str, text: str, **limits: float) -> DataFrame:
    """One row: whether the corpus drifted, and the reasons (at most two per class)."""
    return decision_of(class_stats(cur, prev, cls, text), cls, **limits)


def decision_of(stats: DataFrame, cls: str, **limits: float) -> DataFrame:
    """:func:`decision` from ``class_stats``."""
    why = reasons_of(stats, cls, **limits)
    line = F.format_string("%s '%s' changed by %+.2f%%", "kind", "cls", "pct_change")
    return why.agg(
        F.array_sort(F.collect_list(line)).alias("trigger_reasons"), F.count(F.lit(1)).alias("n_reasons")
    ).withColumn("drift_detected", F.col("n_reasons") > 0)
