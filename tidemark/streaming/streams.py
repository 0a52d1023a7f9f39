"""Structured Streaming forms of the telemetry operators.

Each takes a stream with a zoned event time and returns the aggregated stream; the
expressions are those of the batch operators.  State is bounded by the watermark: also what
runs for ever (counters, last values) is kept per window in the stream, and the windows are
merged from the sink.  ``late`` is the caller's choice: events that come later than that after the latest
one are not counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import sqltext
from tidemark.operators import telemetry
from tidemark.session import shared_folder

def request_rate(events: DataFrame, ts: str, late: str, length: str = "60 seconds", step: str = "10 seconds", seconds: int = 60) -> DataFrame:
    w = F.window(ts, length, step)
    rated = events.withWatermark(ts, late).groupBy(w).agg(F.count(F.lit(1)).alias("n_events"))
    return rated.select(
        F.col("window.start").alias("window_start"), "n_events", (F.col("n_events") / seconds).alias("requests_per_second")
    )


def counters(events: DataFrame, ts: str, labels: Sequence[str], late: str, length: str = "1 hour") -> DataFrame:
    """Events per label set and window; :func:`running_totals` adds the windows up.

    A window's state ends with the watermark, so label sets that are no longer seen cost nothing:
    what is kept for ever is the sink's table, not the state.
    """
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, length), *labels).agg(F.count(F.lit(1)).alias("total"))
    return counted.select(F.col("window.start").alias("window_start"), *labels, "total")


def running_totals(windows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Totals per label set over the windows that a sink holds."""
    return windows.groupBy(*labels).agg(F.sum("total").alias("total"))


def histogram(events: DataFrame, ts: str, col: str, buckets: Sequence[float], labels: Sequence[str], late: str, length: str = "1 minute") -> DataFrame:
    wide = (
        events.withWatermark(ts, late)
        .groupBy(F.window(ts, length), *labels)
        .agg(*telemetry.bucket_counts(col, buckets), F.sum(col).alias("sum_value"), F.count(col).alias("count_value"))
        .withColumn("window_start", F.col("window.start"))
        .drop("window")
    )
    return telemetry.unpivot_buckets(wide, ["window_start", *labels], buckets, ["sum_value", "count_value"])


def gauge_last(
    events: DataFrame, ts: str, col: str, at: Sequence[str], labels: Sequence[str], late: str, length: str = "1 hour"
) -> DataFrame:
    """The last value per label set and window; :func:`last_values` takes the latest window's."""
    place = F.struct(*at)
    last = events.withWatermark(ts, late).groupBy(F.window(ts, length), *labels).agg(F.max(place).alias("place"), F.max_by(col, place).alias("last_value"))
    return last.select(F.col("window.start").alias("window_start"), *labels, "place", "last_value")


def last_values(windows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """The latest value per label set over the windows that a sink holds, and its time ``at``."""
    ends = windows.groupBy(*labels).agg(F.max_by("last_value", "place").alias("last_value"), F.max("place").alias("place"))
    return ends.select(*labels, "last_value", F.col("place")[windows.schema["place"].dataType.names[0]].alias("at"))


def error_report(events: DataFrame, ts: str, message: str, late: str, length: str = "1 hour") -> DataFrame:
    typed = events.withColumn("error_type", sqltext.error_type(F.col(message)))
    counted = typed.withWatermark(ts, late).groupBy(F.window(ts, length), "error_type").agg(F.count(F.lit(1)).alias("n_errors"))
    return counted.select(F.col("window.start").alias("window_start"), "error_type", "n_errors")


def guard_filter(statements: DataFrame, sql: str) -> DataFrame:
    """Stateless: statements that pass the guard."""
    return statements.filter(sqltext.guard_failure(F.col(sql)).isNull())


def run_available(stream: DataFrame, keys: Sequence[str], mode: str = "update") -> DataFrame:
    """Drain what the source holds and return the resulting table.

    Each micro-batch is written under its batch id, so a batch that is run again after a
    failure overwrites itself.  In update mode the last batch of a key holds its value.
    """
    spark = stream.sparkSession
    base = shared_folder(spark, "stream")
    columns = stream.columns

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    out = spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out")
    if mode == "append" or not keys:
        return out.select(*columns)
    rest = [c for c in columns if c not in keys]
    last = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r"))
    return last.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
