"""Streams over several files in several micro-batches equal their batch twins."""

import time

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import telemetry
from tidemark.sources import readers
from tidemark.streaming import streams

SCHEMA = T.StructType(
    [T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())]
)


def write_events(spark, folder):
    rows = spark.range(900).selectExpr(
        "id as event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id * 3) as ts",
        "case when id % 3 = 0 then 'error' else 'view' end as event_type", "id % 50 / 4.0 as value",
    )
    rows = rows.withColumn("value", F.col("value").cast("double"))
    for i in range(3):
        rows.filter(F.floor(F.col("event_id") / 300) == i).coalesce(1).write.mode("append").parquet(folder)
    return rows


def bag(df):
    return sorted(map(str, df.collect()))


def test_streams_equal_batches(spark, tmp_path):
    folder = str(tmp_path / "events")
    rows = write_events(spark, folder)
    batch = rows.withColumn("ts", F.col("ts").cast("timestamp"))

    def stream():
        return readers.stream_parquet(spark, folder, SCHEMA, files_per_trigger=1)

    rate = streams.run_available(streams.request_rate(stream(), "ts", "2 minutes"), ["window_start"])
    w = F.window("ts", "60 seconds", "10 seconds")
    want = batch.groupBy(w).agg(F.count("*").alias("n")).select("window.start", "n", F.col("n") / 60)
    assert bag(rate.toDF("a", "b", "c")) == bag(want.toDF("a", "b", "c"))

    windows = streams.run_available(streams.counters(stream(), "ts", ["event_type"], "2 minutes", "1 minute"), ["window_start", "event_type"])
    counts = streams.running_totals(windows, ["event_type"])
    assert windows.count() > counts.count() and bag(counts) == bag(telemetry.counter(batch, ["event_type"]))

    windows = streams.run_available(
        streams.gauge_last(stream(), "ts", "value", ["ts", "event_id"], ["event_type"], "2 minutes", "1 minute"), ["window_start", "event_type"]
    )
    last = streams.last_values(windows, ["event_type"])
    assert bag(last) == bag(telemetry.gauge_last(batch, "value", ["ts", "event_id"], ["event_type"]))

    hist = streams.run_available(streams.histogram(stream(), "ts", "value", [1, 5, telemetry.INF], ["event_type"], "2 minutes"), ["window_start", "event_type", "le"])
    assert hist.filter("le = '+Inf'").agg(F.sum("n_rows")).first()[0] == 900


def test_lateness_is_the_callers_choice(spark, tmp_path):
    """Files that come in reverse time order: all counted when nothing is late, fewer with a short lateness."""
    folder = str(tmp_path / "reverse")
    rows = write_events(spark, str(tmp_path / "source"))
    for i in (2, 1, 0):
        rows.filter(F.floor(F.col("event_id") / 300) == i).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are read by modification time

    def total(late):
        source = readers.stream_parquet(spark, folder, SCHEMA, files_per_trigger=1)
        rate = streams.run_available(streams.request_rate(source, "ts", late, length="10 seconds"), ["window_start"])
        return rate.agg(F.sum("n_events")).first()[0]

    assert total("1 day") == 900
    assert total("1 second") < 900


def test_guard_filter_keeps_allowed_only(spark, tmp_path):
    folder = str(tmp_path / "sql")
    spark.createDataFrame([("SELECT 1",), ("DROP TABLE t",), ("SELECT 2",)], "sql string").write.parquet(folder)
    src = spark.readStream.schema("sql string").parquet(folder)
    out = streams.run_available(streams.guard_filter(src, "sql"), [], mode="append")
    assert sorted(r["sql"] for r in out.collect()) == ["SELECT 1", "SELECT 2"]


def test_state_of_counters_expires(spark, tmp_path):
    """Every file brings new users; the state holds those of the last windows only, the sink all of them."""
    folder = str(tmp_path / "users")
    for i in range(6):
        rows = spark.range(100).selectExpr(
            f"id + {100 * i} as event_id", f"timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, {i}, 0, id * 3) as ts",
            f"concat('user', id % 20 + {20 * i}) as event_type", "1.0D as value",
        )
        rows.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    for make in (
        lambda s: streams.counters(s, "ts", ["event_type"], "1 minute", "10 minutes"),
        lambda s: streams.gauge_last(s, "ts", "value", ["ts", "event_id"], ["event_type"], "1 minute", "10 minutes"),
    ):
        seen = []
        source = readers.stream_parquet(spark, folder, SCHEMA, files_per_trigger=1)
        query = (
            make(source).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / f"state{id(make)}"))
            .trigger(availableNow=True).foreachBatch(lambda batch, i: seen.append(batch.select("event_type").distinct().count())).start()
        )
        query.awaitTermination()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        assert sum(seen) >= 120 and len(held) >= 6 and max(held) <= 60 and held[-1] <= 40
