"""The drift report follows from one pass over both snapshots."""

from pyspark.sql import functions as F

from tidemark.operators import drift
from tidemark.plans import curation


def test_drift_report_reads_each_snapshot_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    was = spark.createDataFrame([("a", "x" * i) for i in range(1, 9)] + [(None, "y"), ("b", None), ("c", "z")], "cls string, text string")
    now = spark.createDataFrame([("a", "x" * i) for i in range(3, 9)] + [("d", "y"), ("b", "yy")], "cls string, text string")
    want = {(r.metric, r.value) for r in curation.drift_report(now, was, "cls", "text").collect()}
    out = curation.drift_report(now, was.mapInArrow(count, was.schema), "cls", "text")
    assert {(r.metric, r.value) for r in out.collect()} == want
    assert seen.value == 11
    assert ("previous_rows", 11.0) in want and ("current_rows", 8.0) in want


def test_drift_from_stats_is_drift(spark):
    was = spark.createDataFrame([("a", "x" * i) for i in range(1, 9)] + [(None, "y"), ("b", None)], "cls string, text string")
    now = spark.createDataFrame([("a", "xxx")] * 5 + [("d", "y"), (None, "yy")], "cls string, text string")
    stats = drift.class_stats(now, was, "cls", "text").localCheckpoint()
    key = lambda df: sorted(map(str, df.collect()))
    assert key(drift.shares_of(stats, "cls")) == key(drift.class_drift(now, was, "cls"))
    assert key(drift.lengths_of(stats, "cls")) == key(drift.length_drift(now, was, "cls", "text"))
    assert key(drift.sizes_of(stats)) == key(drift.size_change(now, was)) == ["Row(previous_rows=10, current_rows=7, size_change_pct=-30.0)"]
    none = now.filter(F.lit(False))
    assert key(drift.size_change(none, none)) == ["Row(previous_rows=0, current_rows=0, size_change_pct=None)"]
