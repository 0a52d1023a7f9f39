"""The shared folder and what is left in it."""

import os
from types import SimpleNamespace

import pytest

from tidemark.operators import ordered
from tidemark.session import discard, ensure_checkpoint_dir, materialise, scratch, shared_folder


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="yarn")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(session)


def test_scratch_leaves_no_table(spark):
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with scratch(spark):
        for i in range(10):
            rows = spark.range(50).selectExpr("id", f"id % {i + 2} as k")
            assert ordered.positions(ordered.split_runs(rows, ["k"], "id", []), {"n": "row_number"}).count() == 50
        assert len(set(os.listdir(folder)) - before) >= 10
    assert set(os.listdir(folder)) == before


def test_discard(spark):
    table = materialise(spark.range(5))
    folder = table._written.removeprefix("file:")
    assert os.path.isdir(folder) and table.count() == 5
    discard(table)
    assert not os.path.exists(folder)


def test_discard_leaves_other_tables(spark):
    discard(spark.range(3))  # not one that was written


def test_scratch_deletes_folders_handed_out(spark):
    with scratch(spark):
        path = shared_folder(spark, "runs")
        spark.range(3).write.parquet(path)
        assert os.path.isdir(path.removeprefix("file:"))
    assert not os.path.exists(path.removeprefix("file:"))
