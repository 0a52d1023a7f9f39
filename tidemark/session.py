"""Session set-up and the one way this library cuts lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every operator here assumes (UTC, AQE with skew handling)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints: the cluster's ``spark.checkpoint.dir``.

    A temporary folder is used only when the session names none and has no executors of its
    own (``local`` master), as in tests; elsewhere it would be a different disk on each machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-ckpt-")
    sc.setCheckpointDir(folder)
    return folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder, for written intermediate tables and files.

    Within ``scratch`` it is deleted at the end of the block.
    """
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for paths in _SCOPES:
        paths.append(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Written once to the shared folder and read back: survives executor loss, lineage cut.

    As a Parquet table it is computed by one job (a checkpoint computes its rows twice),
    later readers fetch only the columns they need, and its file size tells Catalyst
    whether it may be broadcast.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "table")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, if it is there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialise`` returned and that no later step reads; others are left as they are."""
    written = [table for table in tables if hasattr(table, "_written")]
    for table in written:
        delete(table.sparkSession, table._written)
    if written:
        collect_garbage(written[0].sparkSession)


def collect_garbage(spark: SparkSession) -> None:
    """Asks the driver's JVM to collect its garbage: only then does Spark remove the shuffle files of jobs that have ended."""
    spark.sparkContext._jvm.System.gc()


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs run within the block; those of before hold again at its end."""
    before = {key: spark.conf.get(key, None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


#: Folders handed out within each open ``scratch`` block.
_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the folders that operators wrote to within it.

    Results of operators read such tables: write or collect them inside the block.
    """
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.remove(paths)
        for path in paths:
            delete(spark, path)
