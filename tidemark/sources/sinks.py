"""Writing results, splits, snapshots and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.readers import CSV_OPTIONS, listing, require_columns

WRITE_CSV = {k: v for k, v in CSV_OPTIONS.items() if k != "multiLine"}


def save_result(df: DataFrame, root: str, user_id: str, ts: str, meta: dict[str, object]) -> str:
    """Result as Parquet below ``root/user_id=.../ts=...`` with a one-row metadata file beside it.

    The row count is observed while the data is written, so the query runs once.
    """
    folder = f"{root.rstrip('/')}/user_id={user_id}/ts={ts}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").parquet(f"{folder}/data")
    spark = df.sparkSession
    fields = {
        **meta, "result_saved": True, "user_id": user_id, "timestamp": ts, "rows": seen.get["n"],
        "columns": len(df.columns),
    }
    one = spark.range(1).select(
        *[F.lit(v).alias(k) for k, v in fields.items()], F.array(*[F.lit(c) for c in df.columns]).alias("column_names")
    )
    one.coalesce(1).write.json(f"{folder}/metadata")
    return folder


def export_csv(spark: SparkSession, parquet_path: str, csv_path: str) -> None:
    spark.read.parquet(parquet_path).write.options(**WRITE_CSV).csv(csv_path)


def write_splits(df: DataFrame, folder: str, cols: Sequence[str] = ("input_text", "sql", "sql_complexity")) -> None:
    """One CSV folder per split with exactly these columns, in this order."""
    require_columns(df, [*cols, "split"], folder)
    df.select(*cols, "split").write.partitionBy("split").options(**WRITE_CSV).csv(folder)


def write_report(df: DataFrame, path: str) -> None:
    """A (small, aggregated) report as one JSON file."""
    df.coalesce(1).write.json(path)


def publish(df: DataFrame, root: str, ts: str) -> DataFrame:
    """Dated snapshot partitioned by split, its manifest, and the ``latest`` pointer.

    Returns the manifest (file_name, size).  The pointer is written last: a reader never
    sees a snapshot that is not complete.
    """
    spark = df.sparkSession
    folder = f"{root.rstrip('/')}/{ts}"
    df.write.partitionBy("split").parquet(f"{folder}/data")
    manifest = listing(spark, folder, "*.parquet").select("file_name", "size")
    manifest.coalesce(1).write.json(f"{folder}/manifest")
    spark.range(1).select(F.lit(ts).alias("latest"), F.lit(folder).alias("folder")).coalesce(1).write.mode("overwrite").json(
        f"{root.rstrip('/')}/_latest"
    )
    return spark.read.json(f"{folder}/manifest")


def upsert_partitions(new: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Replace the partitions that ``new`` has rows for; others stay as they are."""
    (
        new.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )
