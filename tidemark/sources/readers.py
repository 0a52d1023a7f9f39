"""Reading corpora, dated snapshots and database tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPUS_COLUMNS = ("sql_prompt", "sql_context", "sql", "sql_complexity")
CSV_OPTIONS = {
    "header": "true", "multiLine": "true", "quote": '"', "escape": '"',
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}
# Texts that the usual data-frame CSV reader takes for a missing value.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Driver class, URL prefix and default port per database kind.
JDBC_KINDS = {
    "postgres": ("org.postgresql.Driver", "jdbc:postgresql://{host}:{port}/{db}", 5432),
    "mysql": ("com.mysql.cj.jdbc.Driver", "jdbc:mysql://{host}:{port}/{db}", 3306),
    "mssql": ("com.microsoft.sqlserver.jdbc.SQLServerDriver", "jdbc:sqlserver://{host}:{port};databaseName={db}", 1433),
}


def require_columns(df: DataFrame, required: Sequence[str], where: str) -> DataFrame:
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise ValueError(f"{where}: missing columns {lacking}")
    return df


def read_corpus_csv(spark: SparkSession, path: str, required: Sequence[str] = CORPUS_COLUMNS) -> DataFrame:
    """One CSV file or folder of text columns; quoted line breaks allowed, missing values as null.

    A file with quoted line breaks is read by one task, so large corpora should come as many files.
    """
    df = require_columns(spark.read.options(**CSV_OPTIONS).csv(path), required, path)
    return df.select(*[F.when(~F.col(c).isin(*MISSING_TEXTS), F.col(c)).alias(c) for c in df.columns])


def read_corpus(spark: SparkSession, train: str, test: str, required: Sequence[str] = CORPUS_COLUMNS) -> DataFrame:
    """The train and test files as one corpus with a ``split`` column."""
    parts = [
        read_corpus_csv(spark, path, required).withColumn("split", F.lit(name)) for name, path in (("train", train), ("test", test))
    ]
    return parts[0].unionByName(parts[1])


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files below ``root`` as (path, folder, file_name, size, modified); contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path", "length", "modificationTime")
    )
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    tail = F.substring_index("path", base + "/", -1)
    return files.select(
        "path",
        F.substring_index(tail, "/", 1).alias("folder"),
        tail.alias("file_name"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    ).filter(F.col("file_name").contains("/"))


def latest_folder(spark: SparkSession, root: str, mode: str = "first_file") -> DataFrame:
    """The newest sub-folder of ``root`` as one row (folder, at).

    ``first_file`` ages a folder by its earliest file, ``last_file`` by its latest,
    ``name`` takes the greatest name.
    """
    per = listing(spark, root).groupBy("folder").agg(F.min("modified").alias("lo"), F.max("modified").alias("hi"))
    order = {"first_file": [F.desc("lo")], "last_file": [F.desc("hi")], "name": []}[mode]
    at = "hi" if mode == "last_file" else "lo"
    return per.orderBy(*order, F.desc("folder")).limit(1).select("folder", F.col(at).alias("at"))


def published(spark: SparkSession, root: str) -> DataFrame | None:
    """The snapshot that the pointer below ``root`` names, with its split column; None before the first one."""
    pointer = f"{root.rstrip('/')}/_latest"
    try:
        latest = spark.read.schema("latest string, folder string").json(pointer).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if latest is None:
        raise ValueError(f"{pointer} is empty: a run ended while it was written")
    return spark.read.parquet(f"{latest['folder']}/data")


def jdbc_options(
    kind: str, host: str, db: str, user: str, password: str, table: str | None = None, query: str | None = None,
    port: int | None = None, partition_column: str | None = None, bounds: tuple | None = None, partitions: int = 1,
) -> dict[str, str]:
    """Options of a JDBC read; a partition column and bounds make it a parallel one."""
    driver, url, default_port = JDBC_KINDS[kind]
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    # Spark refuses `query` together with a partition column, a derived table does the same
    source = table if table is not None else f"({query.rstrip().rstrip(';')}) q"
    opts = {
        "url": url.format(host=host, port=port or default_port, db=db),
        "driver": driver, "user": user, "password": password, "dbtable": source, "fetchsize": "10000",
    }
    if partition_column:
        if not bounds:
            raise ValueError("a partition column needs bounds")
        opts.update(
            partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions)
        )
    return opts


def read_jdbc(spark: SparkSession, **connection) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(**connection)).load()


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType, ts: str = "ts", files_per_trigger: int = 1000) -> DataFrame:
    """A folder of Parquet files as a stream; the event time becomes a zoned timestamp, which watermarks need."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn(ts, F.col(ts).cast("timestamp"))
