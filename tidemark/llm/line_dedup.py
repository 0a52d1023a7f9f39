"""Line de-duplication with levelled sorted runs of line hashes.

Documents are taken in batches from the largest id down.  The keys seen so far lie in runs:
bucketed tables, sorted by hash within each bucket, so that a batch meets them in a merge join
that does not move the runs.  A new batch is anti-joined with the runs: only keys that no run
has yet name their holder (the largest id, as later batches have smaller ids); for keys that are
known, only their count is added.  The batch becomes a run of level 0.  When a level has FANOUT
runs they are compacted into one run of the next level, so there are about log(batches) runs
and each key is rewritten about log(batches) times.

Keys are identified by 128 bits of hash.  Lines move as hashes only; the text moves once, when
the lines to drop meet their document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, ascii_lower, fresh, let, row_keys, text_or_empty, without
from tidemark.session import materialise, shared_folder

#: Runs of one level that are compacted into one of the next.
FANOUT = 3


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


class LineRuns:
    """Levelled runs ``(a, b, docs, last)``: hash, documents counted, largest id that holds the key."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, rows: DataFrame) -> str:
        name, path = f"line_run_{uuid.uuid4().hex}", shared_folder(self.spark, "line-run")
        (
            rows.repartition(self.buckets, "a", "b")
            .write.bucketBy(self.buckets, "a", "b").sortBy("a", "b")
            .option("path", path)
            .saveAsTable(name)
        )
        self.paths[name], self.schema = path, rows.schema
        return name

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def merged(self, runs: list[str]) -> DataFrame:
        # read as files, not as bucketed tables: a union of those does not keep a bucket's rows together
        return self.spark.read.schema(self.schema).parquet(*[self.paths[r] for r in runs]).groupBy("a", "b").agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))

    def add(self, batch: DataFrame) -> None:
        """Merge-anti-join ``batch (a, b, docs, last)`` with every run, then add it as a run of its own."""
        rows = batch.withColumn("seen", F.lit(False))
        for run in self.runs():
            known = self.spark.table(run).select("a", "b", F.lit(True).alias("hit"))
            rows = rows.join(known, ["a", "b"], "left").withColumn("seen", F.col("seen") | F.coalesce("hit", F.lit(False))).drop("hit")
        rows = rows.withColumn("last", F.when(~F.col("seen"), F.col("last"))).drop("seen")
        self._place(self._write(rows), 0)

    def _place(self, run: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            olds, self.levels[level] = self.levels[level], []
            self._place(self._write(self.merged(olds)), level + 1)
            self._drop(olds)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        self._drop(self.runs())
        self.levels = []


#: Ids that stand for all when batches are cut: those with the smallest hashes.
SAMPLE_IDS = 1000


def _batch_bounds(docs: DataFrame, id_col: str, batches: int) -> list:
    """Ids that cut the table into about equal batches; ids may be of any type that can be ordered."""
    sample = docs.filter(F.col(id_col).isNotNull()).select(id_col, F.xxhash64(*docs.columns).alias("h")).orderBy("h", id_col).limit(SAMPLE_IDS)
    ranked = [r[0] for r in sample.select(id_col).orderBy(id_col).collect()]
    return list(dict.fromkeys(ranked[len(ranked) * i // batches] for i in range(1, batches))) if ranked else []


def repeated_lines(hashed: DataFrame, id_col: str, min_docs: int, batches: int) -> DataFrame:
    """Keys ``(a, b, last)`` found in at least ``min_docs`` rows of ``hashed (id, keys)``."""
    spark = hashed.sparkSession
    runs = LineRuns(spark)
    bounds = _batch_bounds(hashed, id_col, batches)
    col = F.col(id_col)
    try:
        for i in range(len(bounds), -1, -1):
            part = hashed
            if i < len(bounds):
                part = part.filter((col < bounds[i]) | col.isNull() if i == 0 else col < bounds[i])
            if i > 0:
                part = part.filter(col >= bounds[i - 1])
            # a document counts a key once, however many lines have it
            keys = part.select(col.alias("id"), F.explode(F.array_distinct(F.transform("keys", lambda k: F.struct(k["a"], k["b"])))).alias("k"))
            runs.add(keys.groupBy("k.a", "k.b").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("last")))
        return materialise(runs.merged(runs.runs()).filter(F.col("docs") >= min_docs).select("a", "b", "last"))
    finally:
        runs.close()


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = 4
) -> DataFrame:
    """Every row of ``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``.

    A key of at least ``min_chars`` code points that at least ``min_docs`` rows hold keeps its
    lines only in the largest id that holds it (in all rows that share this id).  Null or empty
    text is one empty line; a null id counts as smaller than any other.  Every row counts as a
    document, repeated rows too.  An empty table gives an empty result; columns named like the
    added ones are replaced.
    """
    docs = without(docs, "n_lines", "n_dropped", "kept_text")
    k1, k2, drop = fresh(docs, "k1", "k2", "drop")
    one, two = row_keys(docs, id_col, text_col)
    keyed = docs.withColumns({k1: one, k2: two})
    lines = F.split(text_or_empty(text_col), "\n", -1)
    hashed = materialise(
        keyed.select(
            F.col(id_col), F.col(k1).alias("k1"), F.col(k2).alias("k2"),
            F.filter(
                F.transform(lines, lambda line, i: let(line_key(line), lambda key: F.struct(
                    i.alias("pos"), (F.length(key) >= min_chars).alias("long"), F.xxhash64(F.lit(1), key).alias("a"), F.xxhash64(F.lit(2), key).alias("b")
                ))),
                lambda k: k["long"],
            ).alias("keys"),
        ).select(id_col, "k1", "k2", F.transform("keys", lambda k: F.struct(k["pos"], k["a"], k["b"])).alias("keys"))
    )
    repeated = repeated_lines(hashed.select(id_col, "keys"), id_col, min_docs, batches)
    places = hashed.select(F.col(id_col).alias("id"), "k1", "k2", F.explode("keys").alias("k")).select("id", "k1", "k2", "k.pos", "k.a", "k.b")
    drops = (
        places.join(repeated, ["a", "b"])
        .filter(~F.col("id").eqNullSafe(F.col("last")))
        .groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2))
        .agg(F.collect_set("pos").alias(drop))
    )
    joined = keyed.join(drops, [k1, k2], "left")
    gone = F.coalesce(F.col(drop), F.array().cast("array<int>"))
    kept = let(
        lines,
        lambda ls: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gone), lambda i: F.get(ls, i)), "\n"
        ),
    )
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size(lines).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_dropped"),
        kept.alias("kept_text"),
    )
