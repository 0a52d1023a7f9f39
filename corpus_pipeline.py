"""Corpus pipeline: stages over ``documents``, each applying one operator of ``tidemark.llm``.

Every stage but the last returns rows of its input, with the columns of ``documents``; the last
returns packed sequences.  A stage sees all that its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, row_keys
from tidemark.llm.exact_dedup import exact_dedup, normalised
from tidemark.llm.jaccard_join import near_duplicates
from tidemark.llm.langid import keep_agreed
from tidemark.llm.packing import pack_powers_of_two
from tidemark.llm.quality import keep_good
from tidemark.session import discard, materialise, settings

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A document goes if fewer of its words than this agree on a language.
LEAST_AGREEMENT = 0.4
TOKENIZER = "byte_bpe_50k.json"
#: Whole documents pass to Python workers; a batch of them is held on either side, outside the heap of Spark's process.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def _without(docs: DataFrame, rejected: DataFrame, *columns: str) -> DataFrame:
    """``docs`` without the rows whose keys over ``columns`` are in ``rejected (k1, k2)``.

    The rejected keys are written, so that few of them are broadcast and many are joined.
    """
    k1, k2 = fresh(docs, "k1", "k2")
    one, two = row_keys(docs, *columns)
    gone = materialise(rejected.select(F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct())
    return docs.withColumns({k1: one, k2: two}).join(gone, [k1, k2], "left_anti").select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that fail the base rules or lie outside the perplexity band of their language."""
    return keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letters or whose words agree on no language."""
    return keep_agreed(docs, LEAST_AGREEMENT)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, as it came; of repeated rows, one."""
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = exact_dedup(whole).filter("kept")
    # rows of a group that share the smallest id are told apart by nothing: one of them stays
    groups = found.filter("group_size > 1").groupBy(F.sha2(normalised("text"), 256).alias("full"))
    first = groups.agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return found.filter("group_size = 1").select("row.*").unionByName(first.select("row.*"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts stays, that with the smallest id; of repeated rows, one.

    Linked rows that share this id, or have none, but differ in text all stay: the id does not tell them apart.
    """
    found = materialise(near_duplicates(docs))
    stay = F.col("doc_id").eqNullSafe(F.col("component_id"))
    repeated = found.filter(stay & (F.col("n_shingles") > 0)).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k1", "k2")
    repeated = materialise(repeated)
    kept = _without(docs, found.filter(~stay).select("k1", "k2").unionByName(repeated), "doc_id", "text")
    k1, k2 = fresh(docs, "k1", "k2")
    one, two = row_keys(docs, "doc_id", "text")
    again = docs.withColumns({k1: one, k2: two}).join(repeated.toDF(k1, k2), [k1, k2], "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.unionByName(again.groupBy(k1, k2).agg(F.min_by(row, F.xxhash64(row)).alias("row")).select("row.*"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as sequences whose lengths are powers of two."""
    return pack_powers_of_two(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("language_id", language),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard", near_copies),
    ("packing", packed),
]

#: Perplexity, CRF labels and token ids are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written as Parquet to the shared folder and read by the next; spent ones are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with settings(spark, SMALL_BATCHES):
        for _, stage in STAGES[:-1]:
            before, docs = docs, materialise(stage(spark, docs, sf_dir))
            discard(before)
        return STAGES[-1][1](spark, docs, sf_dir)
