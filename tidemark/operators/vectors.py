"""Similarity search over an array<float> column."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import ordered
from tidemark.session import materialise

QUERY_BLOCK, CORPUS_BLOCK = 1024, 8192  # rows that meet in one matrix product
DIGITS = 12  # of a similarity that count
BUCKETS = [round(i / 10, 1) for i in range(11)]  # fixed values: similarity bucket bounds


def vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """0.0 when either side has no length."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def l2_squared(a: Column, b: Column) -> Column:
    def square(x, y):
        d = x.cast("double") - y.cast("double")
        return d * d

    return F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda acc, v: acc + v)


def l2_topk(df: DataFrame, key: str, vec: str, query: Sequence[float], k: int, keep: Sequence[str] = ()) -> DataFrame:
    """The k nearest rows; every task forwards only its own k."""
    near = df.select(key, *keep, l2_squared(F.col(vec), vector(query)).alias("distance"))
    return near.orderBy("distance", key).limit(k)


def topk_then_filter(df: DataFrame, key: str, vec: str, metadata: str, query: Sequence[float], k: int) -> DataFrame:
    """Top k first, then rows with at most one metadata key are dropped: fewer than k may remain."""
    return l2_topk(df, key, vec, query, k, [metadata]).filter(F.size(F.map_keys(metadata)) > 1).drop(metadata)


def rank_all(df: DataFrame, key: str, vec: str, query: Sequence[float]) -> DataFrame:
    """Every row with its place by cosine; rows without a vector are skipped."""
    rows = df.filter(F.size(vec) > 0).select(key, cosine(F.col(vec), vector(query)).alias("similarity"))
    runs = ordered.split_runs(rows, [], "similarity", [key], desc=True)
    return ordered.positions(runs, {"place": "row_number"})


def two_stage(df: DataFrame, key: str, vec: str, first: Sequence[float], refined: Sequence[float], k: int, candidates: int = 10) -> DataFrame:
    """Candidates of the raw query, then k + 1 rows for the refined one."""
    place = Window.partitionBy("stage").orderBy("distance", key)  # at most `candidates` or k + 1 rows
    a = l2_topk(df, key, vec, first, candidates).withColumn("stage", F.lit(1))
    b = l2_topk(df, key, vec, refined, k + 1).withColumn("stage", F.lit(2))
    return a.unionByName(b).withColumn("place", F.row_number().over(place))


def _numbered_blocks(rows: DataFrame, key: str, limit: int, name: str) -> tuple[DataFrame, int]:
    """Rows dealt by hash of key and vector into blocks of about ``limit`` rows, and the number of blocks."""
    blocks = max(1, -(-rows.count() // limit))
    return rows.withColumn(name, F.pmod(F.xxhash64(*rows.columns), F.lit(blocks)).cast("int")), blocks


def batch_topk(
    queries: DataFrame, corpus: DataFrame, qkey: str, key: str, vec: str, k: int, query_block: int = QUERY_BLOCK, corpus_block: int = CORPUS_BLOCK
) -> DataFrame:
    """Top k by cosine for many queries at once: query key, key, ``similarity``, ``place`` (equal ones by key).

    Queries and corpus are dealt into blocks of bounded size.  Every pair of blocks meets in one
    task, is one matrix product, and sends on k rows for each of its queries, so neither side
    passes the driver or has to fit a task.  Queries and rows without a vector are skipped; a vector of
    length 0 has similarity 0 to every other.  Repeated queries are answered each.
    """
    q, n_q = _numbered_blocks(queries.filter(F.size(vec) > 0).select(F.col(qkey).alias("q"), F.col(vec).alias("v")), "q", query_block, "qb")
    c, n_c = _numbered_blocks(corpus.filter(F.size(vec) > 0).select(F.col(key).alias("c"), F.col(vec).alias("v")), "c", corpus_block, "cb")
    # repeated queries are told apart by a number of their own, written so that it stays the same
    q = materialise(q.withColumn("n", F.monotonically_increasing_id())).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))
    c = c.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    types = {name: df.schema[name].dataType.simpleString() for df, name in ((q, "q"), (c, "c"))}
    pairs = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb"))
    near = pairs.applyInArrow(_block_topk(k), f"n long, q {types['q']}, c {types['c']}, similarity double")
    best = Window.partitionBy("n").orderBy(F.desc("similarity"), "c")
    ranked = near.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
    return ranked.select(F.col("q").alias(qkey), F.col("c").alias(key), "similarity", "place")


def _unit(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows of length 1 (or 0)."""
    flat = np.asarray(pc.list_flatten(vectors), dtype="float64")
    matrix = np.nan_to_num(flat).reshape(len(vectors), -1)
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _block_topk(k: int):
    def run(queries: pa.Table, corpus: pa.Table) -> pa.Table:
        corpus = corpus.sort_by("c")  # equal similarities: the smaller key first
        rows, found, values = [], [], []
        if queries.num_rows and corpus.num_rows:
            # rounded, as equal vectors may differ in the last digits of a matrix product
            scores = np.round(_unit(queries.column("v")) @ _unit(corpus.column("v")).T, DIGITS) + 0.0  # no negative zero
            take = min(k, scores.shape[1])
            bars = np.partition(scores, scores.shape[1] - take, axis=1)[:, -take]
            for i, (line, bar) in enumerate(zip(scores, bars)):
                hit = np.flatnonzero(line >= bar)
                hit = hit[np.argsort(-line[hit], kind="stable")[:take]]
                rows.append(np.full(len(hit), i))
                found.append(hit)
                values.append(line[hit])
        at, hit = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (rows, found))
        asked, known = queries.take(pa.array(at)), corpus.take(pa.array(hit))
        similarity = pa.array(np.concatenate([*values, np.zeros(0)]), pa.float64())
        return pa.Table.from_arrays([asked.column("n"), asked.column("q"), known.column("c"), similarity], ["n", "q", "c", "similarity"])

    return run


def best_similarity(df: DataFrame, key: str, vec: str, candidates: Sequence[Sequence[float]]) -> DataFrame:
    """Each row's cosine to the nearest of a few fixed vectors (databases to choose from)."""
    choices = F.array(*[vector(c) for c in candidates])
    best = F.array_max(F.transform(choices, lambda c: cosine(F.col(vec), c)))
    return df.filter(F.size(vec) > 0).select(key, best.alias("similarity"))


def similarity_histogram(df: DataFrame, col: str = "similarity", buckets: Sequence[float] = BUCKETS) -> DataFrame:
    """Cumulative counts per upper bound, the last one open."""
    row = df.agg(*[F.count_if(F.col(col) <= b).alias(f"b{i}") for i, b in enumerate(buckets)], F.count(col).alias("all"))
    cells = [f"'{b:g}', b{i}" for i, b in enumerate(buckets)] + ["'+Inf', `all`"]
    return row.selectExpr(f"stack({len(cells)}, {', '.join(cells)}) as (le, n_rows)")
