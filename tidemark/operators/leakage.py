"""Duplicates inside a split and leakage between splits.

Rows are compared on whole key texts; the 64-bit hash only leads the shuffle and the sort.
Copies are combined map-side, so a text with millions of copies is a few rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.support import attach
from tidemark.session import materialise


def _hash(keys: Sequence[str]):
    return F.xxhash64(*[F.col(k) for k in keys]).alias("__h")


def dedup_keep_first(df: DataFrame, keys: Sequence[str], row_id: str, split: str = "split") -> DataFrame:
    """The first row (by ``row_id``) per split and key; null keys are equal."""
    rest = [c for c in df.columns if c not in keys and c != split]
    first = F.min_by(F.struct(*rest), F.col(row_id)).alias("__r")
    kept = df.groupBy(_hash(keys), split, *keys).agg(first)
    return kept.select(split, *keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def _key_counts(df: DataFrame, keys: Sequence[str], split: str) -> DataFrame:
    """One row per key: copies in each split."""
    c = F.col(split)
    return df.groupBy(_hash(keys), *keys).agg(*[F.count_if(c == s).alias(s) for s in ("train", "val", "test")])


def overlap(df: DataFrame, keys: Sequence[str], split: str = "split") -> DataFrame:
    """Distinct keys shared by each pair of splits."""
    k = _key_counts(df, keys, split)
    pairs = [("train", "val"), ("train", "test"), ("val", "test")]
    row = k.agg(*[F.count_if((F.col(a) > 0) & (F.col(b) > 0)).alias(f"{a}_{b}") for a, b in pairs])
    cells = ", ".join(f"'{a}', '{b}', {a}_{b}" for a, b in pairs)
    return row.selectExpr(f"stack(3, {cells}) as (left_split, right_split, n_shared)")


def check_held_out(df: DataFrame, keys: Sequence[str], split: str = "split") -> None:
    """Raise when the validation and test splits share a row."""
    held = df.filter(F.col(split).isin("val", "test"))
    shared = _key_counts(held, keys, split).filter((F.col("val") > 0) & (F.col("test") > 0))
    n = shared.count()
    if n:
        raise ValueError(f"{n} identical samples in both val and test")


def remove_leaks(df: DataFrame, keys: Sequence[str], split: str = "split", check: bool = True) -> DataFrame:
    """Train loses every row whose key is in val or test (null keys are equal); val and test are kept as they are."""
    if check:
        check_held_out(df, keys, split)
    held = df.filter(F.col(split).isin("val", "test"))
    train = df.filter(F.col(split) == "train")
    train = train.withColumn("__h", F.xxhash64(*[F.col(k) for k in keys]))
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    known = held.select(F.xxhash64(*[F.col(k) for k in keys]).alias("__h2"), *[F.col(k).alias(v) for k, v in names.items()]).distinct()
    rule = F.col("__h") == F.col("__h2")
    for k, v in names.items():
        rule = rule & F.col(k).eqNullSafe(F.col(v))
    return train.join(known, rule, "left_anti").drop("__h").unionByName(held)


def drop_shared(df: DataFrame, keys: Sequence[str], split: str = "split") -> DataFrame:
    """Validation loses the rows whose key is in test."""
    test = df.filter(F.col(split) == "test").select(F.xxhash64(*[F.col(k) for k in keys]).alias("__h"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    rule = F.xxhash64(*[F.col(k) for k in keys]) == F.col("__h")
    for i, k in enumerate(keys):
        rule = rule & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    val = df.filter(F.col(split) == "val").join(test.distinct(), rule, "left_anti")
    return df.filter(F.col(split) != "val").unionByName(val)


def settle_splits(df: DataFrame, keys: Sequence[str], row_id: str, split: str = "split", on_overlap: str = "raise") -> DataFrame:
    """De-duplication and leak removal in one grouping by key.

    Of each key the first row (by ``row_id``) of every split is taken.  Train keeps it if no other split
    has the key; validation and test keep theirs.  A key that both of these hold raises an error, or
    leaves validation with ``on_overlap="drop"``.  Null keys are equal.
    """
    if on_overlap not in ("raise", "drop"):
        raise ValueError("on_overlap is raise or drop")
    rest = [c for c in df.columns if c not in (*keys, split, row_id)]
    names = ("train", "val", "test")
    firsts = [F.min(F.when(F.col(split) == s, F.struct(row_id, *rest))).alias(f"__{s}") for s in names]
    keyed = materialise(df.groupBy(_hash(keys), *keys).agg(*firsts))
    val, test = F.col("__val"), F.col("__test")
    if on_overlap == "raise":
        n = keyed.filter(val.isNotNull() & test.isNotNull()).count()
        if n:
            raise ValueError(f"{n} identical samples in both val and test")
    kept = {"train": val.isNull() & test.isNull(), "val": test.isNull(), "test": F.lit(True)}
    rows = [F.when(F.col(f"__{s}").isNotNull() & rule, F.struct(F.lit(s).alias("s"), F.col(f"__{s}").alias("r"))) for s, rule in kept.items()]
    out = keyed.select(*keys, F.explode(F.array_compact(F.array(*rows))).alias("__k"))
    return out.select(*[F.col("__k.s").alias(c) if c == split else F.col(c) if c in keys else F.col(f"__k.r.{c}").alias(c) for c in df.columns])


def leak_report(df: DataFrame, keys: Sequence[str], split: str = "split") -> DataFrame:
    """Sizes before and after, duplicates per split and leakage counts, from one grouping by key."""
    k = _key_counts(df, keys, split)
    tr, va, te = (F.col(s) for s in ("train", "val", "test"))
    leaks = (tr > 0) & ((va > 0) | (te > 0))
    row = k.agg(
        *[F.sum(s).alias(f"original_{s}") for s in ("train", "val", "test")],
        *[F.sum(F.greatest(F.col(s) - 1, F.lit(0))).alias(f"intra_{s}") for s in ("train", "val", "test")],
        F.count_if(leaks).alias("cross_removed"),
        F.count_if((tr > 0) & (va > 0)).alias("overlap_train_val"),
        F.count_if((tr > 0) & (te > 0)).alias("overlap_train_test"),
        F.count_if((va > 0) & (te > 0)).alias("overlap_val_test"),
    )
    row = row.withColumns(
        {
            "final_train": F.col("original_train") - F.col("intra_train") - F.col("cross_removed"),
            "final_val": F.col("original_val") - F.col("intra_val"),
            "final_test": F.col("original_test") - F.col("intra_test"),
            "total_intra": F.col("intra_train") + F.col("intra_val") + F.col("intra_test"),
        }
    )
    total = F.col("total_intra") + F.col("cross_removed")
    return row.withColumns({"total_removed": total, "leakage_cleaned": total > 0})


def contamination(docs: DataFrame, doc_id: str, text: str, held_out: DataFrame, held_text: str) -> DataFrame:
    """Passages (text lines) of each document that equal a passage of the held-out text.

    Lines are compared whole, trimmed and lower-cased.  Repeats are added up per document
    before the join, so a line that fills a third of the corpus is joined once per document.
    """

    def line(col):
        return F.explode(F.split(F.col(col), "\n"))

    def tidy(c):
        return F.lower(F.trim(c))

    passages = held_out.select(line(held_text).alias("l")).select(tidy(F.col("l")).alias("passage")).filter(F.col("passage") != "").distinct()
    passages = passages.select(F.xxhash64("passage").alias("h"), "passage")
    lines = (
        docs.select(doc_id, line(text).alias("l"))
        .select(doc_id, tidy(F.col("l")).alias("passage"))
        .filter(F.col("passage") != "")
        .groupBy(doc_id, F.xxhash64("passage").alias("h"), "passage")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        attach(lines, passages, ["h", "passage"], "left_semi")
        .groupBy(doc_id)
        .agg(F.count(F.lit(1)).alias("n_passages"), F.sum("n").alias("n_lines"))
    )
