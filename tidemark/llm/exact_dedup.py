"""Exact de-duplication by progressive refinement: length, prefix hash, full hash.

Rows are narrowed level by level.  Level 1 groups by the length of the normalised text, level 2
by length and a hash of its first characters; both work on a written table of 24 bytes a row.
Only rows whose (length, prefix) group still has several members have their full content hashed
and shuffled (level 3); all others are unique and leave the job without moving.

Which (length, prefix) groups survive level 2 is a written table, so that Spark knows its size: it
is broadcast while it is small and joined by a shuffle beyond.  So are the groups of level 3.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, fresh, let, text_or_empty, without
from tidemark.operators.support import attach
from tidemark.session import discard, materialise

#: Characters of the normalised text that level 2 hashes.
PREFIX = 128


def normalised(text: str) -> Column:
    """Each run of white space replaced by one space; null counts as empty.

    Single characters are replaced by plain search; only a text with two spaces together then needs the pattern.
    """
    out = text_or_empty(text)
    for space in SPACES[1:]:
        out = F.replace(out, F.lit(space), F.lit(" "))
    return let(out, lambda t: F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, "  +", " ")).otherwise(t))


def _length_and_prefix(docs: DataFrame, text: str, names: list[str], keep_norm: bool = False) -> DataFrame:
    norm, length, prefix = names
    out = docs.withColumn(norm, normalised(text)).withColumns({length: F.length(norm), prefix: F.xxhash64(F.substring(norm, 1, PREFIX))})
    return out if keep_norm else out.drop(norm)


def surviving_pairs(docs: DataFrame, text_col: str, length: str, prefix: str) -> DataFrame:
    """The (length, prefix hash) pairs that several rows share."""
    keys = materialise(_length_and_prefix(docs.select(F.col(text_col).alias("text")), "text", ["norm", "length", "prefix"]).select("length", "prefix"))
    lengths = keys.groupBy("length").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("length")
    pairs = attach(keys, lengths, "length", "left_semi").groupBy("length", "prefix").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    out = materialise(pairs.select(F.col("length").alias(length), F.col("prefix").alias(prefix)))
    discard(keys)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_digest: bool = False) -> DataFrame:
    """Every row of ``docs`` with ``keep_id``, ``group_size``, ``kept`` (and ``text_sha256``).

    Texts are equal when identical after each run of white space is replaced by one space.  The
    smallest id of a group stays.  Null text counts as empty.  A null id is larger than any
    other; rows of a group in which all ids are null, and rows that repeat the smallest id, are
    all kept, as the id cannot tell them apart.  Columns of ``docs`` with the names of the added
    ones are replaced; an empty table gives an empty result.
    """
    docs = without(docs, "keep_id", "group_size", "kept", "text_sha256")
    norm, length, prefix, full, keep, size = fresh(docs, "norm", "length", "prefix", "full", "keep", "size")
    pairs = surviving_pairs(docs, text_col, length, prefix)
    hashed = F.sha2(F.col(norm), 256)

    def marked(rows: DataFrame, how: str) -> DataFrame:
        return _length_and_prefix(rows, text_col, [norm, length, prefix], keep_norm=True).join(pairs, [length, prefix], how)

    narrow = docs.select(*dict.fromkeys([id_col, text_col]))
    members = marked(narrow, "left_semi").select(F.col(id_col).alias(keep), hashed.alias(full))
    groups = members.groupBy(full).agg(F.min(keep).alias(keep), F.count(F.lit(1)).alias(size)).filter(F.col(size) > 1)
    copies = attach(marked(docs, "left_semi").withColumn(full, hashed), groups, full, "left")
    singles = marked(docs, "left_anti").withColumns({full: hashed if with_digest else F.lit(None).cast("string"), keep: F.col(id_col), size: F.lit(1)})
    alone = F.col(size).isNull()

    def finished(rows: DataFrame) -> DataFrame:
        return rows.select(
            *[F.col(f"`{c}`") for c in docs.columns],
            F.when(alone, F.col(id_col)).otherwise(F.col(keep)).alias("keep_id"),
            F.coalesce(size, F.lit(1)).cast("long").alias("group_size"),
            (alone | F.col(id_col).eqNullSafe(F.col(keep))).alias("kept"),
            *([F.col(full).alias("text_sha256")] if with_digest else []),
        )

    return finished(singles).unionByName(finished(copies))
