"""Token-level comparison of two SQL strings, as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.sqltext import strip


def exact_match(predicted: Column, gold: Column) -> Column:
    return (F.lower(strip(predicted)) == F.lower(strip(gold))).cast("double")


def sql_tokens(sql: Column) -> Column:
    """Lower-cased tokens; brackets, commas and semicolons stand alone."""
    spaced = F.regexp_replace(F.lower(sql), r"([(),;])", " $1 ")
    return F.array_remove(F.split(spaced, r"\s+"), "")


def token_set(sql: Column) -> Column:
    return F.array_distinct(sql_tokens(sql))


def f1_micro(both: Column, n_predicted: Column, n_gold: Column) -> Column:
    """Shared share of all distinct tokens (micro average over the union); 1.0 when gold is empty."""
    return F.when(n_gold == 0, 1.0).otherwise(both / (n_predicted + n_gold - both))


def f1_binary(both: Column, n_predicted: Column, n_gold: Column) -> Column:
    """Harmonic mean of token precision and recall on distinct tokens; 1.0 when gold is empty."""
    return F.when(n_gold == 0, 1.0).otherwise(2 * both / (n_predicted + n_gold))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


CELLS = 1 << 20  # cells of one block of pairs


def _lcs_block(a: list, b: list) -> np.ndarray:
    """Longest common subsequences of the pairs (a[i], b[i]), a row of all their tables at a time."""
    wide, n_rows = max(map(len, b)), max(map(len, a))
    right = np.full((len(b), wide), -1, dtype=np.int64)
    left = np.full((len(a), n_rows), -2, dtype=np.int64)
    for i, (x, y) in enumerate(zip(a, b)):
        left[i, : len(x)], right[i, : len(y)] = x, y
    best = np.zeros((len(b), wide + 1), dtype=np.int32)
    for k in range(n_rows):
        taken = np.where(right == left[:, k : k + 1], best[:, :-1] + 1, best[:, 1:])
        best[:, 1:] = np.maximum.accumulate(taken, axis=1)
    return best[:, -1]


def lcs_length():
    """Arrow UDF over two columns of arrays of non-negative numbers.

    Pairs of like length meet in blocks; the widest row of a block times its pairs is bounded,
    so a very long text is a block of its own.
    """

    @F.pandas_udf("int")
    def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a), dtype=np.int32)
        sizes = pd.DataFrame({"a": a.map(len).to_numpy(), "b": b.map(len).to_numpy()})
        order = sizes[(sizes.a > 0) & (sizes.b > 0)].sort_values(["a", "b"]).index.to_numpy()
        widest = sizes.max(axis=1).to_numpy()
        start = 0
        while start < len(order):
            stop, most = start + 1, widest[order[start]]
            while stop < len(order):
                most = max(most, widest[order[stop]])
                if most * (stop - start + 1) > CELLS:
                    break
                stop += 1
            block = order[start:stop]
            out[block] = _lcs_block([a.iloc[i] for i in block], [b.iloc[i] for i in block])
            start = stop
        return pd.Series(out)

    return lcs
