"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyspark
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space of all contracts here: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters keep their case, so results do not depend on a locale."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    # for pure ASCII the built-in lower() gives the same and is much faster
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, letters, letters.lower()))


def row_keys(docs: DataFrame, *columns: str) -> list[Column]:
    """Two 64-bit hashes of ``columns``, never null: a key that joins results back to their rows.

    Rows that agree in all of them share a key, and so the result, which depends on them only.
    """
    cols = [F.col(f"`{c}`") for c in columns]
    return [F.xxhash64(F.lit(1), *cols), F.xxhash64(F.lit(2), *cols)]


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that ``df`` does not have (Spark compares them without case)."""
    taken = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        names.append(name)
    return names


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add under the same name."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def named_id(df: DataFrame, id_col: str) -> DataFrame:
    """``df`` with its column ``id`` under the caller's name; a column of ``df`` that has this name gets a fresh one."""
    if id_col.lower() == "id":
        return df.withColumnRenamed("id", id_col)
    for name in df.columns:
        if name.lower() == id_col.lower():
            (other,) = fresh(df, name)
            df = df.withColumnRenamed(name, other)
    return df.withColumnRenamed("id", id_col)


def process_memo(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, whichever tasks it runs.

    A worker keeps the memory of one operator only: another name starts with an empty one, so
    that a pipeline of operators needs no more memory than the largest of them.
    """
    memo = pyspark.__dict__.setdefault("_tidemark_memo", {})
    if name not in memo:
        memo.clear()
        give_back()
        memo[name] = {}
    return memo[name]


def give_back() -> None:
    """Freed memory of this Python worker goes back to the system, where the C library can do so.

    A worker lives on between tasks and stages, and shares the executor's memory with all that follows.
    """
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function of a task that gives freed memory back when it ends."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return tidied


def by_bytes(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` characters; a longer text is a range of its own."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def text_bytes(column):
    """Bytes of a text column and where its texts begin, with the end; a null is empty."""
    import numpy as np
    import pyarrow as pa

    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def slices(batch, limit: int) -> Iterator:
    """Slices of ``batch`` with about ``limit`` bytes of text in its first column; a longer text is a slice of its own.

    Texts become Python strings a slice at a time, so a task holds few of them whatever the size of a batch.
    """
    import numpy as np

    _, starts = text_bytes(batch.column(0))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + limit, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, inside one expression."""
    return F.element_at(F.transform(F.array(value), then), 1)
