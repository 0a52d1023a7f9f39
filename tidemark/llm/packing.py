"""Packing by power-of-two decomposition.

A document of n ids is cut into pieces of ``window`` ids and, for the rest, one piece for each
binary digit of n, largest first.  Every piece is a sequence by itself, its length is a power of
two, and sequences are numbered bucket by bucket of equal length: no sequence crosses documents
and none needs padding.

Pieces are written once, so texts are encoded once.  A piece is numbered by its place among the
pieces of its length in its partition; the numbers before each (length, partition) are a table
with at most ``log2(window) + 1`` rows a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import named_id, slices, tidy
from tidemark.llm.encoding import encoder
from tidemark.operators.support import attach
from tidemark.session import materialise

#: Bytes of text whose pieces are held at a time.
HELD = 1_000_000


def piece_lengths(n: int, window: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids: whole windows, then the binary digits of the rest."""
    rest = n % window
    return [window] * (n // window) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def _pieces(tokenizer: str, window: int, end_id: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encode = encoder(tokenizer).encode
        part, places = TaskContext.get().partitionId(), {}
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for piece in slices(batch, HELD):
                rows: list[tuple] = []
                for row, text in enumerate(piece.column(0).to_pylist()):
                    tokens = encode(text or "") + end
                    n, start = len(tokens) // 4, 0
                    for length in piece_lengths(n, window):
                        place = places.get(length, 0)
                        places[length] = place + 1
                        rows.append((row, start, length, tokens[4 * start : 4 * (start + length)], n, part, place))
                        start += length
                row, *cols = zip(*rows)
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
                arrays = [piece.column(1).take(pa.array(row)), *[pa.array(c, k) for c, k in zip(cols, kinds)]]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "start", "length", "ids", "doc_tokens", "part", "place"])

    return tidy(run)


def pack_powers_of_two(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, end_id: int = 0
) -> DataFrame:
    """Pieces of all rows: id, ``start``, ``length``, ``ids`` (binary, little-endian unsigned 32 bit),
    ``doc_tokens``, ``sequence_id`` (gapless from 0, by length), ``offset`` (always 0).

    ``end_id`` ends every document, so null and empty texts give one piece of one id.  A null id
    is passed on; repeated rows are packed each.  An empty table gives an empty result.  Other
    columns of ``docs`` are not used; a column of the result that is named like the id gets another name.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids binary, doc_tokens long, part long, place long"
    pieces = materialise(rows.mapInArrow(_pieces(tokenizer, window, end_id), schema))
    counts = materialise(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    # numbers before each bucket, then before each partition within it
    buckets = counts.groupBy("length").agg(F.sum("n").alias("all"))
    buckets = buckets.withColumn("all", F.coalesce(F.sum("all").over(Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = counts.withColumn("before", before).join(F.broadcast(buckets), "length")
    firsts = firsts.select("length", "part", (F.col("all") + F.col("before")).alias("first"))
    out = attach(pieces, firsts, ["length", "part"]).select(
        "id", "start", "length", "ids", "doc_tokens",
        (F.col("first") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    return named_id(out, id_col)
