"""Token-id files with shuffled planes.

Ids of all documents stand one after another, cut into blocks of BLOCK ids.  A block is
transposed: plane i holds the i-th byte (or bit) of every id, and each plane is compressed by
itself with zstandard.  High planes are nearly constant and cost almost nothing.

Layout of a block (fixed values): ``TMBP``, version 1, plane kind (0 bytes, 1 bits), two zero
bytes, number of ids (uint32), number of planes (uint32), compressed length of each plane
(uint32 each), then the planes; all little-endian.

A data set is a Parquet table with a row per block, so Spark's commit protocol covers lost
executors and any store works: ``part`` (ascending with the documents), ``chunk``, ``first``
(ids of the part before it), ``n_ids``, ``block``, and the documents in it.  All but ``block``
is the chunk index, read without touching the data.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.encoding import encoder
from tidemark.operators.support import attach
from tidemark.session import shared_folder

#: Ids of one block.
BLOCK = 1 << 16
MAGIC = b"TMBP"
KINDS = {"bytes": 0, "bits": 1}
LEVEL = 3


def pack_block(ids: bytes, planes: str = "bytes") -> bytes:
    """A block of ``ids`` (little-endian unsigned 32 bit)."""
    import numpy as np
    import zstandard

    n = len(ids) // 4
    if planes == "bytes":
        rows = np.frombuffer(ids, np.uint8).reshape(n, 4).T
        cut = [np.ascontiguousarray(r).tobytes() for r in rows]
    else:
        bits = np.unpackbits(np.frombuffer(ids, np.uint8).reshape(n, 4), axis=1, bitorder="little")
        cut = [p.tobytes() for p in np.packbits(bits.T, axis=1, bitorder="little")]
    squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
    done = [squeeze(p) for p in cut]
    head = MAGIC + struct.pack("<BBHII", 1, KINDS[planes], 0, n, len(done)) + struct.pack(f"<{len(done)}I", *map(len, done))
    return head + b"".join(done)


def unpack_block(block: bytes) -> bytes:
    """The ids that ``pack_block`` was given."""
    import numpy as np
    import zstandard

    if block[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    version, kind, _, n, count = struct.unpack_from("<BBHII", block, 4)
    if version != 1:
        raise ValueError(f"unknown version {version}")
    sizes = struct.unpack_from(f"<{count}I", block, 16)
    at, expand = 16 + 4 * count, zstandard.ZstdDecompressor().decompress
    width = n if kind == 0 else (n + 7) // 8
    planes = np.empty((count, width), np.uint8)
    for i, size in enumerate(sizes):
        planes[i] = np.frombuffer(expand(block[at : at + size]), np.uint8)
        at += size
    if kind == 0:
        return np.ascontiguousarray(planes.T).tobytes()
    bits = np.unpackbits(planes, axis=1, count=n, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").tobytes()


def _write(tokenizer: str, end_id: int, block: int, planes: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encode = encoder(tokenizer).encode
        part, chunk, first, ordinal = TaskContext.get().partitionId(), 0, 0, 0
        end = end_id.to_bytes(4, "little")
        held, size, docs = [], 0, []
        id_type = pa.int64()

        def flush():
            nonlocal chunk, first, held, size, docs
            frag = pa.struct([("ordinal", pa.int64()), ("id", id_type), ("at", pa.int64()), ("n", pa.int64()), ("total", pa.int64())])
            row = [part, chunk, first, size, pack_block(b"".join(held), planes), docs]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(frag)]
            out = pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["part", "chunk", "first", "n_ids", "block", "docs"])
            chunk, first, held, size, docs = chunk + 1, first + size, [], 0, []
            return out

        for batch in batches:
            id_type = batch.column(0).type
            for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = encode(text.as_py() or "") + end
                total, at = len(tokens) // 4, 0
                while at < total:
                    n = min(total - at, block - size)
                    held.append(tokens[4 * at : 4 * (at + n)])
                    docs.append({"ordinal": ordinal, "id": row_id, "at": size, "n": n, "total": total})
                    size, at = size + n, at + n
                    if size == block:
                        yield flush()
                ordinal += 1
        if size:
            yield flush()

    return run


def write_tokens(
    docs: DataFrame, tokenizer: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = 1, block: int = BLOCK, planes: str = "bytes",
) -> str:
    """Encode every row and write the ids in ascending id order; returns the folder.

    ``end_id`` ends each document, so null and empty texts are one id.  Rows with equal ids
    stand in the order of a hash of their text; null ids come first.  The order is by range
    partitions, so no task holds more than its range; equal ids are dealt out by the hash too.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    order = [F.col("id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = (
        "part long, chunk long, first long, n_ids long, block binary, "
        f"docs array<struct<ordinal:bigint,id:{kind},at:bigint,n:bigint,total:bigint>>"
    )
    path = path or shared_folder(docs.sparkSession, "token-ids")
    ordered.mapInArrow(_write(tokenizer, end_id, block, planes), schema).write.option("compression", "uncompressed").parquet(path)
    return path


def _read(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for i in range(batch.num_rows):
            part, first = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            ids = unpack_block(batch.column(2)[i].as_py())
            docs = batch.column(3)[i].values
            ordinal, at, n, total = (docs.field(k).to_pylist() for k in ("ordinal", "at", "n", "total"))
            cols = [
                pa.array([part] * len(docs), pa.int64()), docs.field("ordinal"), docs.field("id"),
                pa.array([first + a for a in at], pa.int64()), docs.field("n"), docs.field("total"),
                pa.array([ids[4 * a : 4 * (a + k)] for a, k in zip(at, n)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["part", "ordinal", "id", "at", "n", "total", "ids"])


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Every document of the data set: id, ``start`` (ids of all documents before), ``n_tokens``, ``ids``.

    A document within one block comes from it; the pieces of others (one or two a block) meet
    by document.
    """
    table = spark.read.parquet(path)
    kind = table.schema["docs"].dataType.elementType["id"].dataType.simpleString()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = table.groupBy("part").agg(F.sum("n_ids").alias("all"))
    parts = parts.select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    pieces = table.select("part", "first", "block", "docs").mapInArrow(
        _read, f"part long, ordinal long, id {kind}, at long, n long, total long, ids binary"
    )
    whole = pieces.filter("n = total").select("part", "id", "at", "total", "ids")
    cut = (
        pieces.filter("n < total")
        .groupBy("part", "ordinal", "id", "total")
        .agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("cuts"))
        .select("part", "id", F.col("cuts")[0]["at"].alias("at"), "total", F.aggregate("cuts", F.lit(b""), lambda a, c: F.concat(a, c["ids"])).alias("ids"))
    )
    return attach(whole.unionByName(cut), parts, "part").select(
        F.col("id").alias(id_col), (F.col("base") + F.col("at")).alias("start"), F.col("total").alias("n_tokens"), "ids"
    )
