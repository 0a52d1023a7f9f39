"""Ranked lexical search with hashed max-sketches.

Index: a document is kept as its distinct terms with their counts and as a sketch, two rows of
slots in which every term leaves its count by two hashes; a slot keeps the largest.  The part of
an impact that depends on the document, ``tf / (tf + k * m)`` in integers, grows with the count and has
the same m for all terms of a document, so the largest count of a slot is the largest impact.
A query term's impact is at most the smaller of its two slots times its weight, and a query's
score at most the sum of these.  Slots are four times the distinct terms or more, so a term that
the document does not have finds both its slots taken once in 16 or more.

Search: queries pass through in blocks of bounded size.  The bounds of a block's queries against
all documents give, for each query, the SEEDS documents with the highest bounds; their exact
scores give the threshold.  Then every document whose bound reaches its query's threshold is
scored exactly, in the order of descending bounds, and the threshold of a task rises as it
goes; it stops where bounds fall below.  No document that could be in the result is left out.

The index is written with the document frequency of every term, counted within tasks first.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import tidy
from tidemark.session import discard, materialise, settings

#: Terms whose frequencies a task holds before it sends them on.
HELD_TERMS = 300_000
#: Queries of a block: this many, or this many characters.
BLOCK_ITEMS, BLOCK_CHARS = 512, 1_000_000
#: Documents per query that set the first threshold.
SEEDS = 40
#: Documents that a task indexes, and whose bounds it holds, at a time.
HELD_DOCS = 256
#: Documents pass to Python workers with their sketches and terms; either side holds a batch of them, outside the heap of Spark's process.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(HELD_DOCS)}
#: Each slot holds a count rounded up to one of these: exact up to 128, then by eighths.
EXACT_COUNTS, LEVELS = 128, 255


def count_levels():
    """Counts that a slot can tell apart; the last is beyond any text."""
    import numpy as np

    high = EXACT_COUNTS * 2.0 ** (np.arange(1, LEVELS - EXACT_COUNTS + 1) / 4)
    return np.concatenate([np.arange(1, EXACT_COUNTS + 1), np.ceil(high).astype(np.int64)])


def separators() -> bytes:
    """Byte table: ASCII letters and digits in lower case and all bytes beyond ASCII stay, the rest is a space."""
    return bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def slots_of(hashes, slots: int):
    """The two slots of each term."""
    import numpy as np

    one = hashes & np.uint64(slots - 1)
    two = ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) & np.uint64(slots - 1)
    return one.astype(np.int64), two.astype(np.int64)


def term_hashes(terms: list[bytes]):
    from zlib import crc32

    import numpy as np

    return np.fromiter(map(crc32, terms), np.uint64, len(terms))


def sketch(hashes, counts) -> tuple[int, bytes]:
    """Number of slots and the two rows of slots, a byte each."""
    import numpy as np

    slots = 1 << max(4, (4 * len(hashes) - 1).bit_length())
    level = (np.searchsorted(count_levels(), counts) + 1).astype(np.uint8)
    rows = np.zeros((2, slots), np.uint8)
    for row, at in zip(rows, slots_of(hashes, slots)):
        np.maximum.at(row, at, level)
    return slots, rows.tobytes()


DOC_COLUMNS = "n long, slots int, sketch binary, terms binary, counts binary"


@tidy
def _index(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    table = separators()
    place = TaskContext.get().partitionId() << 33
    frequency: Counter = Counter()
    types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())

    def entries():
        n = len(frequency)
        empty = [pa.nulls(n, t) for t in (ids.type, *types)]
        cols = [*empty, pa.array(frequency.keys(), pa.binary()), pa.array(frequency.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names)

    names = ["id", "doc", "n", "slots", "sketch", "terms", "counts", "term", "df"]
    pieces = (batch.slice(a, HELD_DOCS) for batch in batches for a in range(0, batch.num_rows, HELD_DOCS))
    for piece in pieces:
        ids, rows = piece.column(0), []
        for text in piece.column(1).to_pylist():
            words = (text or "").encode().translate(table).split()
            found = Counter(words)
            terms = list(found)
            counts = np.fromiter(found.values(), np.uint32, len(found))
            slots, held = sketch(term_hashes(terms), counts)
            rows.append((place, len(words), slots, held, b" ".join(terms), counts.tobytes()))
            place += 1
            frequency.update(terms)
        cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        yield pa.RecordBatch.from_arrays([ids, *cols, pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.int64())], names)
        if len(frequency) >= HELD_TERMS:
            yield entries()
            frequency.clear()
    if frequency:
        yield entries()


class LexicalIndex:
    """The written index: ``docs (id, doc, n, slots, sketch, terms, counts)`` and ``frequencies (term, df)``."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        self.spark, self.id_type = docs.sparkSession, rows.schema["id"].dataType
        # documents and the frequencies of a task's terms are rows of one table: texts are cut once
        schema = f"id {self.id_type.simpleString()}, doc long, {DOC_COLUMNS}, term binary, df long"
        self.written = materialise(rows.mapInArrow(_index, schema))
        self.docs = self.written.filter(F.col("doc").isNotNull()).drop("term", "df")
        terms = self.written.filter(F.col("term").isNotNull()).select("term", "df")
        self.frequencies = materialise(terms.groupBy("term").agg(F.sum("df").alias("df")))
        sizes = self.docs.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.n_docs, self.n_terms = sizes[0], sizes[1]

    def weights(self, terms: list[str]) -> dict[bytes, int]:
        """Weight of each of ``terms``, a block's at most."""
        asked = self.spark.createDataFrame([(t.encode(),) for t in terms], "term binary")
        found = self.frequencies.join(F.broadcast(asked), "term").collect()
        return {bytes(r["term"]): math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * r["df"] + 1))) for r in found}


def query_terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(separators()).split()


class QueryBlock:
    """A block's queries as arrays: distinct terms with weight and hash, and the terms of each query."""

    def __init__(self, queries: list[list[bytes]], weight: dict[bytes, int], n_docs: int, n_terms: int):
        import numpy as np

        self.n_docs, self.n_terms = n_docs, n_terms
        self.terms = sorted(weight)
        number = {t: i for i, t in enumerate(self.terms)}
        self.weight = np.array([weight[t] for t in self.terms], np.int64)
        self.hashes = term_hashes(self.terms)
        self.uses = [Counter(t for t in q if t in number) for q in queries]
        self.flat = np.array([number[t] for u in self.uses for t in u.elements()], np.int64)
        self.starts = np.cumsum([0, *(sum(u.values()) for u in self.uses)])[:-1]
        self.value = dict(weight)

    def length_part(self, n: int) -> int:
        """12 times m of a document with ``n`` terms."""
        return 12 * (100 - 25 + (25 * n * self.n_docs) // max(1, self.n_terms))

    def bounds(self, n: int, slots: int, held: bytes, levels):
        """Upper bound of each query's score for a document."""
        import numpy as np

        one, two = slots_of(self.hashes, slots)
        rows = np.frombuffer(held, np.uint8).reshape(2, slots)
        level = np.minimum(rows[0, one], rows[1, two])
        seen = np.flatnonzero(level)
        tf = levels[level[seen] - 1]
        impact = np.zeros(len(level), np.int64)
        # beyond 2**30 occurrences the impact is 10**6 at most, which stays a bound
        part = np.where(tf < 1 << 30, (1_000_000_000 * np.minimum(tf, 1 << 30)) // (1000 * np.minimum(tf, 1 << 30) + self.length_part(n)), 1_000_000)
        impact[seen] = self.weight[seen] * part
        return np.add.reduceat(impact[self.flat], self.starts)

    def score(self, query: int, found: dict[bytes, int], n: int) -> int:
        part, total = self.length_part(n), 0
        for term, times in self.uses[query].items():
            tf = found.get(term)
            if tf:
                total += times * self.value[term] * ((1_000_000_000 * tf) // (1000 * tf + part))
        return total


def _found(terms: bytes, counts: bytes) -> dict[bytes, int]:
    import numpy as np

    return dict(zip(terms.split(b" "), np.frombuffer(counts, np.uint32).tolist())) if terms else {}


def _highest_bounds(shared, seeds: int):
    """Of each query, the ``seeds`` documents of a task with the highest bounds."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        block, levels = shared.value, count_levels()
        best = docs = None
        for batch in batches:
            for a in range(0, batch.num_rows, HELD_DOCS):
                rows = [c.to_pylist() for c in batch.slice(a, HELD_DOCS).columns]
                new = np.stack([block.bounds(n, s, h, levels) for _, n, s, h in zip(*rows)])
                names = np.broadcast_to(np.array(rows[0], np.int64)[:, None], new.shape)
                best = new if best is None else np.concatenate([best, new])
                docs = names if docs is None else np.concatenate([docs, names])
                if len(best) > seeds:
                    top = np.argpartition(best, len(best) - seeds, axis=0)[len(best) - seeds :]
                    best, docs = np.take_along_axis(best, top, 0), np.take_along_axis(docs, top, 0)
        if best is not None:
            rank, query = np.nonzero(best)
            cols = [query.astype(np.int32), docs[rank, query], best[rank, query]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query", "doc", "bound"])

    return tidy(run)


def _seed_scores(shared):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        block = shared.value
        for batch in batches:
            queries, scores = [], []
            for asked, n, terms, counts in zip(*[c.to_pylist() for c in batch.columns]):
                found = _found(terms, counts)
                queries += asked
                scores += [block.score(q, found, n) for q in asked]
            yield pa.RecordBatch.from_arrays([pa.array(queries, pa.int32()), pa.array(scores, pa.int64())], ["query", "score"])

    return tidy(run)


def _by_bound(shared, k: int):
    """Of each query, the k best documents of a task that can be among the k best of all."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        block, least = shared.value
        levels = count_levels()
        least = np.array(least, np.int64)
        kept: list[list[tuple]] = [[] for _ in least]  # (-score, null id last, id), best first when cut

        def cut(q: int) -> None:
            kept[q].sort()
            del kept[q][k:]
            if len(kept[q]) == k:
                least[q] = max(least[q], -kept[q][-1][0])

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for a in range(0, batch.num_rows, HELD_DOCS):
                ids, ns, slots, held, terms, counts = [c.to_pylist() for c in batch.slice(a, HELD_DOCS).columns]
                bounds = np.stack([block.bounds(n, s, h, levels) for n, s, h in zip(ns, slots, held)])
                docs, queries = np.nonzero(bounds >= least)
                reach = bounds[docs, queries]
                found: dict[int, dict] = {}
                for i in np.argsort(-reach, kind="stable").tolist():
                    d, q = int(docs[i]), int(queries[i])
                    if reach[i] < least[q]:
                        continue
                    if d not in found:
                        found[d] = _found(terms[d], counts[d])
                    score = block.score(q, found[d], ns[d])
                    if score >= least[q]:
                        kept[q].append((-score, ids[d] is None, ids[d] if ids[d] is not None else 0))
                        if len(kept[q]) >= 4 * k:
                            cut(q)
        rows = []
        for q in range(len(kept)):
            cut(q)
            rows += [(q, None if none else i, -s) for s, none, i in kept[q]]
        if rows:
            q, i, s = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(i, kind), pa.array(s, pa.int64())], ["query", "id", "score"])

    return tidy(run)


def _blocks(queries: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Queries with terms, streamed in blocks of bounded size."""
    block, chars = [], 0
    for r in queries.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text")).toLocalIterator():
        terms = query_terms(r["text"])
        if not terms:
            continue
        if block and (len(block) >= BLOCK_ITEMS or chars + len(r["text"]) > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((r["item"], terms))
        chars += len(r["text"])
    if block:
        yield block


def _search_block(index: LexicalIndex, items: list[tuple], item_type, k: int) -> DataFrame | None:
    spark = index.spark
    weight = index.weights(sorted({t.decode() for _, terms in items for t in terms}))
    items = [(item, [t for t in terms if t in weight]) for item, terms in items]
    items = [(item, terms) for item, terms in items if terms]
    if not items:
        return None
    block = QueryBlock([terms for _, terms in items], weight, index.n_docs, index.n_terms)
    shared = spark.sparkContext.broadcast(block)
    highest = index.docs.select("doc", "n", "slots", "sketch").mapInArrow(_highest_bounds(shared, SEEDS), "query int, doc long, bound long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "doc"))
    seeds = highest.withColumn("place", place).filter(F.col("place") <= SEEDS).groupBy("doc").agg(F.collect_list("query").alias("asked"))
    seeds = materialise(seeds)  # at most SEEDS documents for each query of a block
    scored = index.docs.select("doc", "n", "terms", "counts").join(F.broadcast(seeds), "doc").select("asked", "n", "terms", "counts")
    scored = scored.mapInArrow(_seed_scores(shared), "query int, score long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    least = scored.withColumn("place", place).filter(F.col("place") == k).select("query", "score").collect()
    reached = {r["query"]: r["score"] for r in least}
    both = spark.sparkContext.broadcast((block, [max(1, reached.get(q, 1)) for q in range(len(items))]))
    schema = f"query int, id {index.id_type.simpleString()}, score long"
    best = index.docs.select("id", "n", "slots", "sketch", "terms", "counts").mapInArrow(_by_bound(both, k), schema)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
    best = best.withColumn("rank", rank).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(items)], f"query int, item {item_type}")
    out = materialise(best.join(F.broadcast(names), "query").select("item", "rank", "id", "score"))
    discard(seeds)
    return out


def lexical_search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_id_col: str = "item_id",
    query_text_col: str = "text",
) -> DataFrame:
    """The ``k`` highest-scoring documents of each query: query id, ``rank`` from 1, document id, ``score``.

    Terms are maximal runs of ASCII letters and digits (A-Z lower-cased) and characters beyond
    ASCII.  Equal scores rank by ascending id, null ids last; only scores above 0 are returned.  Null
    and empty texts have no terms and are found by no query; a query without terms, or with none
    that a document has, gives no rows.  Repeated rows of either side count each.  Empty tables
    give an empty result; other columns are not used.
    """
    if query_id_col.lower() in (id_col.lower(), "rank", "score") or id_col.lower() in ("rank", "score"):
        raise ValueError("the columns of the result need different names")
    with settings(docs.sparkSession, SMALL_BATCHES):
        index = LexicalIndex(docs, id_col, text_col)
        item_type = queries.schema[query_id_col].dataType.simpleString()
        out = docs.sparkSession.createDataFrame([], f"item {item_type}, rank int, id {index.id_type.simpleString()}, score long")
        for items in _blocks(queries, query_id_col, query_text_col):
            found = _search_block(index, items, item_type, k)
            if found is not None:
                out = out.unionByName(found)
    return out.select(F.col("item").alias(query_id_col), "rank", F.col("id").alias(id_col), "score")
