"""Grouping of spelling variants with a bit-sliced position index.

For every position and letter there is a bitset over the words of a block: bit w says that word w
has this letter there.  A query word walks through its positions and updates three bitsets for
all words of the block at once: words that agree so far, words that agree but for one replaced
letter, and words that agree but for one more letter (their positions shifted by one).  The
block's queries are rows of one array, so that a step of all queries is one array operation.

Which words share a block: an edit lies in the first half of the shorter word or in the rest, so
the two words share the other part.  Each word is therefore filed under its first and its last
letters, once as the shorter or equal word and once as the longer one, and a near pair meets in
one of these blocks.  Work grows with the block sizes, not with the square of the vocabulary;
blocks of more than BLOCK words are cut into cells of queries by words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.support import attach
from tidemark.session import discard, materialise

#: Runs of letters, as the contract has them.
LETTER_RUN = "[A-Za-zÀ-ÿ]+"
#: Words counted by a task before it sends them on.
HELD_WORDS = 500_000
#: Words of a block before it is cut, and rows that one bit-sliced index takes.
BLOCK, BIN = 2048, 1024


def _count_words(drop_every: int, min_length: int):
    def run(batches: Iterator) -> Iterator:
        import re
        from zlib import crc32

        import pyarrow as pa

        find = re.compile(LETTER_RUN).findall
        counts: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                start = crc32(f"{doc or ''}:".encode())
                for word, n in Counter(find(text.encode().lower().decode())).items():
                    h = crc32(word.encode(), start)
                    if drop_every and h % drop_every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= min_length:
                        counts[word] += n
                if len(counts) >= HELD_WORDS:
                    yield rows()
                    counts.clear()
        if counts:
            yield rows()

    return run


def vocabulary(docs: DataFrame, id_col: str, text_col: str, drop_every: int, min_length: int, min_count: int) -> DataFrame:
    """``(word, n)``: words of at least ``min_length`` code points found at least ``min_count`` times in all texts."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(_count_words(drop_every, min_length), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _blocks(words: DataFrame) -> DataFrame:
    """Rows ``(word, n, size, suffix, cell, query, known)``: the blocks in which a word is compared.

    ``size`` is the length of the shorter words of the block, ``suffix`` tells first letters from
    last letters; in a ``cell`` of the block a word asks (``query``), is asked (``known``) or both.
    """
    length = F.length("word")
    filed = []
    for size, longer in ((length, False), (length - 1, True)):
        head = F.floor(size / 2).cast("int")
        for suffix, half in ((False, F.substring("word", F.lit(1), head)), (True, F.substring("word", F.length("word") - (size - head) + 1, size - head))):
            filed.append(F.struct(size.cast("int").alias("size"), F.lit(suffix).alias("suffix"), half.alias("half"), F.lit(longer).alias("longer")))
    rows = words.select("word", "n", F.explode(F.array(*filed)).alias("b")).select("word", "n", "b.*").filter("size > 0")
    key = ["size", "suffix", "half"]
    large = rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("cuts")).filter("cuts > 1")
    rows = attach(rows, large, key, "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("word"), F.col("cuts").cast("long")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("cuts") - 1), lambda i: i != F.col("own"))

    def cell(asks, asked, query, known):
        return F.struct((asks * F.col("cuts") + asked).alias("cell"), query.alias("query"), F.lit(known).alias("known"))

    as_query = F.when(~F.col("longer"), F.transform(others, lambda j: cell(F.col("own"), j, F.lit(True), False)))
    as_known = F.transform(others, lambda i: cell(i, F.col("own"), F.lit(False), True))
    both = F.array(cell(F.col("own"), F.col("own"), ~F.col("longer"), True))
    cells = F.concat(both, F.coalesce(as_query, F.array().cast("array<struct<cell:int,query:boolean,known:boolean>>")), as_known)
    return rows.withColumn("c", F.explode(cells)).select(
        "word", "n", "size", "suffix", F.xxhash64(*key, "c.cell").alias("block"), "c.query", "c.known"
    )


def letter_sets(codes, letters: int):
    """Bitsets over the rows of ``codes`` for one position: one for each letter."""
    import numpy as np

    same = codes[None, :] == np.arange(letters)[:, None]
    return as_words(same)


def as_words(flags):
    """Rows of flags as rows of 64-bit words, first flag in the lowest bit."""
    import numpy as np

    packed = np.packbits(flags, axis=1, bitorder="little")
    out = np.zeros((len(packed), -(-packed.shape[1] // 8) * 8), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def one_edit(codes, size: int, lengths, queries):
    """Bitsets (query by word) of the words one replaced or one inserted letter away.

    ``codes`` (words by ``size + 1``) holds letter numbers from 1, 0 where a word has ended;
    words have ``size`` or ``size + 1`` letters, ``queries`` are places of words with ``size``.
    """
    import numpy as np

    letters = int(codes.max()) + 1
    asked = codes[queries]
    here = letter_sets(codes[:, 0], letters)
    width = here.shape[1]
    exact = np.full((len(queries), width), ~np.uint64(0), np.uint64)
    replaced = np.zeros_like(exact)
    longer = np.zeros_like(exact)
    for i in range(size):
        ahead = letter_sets(codes[:, i + 1], letters)
        match, shifted = here[asked[:, i]], ahead[asked[:, i]]
        # an inserted letter moves the rest of the word one position on
        longer = (longer | exact) & shifted
        replaced = (replaced & match) | (exact & ~match)
        exact &= match
        here = ahead
    ends = as_words(np.stack([lengths == size, lengths == size + 1]))
    return (replaced & ends[0]) | ((longer | exact) & ends[1])


def near_in_bin(words: list[str], size: int, suffix, block, queries, known):
    """Places ``(query, word)`` of the near pairs that meet in a common block of this bin, each pair in one block only."""
    import numpy as np

    matrix = np.frombuffer("".join([w.ljust(size + 1, "\0") for w in words]).encode("utf-32-le"), np.uint32).reshape(len(words), size + 1)
    letters, codes = np.unique(np.append(matrix.ravel(), np.uint32(0)), return_inverse=True)
    codes = codes[:-1].reshape(matrix.shape)
    asks = np.flatnonzero(queries)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    _, member = np.unique(block, return_inverse=True)
    together = as_words((member[None, :] == np.arange(member.max() + 1)[:, None]) & known[None, :])
    hits = one_edit(codes, size, lengths, asks) & together[member[asks]]
    q, w = np.nonzero(np.unpackbits(hits.view(np.uint8), axis=1, bitorder="little", count=len(words)))
    q = asks[q]
    # words that share their first half meet in a block of first letters; others in one of last letters
    same_head = (matrix[q, : size // 2] == matrix[w, : size // 2]).all(axis=1)
    mine = same_head != suffix[q]
    return q[mine], w[mine]


def _search(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    def found(part):
        size = part.column("size")[0].as_py()
        columns = {c: part.column(c).to_numpy(zero_copy_only=False) for c in ("suffix", "block", "query", "known", "n")}
        words = part.column("word").to_pylist()
        q, w = near_in_bin(words, size, columns["suffix"], columns["block"], columns["query"], columns["known"])
        if not len(q):
            return
        # the longer word of a pair never asks
        back = np.fromiter((len(words[i]) > size for i in w), bool, len(w))
        one, two = np.concatenate([q, w[back]]), np.concatenate([w, q[back]])
        text = part.column("word")
        yield pa.RecordBatch.from_arrays([text.take(pa.array(one)), text.take(pa.array(two)), pa.array(columns["n"][two])], ["word", "near", "near_n"])

    def bins(table, last):
        """Parts of whole blocks of one size, and what may go on in the next batch."""
        size, block = table.column("size").to_numpy(), table.column("block").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (size[1:] != size[:-1])]))
        ends = np.append(starts[1:], len(block))
        at = 0
        for k in range(len(starts)):
            whole = last or k + 1 < len(starts)
            if not whole:
                break
            turn = k + 1 == len(starts) or size[starts[k + 1]] != size[at] or ends[k + 1] - at > BIN
            if turn:
                yield table.slice(at, ends[k] - at), None
                at = int(ends[k])
        yield None, table.slice(at)

    rest = None
    for batch in batches:
        one = pa.Table.from_batches([batch])
        rest = one if rest is None else pa.concat_tables([rest, one])
        if rest.num_rows < 4 * BIN:
            continue
        for part, left in bins(rest.combine_chunks(), False):
            if part is None:
                rest = left
            elif part.num_rows > 1:
                yield from found(part.combine_chunks().to_batches()[0])
    if rest is not None and rest.num_rows:
        for part, _ in bins(rest.combine_chunks(), True):
            if part is not None and part.num_rows > 1:
                yield from found(part.combine_chunks().to_batches()[0])


def near_words(words: DataFrame) -> DataFrame:
    """``(word, near, near_n)`` for all pairs of ``words (word, n)``, in both directions, that are one edit apart."""
    blocks = _blocks(words).repartition("size", "block").sortWithinPartitions("size", "block")
    return blocks.mapInArrow(_search, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for words with a form: forms are followed by doubling the step each round."""
    steps = materialise(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while steps.filter("moved").limit(1).count():
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        done = materialise(
            steps.join(ahead, "root", "left").select(
                "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
            )
        )
        discard(steps)
        steps = done
    return steps.select("word", "root")


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_every: int = 97, min_length: int = 5, min_count: int = 3, ratio: int = 2
) -> DataFrame:
    """One row per word: ``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root``.

    Words are runs of letters (A-Z lower-cased only); where ``drop_every`` divides the CRC-32 of
    ``<id>:<run>`` one letter of the run is left out (0: never).  A word's form is the most
    frequent of its near words (ties: smallest in code-point order) if it is at least ``ratio``
    times as frequent; the root follows forms to the end (frequencies grow, so there is one).
    Null and empty texts have no words, a null id counts as an empty one, repeated rows count each, an
    empty table gives an empty result.  Other columns of ``docs`` are not used.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their words")
    words = materialise(vocabulary(docs, id_col, text_col, drop_every, min_length, min_count))
    # the most frequent first, then code-point order
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near"))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best")
    large = -F.col("best.m") >= ratio * F.col("n")
    formed = materialise(
        joined.select("word", "n", "n_near", F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.m")).alias("form_n"))
    )
    roots = _roots(formed.filter(F.col("form").isNotNull()))
    out = formed.join(roots, "word", "left")
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
