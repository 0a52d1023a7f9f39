"""Language-model scores by a hidden Markov model.

Hidden states emit words and follow each other by learned transitions.  Baum-Welch training runs
over all training documents: each task computes the expected counts of its documents by the
scaled forward and backward recursions, Spark adds them up over the partitions, and the next
round reads the new estimates.  A text's score is its exact log likelihood by the scaled forward
recursion, summed over all state sequences.

Nothing that grows with the vocabulary passes the driver or is broadcast.  Tokens are numbered
within *shards* (the documents of a task, cut where their vocabulary or their tokens exceed a
bound), whose words meet the corpus-wide counts in one exchange.  Small shards are joined into
*groups* of bounded size, whose tokens become numbers of symbols, and groups into *parts*: as many as the
cluster has cores, or more where a part would have more than PART_GROUPS groups.  In each round a part's symbols
meet their emissions in one join, so what moves is the symbols of parts, each once whatever the number of its groups that
hold it; the tokens lie in a table that is bucketed by part and stay where they are, with the list of each group's symbols.

A word with OWN occurrences or more in the training documents has emissions of its own.  Rarer words share
those of a symbol, by their last two letters, and within it are told apart by their counts; words
seen once, and unknown words, share one symbol, in which the unknown word has the share that
Good's estimate gives it.  So the model gives probabilities that add up to one over the known
words and one unknown word, as the base score does.
"""

from __future__ import annotations

import math
import uuid
from array import array
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import give_back, named_id, tidy
from tidemark.session import delete, discard, materialise, settings, shared_folder

#: Hidden states and rounds of training.
STATES, ROUNDS = 8, 5
#: Occurrences from which on a word has emissions of its own.
OWN = 20
#: A state's emissions are mixed with those of all states as if it had emitted this many tokens more.
PRIOR = 50.0
#: Chance to stay in a state before training.
STAY = 0.9
#: A shard ends when it has as many words or tokens; tokens of a group, and of the documents that pass the recursions together.
SHARD_WORDS, SHARD_TOKENS, GROUP_TOKENS, BATCH_TOKENS = 500_000, 4_000_000, 4_000_000, 500_000
#: Groups of a part at most: their tokens are in a task's memory together.
PART_GROUPS = 4
#: Documents that a task cuts into words at a time, and that pass to it as a batch, which either side holds outside the heap of Spark's process.
PIECE_DOCS = 500
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(PIECE_DOCS)}
#: Tokens and words are the largest tables here: they are written with the denser codec.
DENSE = {"spark.sql.parquet.compression.codec": "zstd"}
#: Words of a shard that leave its task at a time.
PIECE_WORDS = 50_000
#: Longer words are named by a digest.
LONGEST = 48
#: The end of a text, the symbol of words seen once or never, and what other sums are filed under: no word holds a space.
END, UNKNOWN, SUMS = " ", "  ", "   "


class _Numbers(dict):
    """Numbers of words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _name(word: bytes) -> bytes:
    from hashlib import blake2b

    return word if len(word) <= LONGEST else b" " + blake2b(word, digest_size=16).hexdigest().encode()


def to_planes(numbers) -> bytes:
    """32-bit numbers as four planes of bytes, which compress well where numbers are small."""
    import numpy as np

    return np.frombuffer(numbers, np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(planes):
    import numpy as np

    return np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel()


def binaries(column) -> list:
    """Values of a binary column as arrays of bytes that share its memory."""
    import numpy as np

    out = []
    for chunk in filter(len, column.chunks):
        _, offsets, data = chunk.buffers()
        at = np.frombuffer(offsets, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        held = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        out += [held[a:b] for a, b in zip(at[:-1], at[1:])]
    return out


def packed(columns: list) -> bytes:
    """Arrow arrays of one length as a value of a binary column."""
    import pyarrow as pa

    batch, out = pa.RecordBatch.from_arrays(columns, [str(i) for i in range(len(columns))]), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def unpacked(value) -> list:
    """The arrays of a value that ``packed`` made, which share its memory."""
    import pyarrow as pa

    return pa.ipc.open_stream(value.as_buffer()).read_next_batch().columns


@tidy
def _shards(batches: Iterator) -> Iterator:
    """Documents as token numbers of their shard, and the shard's words with their training counts."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId() << 24
    numbers, counts, tokens = _Numbers(), np.zeros(0, np.int64), 0
    numbers[END.encode()]
    names = ["shard", "id", "held_out", "tokens", "word", "number", "n"]

    def counted(trained: list):
        """Counts of the shard's words with those of some more texts."""
        found = np.bincount(np.concatenate(trained), minlength=len(numbers)) if trained else np.zeros(len(numbers), np.int64)
        found[: len(counts)] += counts
        return found

    def words():
        listed = iter(numbers)
        for a in range(0, len(counts), PIECE_WORDS):
            n = counts[a : a + PIECE_WORDS]
            text = pa.array([_name(w) for w in islice(listed, len(n))], pa.binary()).cast(pa.string())
            empty = [pa.nulls(len(n), t) for t in (kind, pa.bool_(), pa.binary())]
            number = np.arange(a, a + len(n), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard)), *empty, text, pa.array(number), pa.array(n)], names)

    kind = None
    for batch in (whole.slice(a, PIECE_DOCS) for whole in batches for a in range(0, whole.num_rows, PIECE_DOCS)):
        kind = batch.column(0).type
        held = batch.column(1).to_pylist()
        texts, out, sizes, a, trained = batch.column(2).to_pylist(), [], [], 0, []
        for i, text in enumerate(texts):
            ids = array("I", map(numbers.__getitem__, (text or "").encode().lower().split()))
            ids.append(0)
            if not held[i]:
                trained.append(np.frombuffer(ids, np.uint32))
            out.append(to_planes(ids))
            sizes.append(len(ids))
            tokens += len(ids)
            if i + 1 == len(texts) or len(numbers) >= SHARD_WORDS or tokens >= SHARD_TOKENS:
                n = len(out)
                docs = [pa.array(np.full(n, shard)), batch.column(0).slice(a, n), batch.column(1).slice(a, n), pa.array(out, pa.binary())]
                yield pa.RecordBatch.from_arrays([*docs, pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.array(sizes, pa.int64())], names)
                counts = counted(trained)
                out, sizes, a, trained = [], [], i + 1, []
            if len(numbers) >= SHARD_WORDS or tokens >= SHARD_TOKENS:
                yield from words()
                shard, tokens, counts, numbers = shard + 1, 0, np.zeros(0, np.int64), _Numbers()
                numbers[END.encode()]
    if tokens:
        yield from words()


def _symbols(docs, words):
    """Documents of a group as numbers of symbols, with their sums over words; and a row with the list of the group's symbols and their totals."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    shard, number = words.column("shard").to_numpy(), words.column("number").to_numpy()
    order = np.lexsort((number, shard))
    shards, starts = np.unique(shard[order], return_index=True)
    c = words.column("c").to_numpy()[order]
    own_shard = words.column("first").to_numpy(zero_copy_only=False)[order]
    coded = pc.dictionary_encode(words.column("symbol").combine_chunks())
    names_, symbol = coded.dictionary, coded.indices.to_numpy()[order].astype(np.uint32)
    kinds = pc.and_(pc.starts_with(names_, UNKNOWN), pc.not_equal(names_, UNKNOWN)).to_numpy(zero_copy_only=False)
    unknown = symbol == (names_.index(UNKNOWN).as_py())
    # per word: known, seen once, logs for the base score and for the word within its symbol
    values = np.stack([c > 0, unknown & (c > 0), np.log10(c + 0.5), np.where(kinds[symbol], np.log10(np.maximum(c, 1)), 0.0)])
    m = len(names_)
    # a word counts where its first shard is
    mine = [np.bincount(symbol, own_shard * v, m).astype(np.int64) for v in (c, c > 0, c == 2)]
    del shard, number, order, own_shard, c, coded, unknown, kinds
    first = starts[np.searchsorted(shards, docs.column("shard").to_numpy())]
    planes = binaries(docs.column("tokens"))
    sums, tokens = np.zeros((4, len(planes))), []
    for i, held in enumerate(planes):
        at = first[i] + from_planes(held)
        sums[:, i] = values[:, at].sum(axis=1)
        tokens.append(to_planes(symbol[at]))
    n = len(planes)
    lengths = [len(p) // 4 for p in planes]
    del values, symbol, planes
    tokens = pa.array(tokens, pa.binary())
    cols = [
        *[docs.column(c).combine_chunks() for c in ("part", "group", "id", "held_out")],
        pa.array(lengths, pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)),
        pa.array(sums[2]), pa.array(sums[3]), tokens, pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()),
    ]
    names = ["part", "group", *KEPT, "tokens", "names", "totals"]
    listed = [packed([names_]), packed([pa.array(x) for x in mine])]
    listed = [*[x.slice(0, 1) for x in cols[:2]], *[pa.nulls(1, x.type) for x in cols[2:-2]], *[pa.array([x], pa.binary()) for x in listed]]
    out = [pa.Table.from_arrays(cols, names), pa.Table.from_arrays(listed, names)]
    del tokens
    give_back()
    return pa.concat_tables(out)


def _listed(groups):
    """Symbols of a part, each once, with their totals over its groups."""
    import numpy as np
    import pyarrow as pa

    names = pa.concat_arrays([unpacked(x)[0] for x in groups.column("names")]).dictionary_encode()
    at, m = names.indices.to_numpy(), len(names.dictionary)
    totals = zip(*[unpacked(x) for x in groups.column("totals")])
    sums = [np.bincount(at, pa.concat_arrays(x).to_numpy(), m).astype(np.int64) for x in totals]
    part = pa.array(np.full(m, groups.column("part")[0].as_py()))
    return pa.Table.from_arrays([part, names.dictionary, *map(pa.array, sums)], ["part", "symbol", "total", "types", "twice"])


def batches_by_length(lengths, limit: int) -> Iterator:
    """Places of texts, longest first, in batches of about ``limit`` tokens."""
    import numpy as np

    if not len(lengths):
        return
    order = np.argsort(-lengths, kind="stable")
    ends = np.cumsum(lengths[order]) // limit
    cuts = np.flatnonzero(np.diff(ends)) + 1
    yield from np.split(order, cuts)


def by_step(tokens: list):
    """Tokens of texts (longest first) step by step, and how many texts have each step."""
    import numpy as np

    lengths = np.array([len(t) for t in tokens])
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    starts = np.concatenate([[0], np.cumsum(active)])
    flat = np.empty(starts[-1], np.int64)
    for i, t in enumerate(tokens):
        flat[starts[: len(t)] + i] = t
    # plain numbers cut arrays faster than those of an array
    return flat, active.tolist(), starts.tolist()


def forward(shares, starts, active, moves, first):
    """Scaled forward recursion in place: ``shares`` (state by token, step by step) holds emissions, then the
    shares of states; returns the scale of every token."""
    import numpy as np

    scale = np.empty(shares.shape[1], shares.dtype)
    turned = np.ascontiguousarray(moves.T)
    before = None
    for here, n in zip(starts, active):
        now, total = shares[:, here : here + n], scale[here : here + n]
        if before is None:
            now *= first[:, None]
        else:
            now *= turned @ before[:, :n]
        np.add.reduce(now, axis=0, out=total)
        now /= total
        before = now
    return scale


def expected_counts(planes: list, emissions, moves, first):
    """Expected counts of (state, symbol), of moves and of first states, and the log likelihood; ``emissions`` are state by symbol."""
    import numpy as np

    states = len(first)
    counts = np.zeros(emissions.shape)
    pairs, begun, likelihood = np.zeros((states, states)), np.zeros(states), 0.0
    for places in batches_by_length(np.array([len(p) // 4 for p in planes], np.int64), BATCH_TOKENS):
        flat, active, starts = by_step([from_planes(planes[i]) for i in places])
        seen = np.take(emissions, flat, axis=1)
        shares = seen.copy()
        scale = forward(shares, starts, active, moves, first)
        likelihood += float(np.log(scale, dtype=np.float64).sum())
        seen /= scale
        after = np.ones((states, active[0]), shares.dtype)
        moved = np.zeros((states, states))
        for t in range(len(active) - 1, 0, -1):
            n, here, before = active[t], starts[t], starts[t - 1]
            ahead = seen[:, here : here + n]
            ahead *= after[:, :n]
            moved += shares[:, before : before + n] @ ahead.T
            shares[:, here : here + n] *= after[:, :n]
            after[:, :n] = moves @ ahead
        shares[:, : active[0]] *= after
        pairs += moved * moves
        begun += shares[:, : active[0]].sum(axis=1)
        for k in range(states):
            counts[k] += np.bincount(flat, shares[k], counts.shape[1])
    return counts, pairs, begun, likelihood


def _part_emissions(symbols, states: int):
    """Emissions of a part's symbols by state, in the order of their rows."""
    import numpy as np

    return np.ascontiguousarray(symbols.column("b").combine_chunks().flatten().to_numpy().reshape(-1, states).T)


def _by_group(docs, names) -> Iterator:
    """For each group of a part the rows of its documents, and where its symbols, in the order of their numbers, are in ``names``."""
    import numpy as np
    import pyarrow.compute as pc

    group, lists = docs.column("group").to_numpy(), pc.is_valid(docs.column("names")).to_numpy()
    for row in np.flatnonzero(lists):
        (listed,) = unpacked(docs.column("names")[row])
        yield np.flatnonzero((group == group[row]) & ~lists), pc.index_in(listed, value_set=names).to_numpy()


def _expect(states: int, moves, first):
    def run(docs, symbols):
        import numpy as np
        import pyarrow as pa

        emissions, names = _part_emissions(symbols, states), symbols.column("symbol").combine_chunks()
        a, f = np.array(moves, np.float32), np.array(first, np.float32)
        counts, sums = np.zeros(emissions.shape), np.zeros(states * (states + 1) + 1)
        planes = binaries(docs.column("tokens"))
        for rows, at in _by_group(docs, names):
            found, pairs, begun, likelihood = expected_counts([planes[i] for i in rows], emissions[:, at], a, f)
            for k in range(states):
                counts[k, at] += found[k]
            sums += [*pairs.ravel(), *begun, likelihood]
            del found
        at = np.flatnonzero(counts.any(axis=0))
        names = pa.concat_arrays([names.take(pa.array(at)), pa.array([f"{SUMS}{i}" for i in range(len(sums))], names.type)])
        values = np.zeros((len(names), states))
        for k in range(states):
            values[: len(at), k] = counts[k, at]
        values[len(at) :, 0] = sums
        del emissions, counts
        give_back()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1, dtype=np.int32) * states), pa.array(values.ravel()))
        return pa.Table.from_arrays([names, lists], ["symbol", "g"])

    return run


def _likelihood(states: int, moves, first):
    def run(docs, symbols):
        import numpy as np
        import pyarrow as pa

        emissions, names = _part_emissions(symbols, states), symbols.column("symbol").combine_chunks()
        a, f = np.array(moves), np.array(first)
        planes = binaries(docs.column("tokens"))
        score, scored = np.zeros(len(planes)), np.zeros(len(planes), bool)
        for rows, at in _by_group(docs, names):
            own = emissions[:, at].astype(np.float64)
            for places in batches_by_length(np.array([len(planes[i]) // 4 for i in rows], np.int64), BATCH_TOKENS // 2):
                places = rows[places]
                flat, active, starts = by_step([from_planes(planes[i]) for i in places])
                logs = np.log10(forward(np.take(own, flat, axis=1), starts, active, a, f))
                for t, n in enumerate(active):
                    score[places[:n]] += logs[starts[t] : starts[t] + n]
            scored[rows] = True
        del emissions, planes
        give_back()
        kept = [docs.column(c).combine_chunks() for c in KEPT]
        return pa.Table.from_arrays([*kept, pa.array(score)], [*KEPT, "states_log"]).filter(pa.array(scored))

    return run


KEPT = ["id", "held_out", "n_tokens", "n_known", "n_once", "base_log", "rare_log"]


class TokenTable:
    """Documents as numbers of symbols and lists of each group's symbols, bucketed by part, and the symbols of each part, bucketed and sorted by symbol."""

    def __init__(self, rows: DataFrame, spent: tuple[DataFrame, ...]):
        self.spark, self.written = rows.sparkSession, {}
        self.buckets = max(8, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        table = self._write(rows.write.bucketBy(self.buckets, "part"))
        self.docs = table.select("part", "group", *KEPT, "tokens", "names")
        discard(*spent)
        groups = table.filter(F.col("names").isNotNull()).select("part", "names", "totals").groupBy("part")
        listed = groups.applyInArrow(_listed, "part long, symbol string, total long, types long, twice long")
        self.symbols = self._write(listed.repartition(self.buckets, "symbol").write.bucketBy(self.buckets, "symbol").sortBy("symbol"))
        self.totals = self.symbols.groupBy("symbol").agg(*[F.sum(c).alias(c) for c in ("total", "types", "twice")])

    def _write(self, writer) -> DataFrame:
        name, path = f"hmm_{uuid.uuid4().hex}", shared_folder(self.spark, "hmm")
        with settings(self.spark, SMALL_BATCHES | DENSE):
            writer.option("path", path).saveAsTable(name)
        self.written[name] = path
        return self.spark.table(name)

    def drop(self) -> None:
        for name, path in self.written.items():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self.spark, path)


def _start(symbol: Column, k: int) -> Column:
    """Weight of a state for a symbol before training: unlike those of other states, always the same."""
    return 0.05 + F.pmod(F.xxhash64(symbol, F.lit(k)), F.lit(1_000_003)) / 1_000_003.0


def _emissions(counts: DataFrame, states: int) -> DataFrame:
    """``(symbol, b)``, ``b`` by state, from expected counts ``(symbol, g0, g1, ...)``.

    What a symbol of rare words emits is divided by its occurrences: times a word's count it is the word's.
    """
    counted = counts.agg(*[F.coalesce(F.sum(f"g{k}"), F.lit(0.0)) for k in range(states)]).first()
    everything = sum(counted) + 0.5
    seen = sum(F.col(f"g{k}") for k in range(states))
    # the unknown word is never seen in training; half an occurrence keeps it possible
    mixed = seen + F.when(F.col("symbol") == UNKNOWN, 0.5).otherwise(0.0)
    share = F.when(F.col("symbol").startswith(UNKNOWN) & (F.col("symbol") != UNKNOWN), seen).otherwise(1.0)
    b = [((F.col(f"g{k}") + PRIOR * mixed / everything) / (counted[k] + PRIOR) / share).cast("float") for k in range(states)]
    return counts.select("symbol", F.array(*b).alias("b"))


class HiddenMarkovModel:
    """Trained over a table of tokens; see the module text."""

    def __init__(self, table: TokenTable, id_type: str, states: int, rounds: int):
        self.table, self.id_type, self.states = table, id_type, states
        start = materialise(table.totals)
        here = F.col("symbol") == UNKNOWN
        sums = start.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in (F.col("total"), F.col("types"), F.when(here, F.col("types")), F.col("twice"))])
        self.train_tokens, self.types, self.once, self.twice = sums.first()
        rest = (1 - STAY) / states
        self.moves = [[STAY * (i == j) + rest for j in range(states)] for i in range(states)]
        self.first = [1 / states] * states
        weights = [_start(F.col("symbol"), k) for k in range(states)]
        self.written = materialise(start.select("symbol", *[(F.col("total") * w / sum(weights)).alias(f"g{k}") for k, w in enumerate(weights)]))
        self.counts = self.written
        discard(start)
        #: natural log likelihood of the training tokens' symbols, before each round
        self.likelihoods: list[float] = []
        for _ in range(rounds):
            self._round()

    def unseen(self) -> float:
        """Share of the unknown word in its symbol: words unseen take Good's estimate, the share of words
        seen once, and these that of words seen twice."""
        return (self.once + 1) / (self.once + 2 * self.twice + 2) if self.once else 1.0

    def _with_emissions(self) -> DataFrame:
        # a part may hold the unknown word alone, which no count names
        shared = self.table.symbols.select("part", "symbol").join(_emissions(self.counts, self.states), "symbol", "left")
        return shared.withColumn("b", F.coalesce("b", F.array(*[F.lit(1e-9).cast("float")] * self.states)))

    def _round(self) -> None:
        states = self.states
        trained = self.table.docs.filter(~F.coalesce("held_out", F.lit(False))).select("part", "group", "tokens", "names")
        parts = trained.groupBy("part").cogroup(self._with_emissions().groupBy("part"))
        found = parts.applyInArrow(_expect(states, self.moves, self.first), "symbol string, g array<double>")
        with settings(self.table.spark, SMALL_BATCHES):
            written = materialise(found.groupBy("symbol").agg(*[F.sum(F.col("g")[k]).alias(f"g{k}") for k in range(states)]))
        discard(self.written)
        self.written, self.counts = written, written.filter(~F.col("symbol").startswith(SUMS))
        sums = {r["symbol"]: r["g0"] for r in written.filter(F.col("symbol").startswith(SUMS)).select("symbol", "g0").collect()}
        total = [sums.get(f"{SUMS}{i}", 0.0) for i in range(states * (states + 1) + 1)]
        pairs = [[x + 0.1 for x in total[i * states : (i + 1) * states]] for i in range(states)]
        self.moves = [[x / sum(row) for x in row] for row in pairs]
        begun = [x + 0.1 for x in total[states * states : states * states + states]]
        self.first = [x / sum(begun) for x in begun]
        self.likelihoods.append(total[-1])

    def scores(self) -> DataFrame:
        """Every document of the token table: id, held_out, n_tokens, n_known, base_score, score."""
        parts = self.table.docs.groupBy("part").cogroup(self._with_emissions().groupBy("part"))
        schema = f"id {self.id_type}, held_out boolean, n_tokens long, n_known long, n_once long, base_log double, rare_log double, states_log double"
        found = parts.applyInArrow(_likelihood(self.states, self.moves, self.first), schema)
        once = math.log10((1 - self.unseen()) / self.once) if self.once else 0.0
        unknown = (F.col("n_tokens") - F.col("n_known")) * math.log10(self.unseen())
        return found.select(
            "id", "held_out", "n_tokens", "n_known",
            (F.col("base_log") - F.col("n_tokens") * math.log10(self.train_tokens + 0.5 * (self.types + 1))).alias("base_score"),
            (F.col("states_log") + F.col("rare_log") + F.col("n_once") * once + unknown).alias("score"),
        )


def train_hmm(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1, states: int = STATES, rounds: int = ROUNDS
) -> HiddenMarkovModel:
    """A model of the rows of ``docs`` that are not held out, over the token table of all rows; see ``hmm_scores``."""
    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == held_fold
    rows = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"shard long, id {id_type}, held_out boolean, tokens binary, word string, number int, n long"
    with settings(docs.sparkSession, SMALL_BATCHES | DENSE):
        cut = materialise(rows.mapInArrow(_shards, schema))
    texts, words = cut.filter(F.col("tokens").isNotNull()), cut.filter(F.col("word").isNotNull())

    # shards in their order, joined up to the size of a group, and groups up to that of a part: one row each
    sizes = texts.groupBy("shard").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    groups = materialise(sizes.select("shard", F.floor(F.coalesce(before, F.lit(0)) / GROUP_TOKENS).alias("group")))
    found = (groups.agg(F.max("group")).first()[0] or 0) + 1
    part = F.floor(F.col("group") / max(1, min(PART_GROUPS, found // docs.sparkSession.sparkContext.defaultParallelism)))

    # a word has a row in each shard that holds it
    holders = Window.partitionBy("word")
    counted = words.select("shard", "word", "number", F.sum("n").over(holders).alias("c"), (F.col("shard") == F.min("shard").over(holders)).alias("first"))
    own = (F.col("c") >= OWN) | ((F.col("word") == END) & (F.col("c") > 0))
    rare = F.concat(F.lit(UNKNOWN), F.substring("word", -2, 2))
    counted = counted.withColumn("symbol", F.when(own, F.col("word")).when(F.col("c") < 2, F.lit(UNKNOWN)).otherwise(rare)).drop("word")
    # columns of their own: both sides come from one table
    listed = counted.join(groups, "shard").select(*[F.col(c).alias(c) for c in ("group", "shard", "number", "symbol", "c", "first")])
    docs_ = texts.join(groups, "shard").select(F.col("group").alias("group"), part.alias("part"), "shard", "id", "held_out", "tokens")
    schema = (
        f"part long, group long, id {id_type}, held_out boolean, n_tokens long, n_known long, n_once long, base_log double, rare_log double, "
        "tokens binary, names binary, totals binary"
    )
    table = TokenTable(docs_.groupBy("group").cogroup(listed.groupBy("group")).applyInArrow(_symbols, schema), (cut, groups))
    model = HiddenMarkovModel(table, id_type, states, rounds)
    return model


def hmm_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1, states: int = STATES, rounds: int = ROUNDS
) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Tokens are the words of a text (A-Z lower-cased) and one end.  Learns from rows whose CRC-32 of the id
    as text leaves another remainder than ``held_fold`` by ``folds``.  ``base_score`` is the log10
    probability by smoothed word counts, ``score`` that by the model.  Null and empty texts have
    the end only; a null id counts as an empty one; repeated rows are scored alike; an empty table gives an
    empty result, and without training rows every word is unknown.  Other columns are not used; a column
    of the result that is named like the id gets another name.
    """
    model = train_hmm(docs, id_col, text_col, folds, held_fold, states, rounds)
    with settings(docs.sparkSession, SMALL_BATCHES):
        out = materialise(model.scores())
    model.table.drop()
    discard(model.written)
    out = out.select("id", "held_out", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
    return named_id(out, id_col)
