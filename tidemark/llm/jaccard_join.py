"""N-gram Jaccard join with prefix trees.

Every text is its set of distinct word n-grams.  Sets are stored in one global order: n-grams that
occur in more documents come later (by a sketch of fixed size that counts all documents), ties by
hash.  Two sets that reach the threshold share an n-gram among the first ``n - ceil(t n) + 1`` of
each (prefix filter), so only these are exchanged.

1. Texts with equal sets form a class; from here on a class counts once.
2. Prefix n-grams are exchanged; those that no other class of similar length has are dropped, and
   those whose place in the set leaves too few elements after it for any class that has them (the first
   n-gram that a similar pair shares passes this on both sides).
3. Each class joins the cluster of one class that it shares most n-grams with.  Pairs that share an
   n-gram across clusters are found as (class, cluster).
   Histograms of the sets' hashes, about 32 times smaller than the sets, bound what a pair can have in
   common; sets without a partner that the bounds allow go no further.
4. In a task, a block of a cluster is a prefix tree of its ordered sets.  Each other set walks the
   tree: what it has in common with a path is counted once for all sets below, and a subtree is
   left as soon as the elements that remain on either side cannot reach the threshold.
5. Links are merged to connected components.

A cluster larger than a block is cut into blocks.  Members linked to its centre (directly or not)
are one component then, so only the other members meet the other blocks.  Nothing is capped: every
pair that reaches the threshold is linked or known to be connected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import named_id, process_memo, row_keys, slices, text_bytes, tidy
from tidemark.llm.components import connected_components
from tidemark.operators.support import attach
from tidemark.session import collect_garbage, discard, materialise

#: Slots of the sketch that orders the n-grams, and of the set that says whose n-grams are needed.
SLOTS, NEEDED = 1 << 18, 1 << 22
#: Prefix rows of one n-gram that may meet in one window, about.
MEET = 2000
#: Members and n-grams of one block, about.
BLOCK_SETS, BLOCK_GRAMS = 256, 1_000_000
#: Bytes of text handled at a time, and sets remembered by a task.
HELD, MEMORY = 500_000, 400_000
#: Bytes of a word that are hashed by their place; longer words are hashed as a whole.
LONGEST = 64
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Its powers multiply the words of an n-gram by position; they have no small common relations.
GOLDEN = 0x9E3779B97F4A7C15


def _tables():
    """A random number for each byte at each place of a word (equal for A-Z and a-z), and which bytes are white space."""
    import numpy as np

    memo = process_memo("shingles")
    if not memo:
        numbers = np.random.default_rng(GOLDEN).integers(0, 1 << 64, (LONGEST, 256), np.uint64)
        numbers[:, 65:91] = numbers[:, 97:123]
        space = np.zeros(256, bool)
        space[[0x20, *range(0x09, 0x0E)]] = True
        memo["of"] = numbers.ravel(), space
    return memo["of"]


def word_hashes(data, starts):
    """64-bit hashes of the words of all texts, and where the words of each text begin: ``starts`` are the
    texts' first bytes in ``data``, and its end.

    A word's hash is the sum of its bytes' numbers by place, so equal hashes of different words have a chance of 2**-64.
    """
    import numpy as np
    import xxhash

    numbers, space = _tables()
    inside = ~space[data]
    opens = np.ones(len(data), bool)
    opens[1:] = ~inside[:-1]
    opens[starts[:-1][starts[:-1] < len(data)]] = True  # texts lie next to each other
    opens &= inside
    begins = np.flatnonzero(opens)
    edges = np.searchsorted(begins, starts)
    if not len(begins):
        return np.zeros(0, np.uint64), edges
    held, first = data[inside], np.flatnonzero(opens[inside])
    lengths = np.diff(first, append=len(held))
    place = np.arange(len(held), dtype=np.int32) - np.repeat(first.astype(np.int32), lengths)
    np.minimum(place, LONGEST - 1, out=place)
    place <<= 8
    place |= held
    hashes = np.add.reduceat(numbers[place], first)
    for i in np.flatnonzero(lengths > LONGEST).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(held[first[i] : first[i] + lengths[i]].tobytes().translate(LOWER))
    return hashes, edges


def shingles(data, starts, words: int) -> list:
    """Per text, the sorted distinct 64-bit hashes of its word n-grams; a shorter text is one n-gram."""
    import numpy as np
    import xxhash

    h, edges = word_hashes(data, starts)
    last = max(len(h) - words + 1, 0)
    grams = np.zeros(last, np.uint64)
    for k in range(words):
        grams += h[k : k + last] * np.uint64(pow(GOLDEN, k + 1, 1 << 64))
    grams ^= grams >> np.uint64(31)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    grams ^= grams >> np.uint64(29)
    spans = list(zip(edges[:-1].tolist(), (edges[1:] - words + 1).tolist()))
    for a, b in spans:
        if a < b:
            grams[a:b].sort()  # n-grams across texts lie between these ranges
    differs = np.ones(last, bool)
    differs[1:] = grams[1:] != grams[:-1]
    sets = []
    for i, (a, b) in enumerate(spans):
        if a < b:
            kept = differs[a:b]
            kept[0] = True
            sets.append(grams[a:b] if kept.all() else grams[a:b][kept])
        elif a < b + words - 1:
            found = data[starts[i] : starts[i + 1]].tobytes().translate(LOWER).split()  # splits bytes at exactly the six white-space characters
            sets.append(np.array([xxhash.xxh3_64_intdigest(b"\n" + b" ".join(found))], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signature(grams) -> tuple[int, int]:
    """96 bits of hash that name a set."""
    raw = hashlib.blake2b(grams.tobytes(), digest_size=12).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little")


def histogram(grams) -> bytes:
    """How many elements fall in each of about ``n / 2`` buckets of the hash; empty if a count needs more than a byte."""
    import numpy as np

    size = max(16, 1 << (len(grams) // 2).bit_length())
    counts = np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


class Histograms:
    """Histograms of a block; sets have at most the sum of bucket-wise minima in common."""

    def __init__(self, rows: list):
        import numpy as np

        by_size: dict[int, list[int]] = {}
        for i, h in enumerate(rows):
            by_size.setdefault(len(h), []).append(i)
        self.groups = [(np.array(at), np.array([rows[i] for i in at], np.int64)) for size, at in by_size.items() if size]
        self.unknown = np.array(by_size.get(0, []), np.int64)
        self.n = len(rows)

    def bounds(self, probe):
        """The most that ``probe`` can have in common with each set."""
        import numpy as np

        out = np.full(self.n, 1 << 60)
        if len(probe):
            for at, rows in self.groups:
                size = min(rows.shape[1], len(probe))  # the larger one is folded to the smaller
                a = rows.reshape(len(rows), -1, size).sum(axis=1)
                b = probe.astype(np.int64).reshape(-1, size).sum(axis=0)
                out[at] = np.minimum(a, b).sum(axis=1)
        return out


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def longest_partner(n, place, percent: int):
    """The most elements that a set can have which is similar to one of ``n``, if the first that both have is at
    ``place`` of the latter: they share ``n - place`` at most."""
    return ((100 + percent) * (n - place) - percent * n) // percent


def _sets_of(batches: Iterator, words: int) -> Iterator:
    """Slices of batches, of bounded size, and the sets of their texts."""
    for batch in batches:
        for part in slices(batch, HELD):
            yield part, shingles(*text_bytes(part.column(0)), words)


def _describe(words: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        counts, id_type = np.zeros(SLOTS, np.int64), None
        names = ["kind", "id", "k1", "k2", "n", "a", "b", "hist"]
        for part, sets in _sets_of(batches, words):
            id_type = part.column(1).type
            counts += np.bincount(np.concatenate(sets).view(np.uint64) >> np.uint64(46), minlength=SLOTS) if sets else 0
            sigs = [signature(s) for s in sets]
            own = [part.column(i) for i in (1, 2, 3)]
            cols = [[0] * len(sets), [len(s) for s in sets], [s[0] for s in sigs], [s[1] for s in sigs]]
            kind, n, a, b = (pa.array(c, pa.int64()) for c in cols)
            hist = pa.array([histogram(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([kind, *own, n, a, b, hist], names)
        if id_type is not None:
            full = np.flatnonzero(counts)
            k = len(full)
            one, none = pa.array(np.ones(k, np.int64)), pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays([one, pa.nulls(k, id_type), none, none, pa.array(counts[full]), pa.array(full), none, pa.nulls(k, pa.binary())], names)

    return tidy(run)


def ordered(grams, weights):
    """The set in global order: 16 bits of weight before 48 bits of hash, ascending."""
    import numpy as np

    return np.sort((weights[(grams >> np.uint64(46)).astype(np.int64)] << np.uint64(48)) | (grams & np.uint64((1 << 48) - 1)))


def _prefixes(words: int, percent: int, shared):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        weights = shared.value
        usual = np.exp2(np.median(weights.astype(np.float64)) / 2048)  # what a slot counts without an n-gram of many documents
        seen: set[tuple[int, int]] = set()  # copies within the partition need not be sent again
        for _, sets in _sets_of(batches, words):
            tokens, cols = [], []
            for grams in sets:
                if not len(grams):
                    continue
                sig = signature(grams)
                if sig in seen:
                    continue
                if len(seen) > MEMORY:
                    seen.clear()
                seen.add(sig)
                p = prefix_length(len(grams), percent)
                tokens.append(ordered(grams, weights)[:p])
                cols.append((sig[0], sig[1], len(grams), p))
            if not tokens:
                continue
            a, b, n, p = (np.array(c, np.int64) for c in zip(*cols))
            token = np.concatenate(tokens)
            place = np.arange(len(token)) - np.repeat(np.cumsum(p) - p, p)
            limit = longest_partner(np.repeat(n, p), place, percent)
            # n-grams of many documents are dealt out by class, so that no window holds them all
            often = np.exp2((token >> np.uint64(48)).astype(np.float64) / 2048) - usual
            parts = np.maximum(1, np.ceil(often / MEET)).astype(np.int64)
            salt = np.repeat(a & 0x7FFFFFFF, p) % parts
            salt[parts > 1] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(token.view(np.int64)), pa.array(np.repeat(a, p)), pa.array(np.repeat(b << 32 | n, p)),
                    pa.array(limit.astype(np.int32)), pa.array(salt.astype(np.int32)),
                ],
                ["token", "a", "bn", "limit", "salt"],
            )

    return tidy(run)


def _sets(words: int, shared):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        weights, needed = shared.value
        seen: set[tuple[int, int]] = set()
        for _, sets in _sets_of(batches, words):
            rows = []
            for grams in sets:
                if not len(grams):
                    continue
                sig = signature(grams)
                slot = sig[0] % NEEDED
                if sig in seen or not needed[slot >> 6] >> np.uint64(slot & 63) & np.uint64(1):
                    continue
                if len(seen) > MEMORY:
                    seen.clear()
                seen.add(sig)
                rows.append((*sig, ordered(grams, weights).tobytes()))
            if rows:
                a, b, s = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.binary())], ["a", "b", "grams"])

    return tidy(run)


class PrefixTree:
    """Ordered sets as a tree of segments, walked level by level.

    A segment is a run of elements that the sets below have in common; long runs are cut, so
    that a walk can be left inside them.
    """

    PIECE = 24

    def __init__(self, sets: list):
        import numpy as np

        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in order]
        self.member = order
        parent, level, begin, size, owner, ends = [], [], [], [], [], []
        stack: list[tuple[int, int]] = []  # (depth at the end of the node, node)
        last_end: list[int] = []
        for d, s in enumerate(self.sets):
            common = 0
            if d:
                before = self.sets[d - 1]
                m = min(len(before), len(s))
                differ = np.flatnonzero(before[:m] != s[:m])
                common = int(differ[0]) if len(differ) else m
            while stack and stack[-1][0] > common:
                depth, node = stack.pop()
                top = stack[-1][0] if stack else 0
                if top < common:  # split: the shared upper part becomes a node of its own
                    parent.append(parent[node])
                    level.append(0)
                    begin.append(top)
                    size.append(common - top)
                    owner.append(owner[node])
                    ends.append(-1)
                    upper = len(parent) - 1
                    parent[node], begin[node], size[node] = upper, common, depth - common
                    stack.append((common, upper))
            top, node = stack[-1] if stack else (0, -1)
            if top < len(s):
                at, up = top, node
                while at < len(s):
                    piece = min(max(self.PIECE, at // 3), len(s) - at)
                    parent.append(up)
                    level.append(0)
                    begin.append(at)
                    size.append(piece)
                    owner.append(d)
                    ends.append(-1)
                    up, at = len(parent) - 1, at + piece
                    stack.append((at, up))
            last_end.append(stack[-1][1])
        n = len(parent)
        self.parent = np.array(parent, np.int64)
        self.depth = np.array(begin, np.int64) + np.array(size, np.int64)
        children: list[list[int]] = [[] for _ in range(n + 1)]
        for i, p in enumerate(parent):
            children[p].append(i)
        self.levels, front = [], children[-1]
        while front:
            self.levels.append(np.array(front))
            front = [c for i in front for c in children[i]]
        lengths = np.array([len(s) for s in self.sets], np.int64)
        self.shortest, self.longest = np.full(n, 1 << 62), np.zeros(n, np.int64)
        for d, node in enumerate(last_end):
            self.shortest[node] = min(self.shortest[node], lengths[d])
            self.longest[node] = max(self.longest[node], lengths[d])
        for nodes in reversed(self.levels[1:]):
            np.minimum.at(self.shortest, self.parent[nodes], self.shortest[nodes])
            np.maximum.at(self.longest, self.parent[nodes], self.longest[nodes])
        pieces = [self.sets[o][b : b + k] for o, b, k in zip(owner, begin, size)]
        flat = np.concatenate(pieces)
        self.size = np.array(size, np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.last = flat[self.first + self.size - 1]
        self.words, self.flat = np.unique(flat, return_inverse=True)
        self.end_node = np.array(last_end)
        self.lengths = lengths

    def links(self, probe, percent: int):
        """Members (numbers in the given order) whose Jaccard similarity to ``probe`` reaches the threshold."""
        import numpy as np

        m = len(probe)
        at = np.minimum(np.searchsorted(self.words, probe), len(self.words) - 1)
        has = np.zeros(len(self.words), np.int64)
        has[at[self.words[at] == probe]] = 1
        common = np.full(len(self.parent) + 1, -1, np.int64)  # the last entry is the root's
        common[-1] = 0
        for nodes in self.levels:
            nodes = nodes[common[self.parent[nodes]] >= 0]
            if not len(nodes):
                break
            size = self.size[nodes]
            start = np.cumsum(size) - size
            places = np.repeat(self.first[nodes] - start, size) + np.arange(int(size.sum()))
            own = common[self.parent[nodes]] + np.add.reduceat(has[self.flat[places]], start)
            # the best that a set below can reach, given how many elements remain on either side
            rest = m - np.searchsorted(probe, self.last[nodes], side="right")
            best = np.clip(self.depth[nodes] + rest, self.shortest[nodes], self.longest[nodes])
            bound = own + np.minimum(best - self.depth[nodes], rest)
            alive = (100 + percent) * bound >= percent * (m + best)
            common[nodes[alive]] = own[alive]
        got = common[self.end_node]
        hit = np.flatnonzero((got >= 0) & ((100 + percent) * got >= percent * (m + self.lengths)))
        return [self.member[i] for i in hit]


def _join(percent: int):
    """Links within blocks: rows come sorted by block, members before probes."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        key, last, tree, names, sets, parent, out = None, None, None, [], [], [], []

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        def grown() -> None:
            """All members have come: plant the tree; an uncut cluster is joined with itself."""
            nonlocal tree
            if tree is None and sets:
                tree = PrefixTree(sets)
                if key[-1]:
                    for i, s in enumerate(sets):
                        for j in tree.links(s, percent):
                            if root(i) != root(j):
                                parent[root(j)] = root(i)
                                out.append((*names[i], *names[j]))

        def flushed():
            nonlocal out
            cols = list(zip(*out)) if out else [[]] * 4
            done = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a1", "b1", "a2", "b2"])
            out = []
            return done

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns - 1)]
            grams = batch.column(batch.num_columns - 1)
            for i, (ca, cb, chunk, itself, probe, a, b) in enumerate(zip(*cols)):
                if (ca, cb, chunk, itself) != key:
                    grown()
                    key, last, tree, names, sets, parent = (ca, cb, chunk, itself), None, None, [], [], []
                if last == (probe, a, b):
                    continue  # a copy from another partition
                last = (probe, a, b)
                s = np.frombuffer(grams[i].as_buffer(), np.uint64)
                if not probe:
                    parent.append(len(sets))
                    names.append((a, b))
                    sets.append(s.copy())
                    continue
                grown()
                if tree is None:
                    continue
                touched = set()
                for j in tree.links(s, percent):
                    if names[j] != (a, b) and root(j) not in touched:
                        touched.add(root(j))
                        out.append((a, b, *names[j]))
            if len(out) > 50_000:
                yield flushed()
        grown()
        yield flushed()

    return tidy(run)


def _node(a: str, b: str) -> Column:
    return F.struct(F.col(a).alias("a"), F.col(b).alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of ``docs``: id, key ``(k1, k2)`` of the row, ``n_shingles``, ``component_id``.

    ``component_id`` is the smallest id reachable by links of at least ``percent`` per cent
    Jaccard similarity.  A text with fewer than ``words`` words is one n-gram; a text without
    words (also null) has none and is linked with nothing.  A null id never names a component
    that has another id; repeated rows have equal sets and so share a component.  An empty table
    gives an empty result; other columns are not used.
    """
    spark = docs.sparkSession
    collect_garbage(spark)  # what earlier steps left adds to what the exchanges below need
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    kind = rows.schema["id"].dataType.simpleString()
    one, two = row_keys(rows, "id", "text")
    keyed = rows.withColumns({"k1": one, "k2": two})
    described = materialise(keyed.mapInArrow(_describe(words), f"kind long, id {kind}, k1 long, k2 long, n long, a long, b long, hist binary"))
    texts = described.filter("kind = 0").drop("kind", "hist")
    shared = spark.sparkContext.broadcast(_weights(described))

    links = _links(rows, described.filter("kind = 0 AND n > 0").select("a", "b", "n", "hist"), words, percent, shared)
    labels = connected_components(links.select(_node("a1", "b1").alias("u"), _node("a2", "b2").alias("v")))
    labels = labels.select(F.col("node.a").alias("a"), F.col("node.b").alias("b"), "label")
    classes = texts.filter("n > 0").groupBy("a", "b").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size"))
    classes = materialise(classes.join(labels, ["a", "b"], "left").filter("size > 1 OR label IS NOT NULL").withColumn("label", F.coalesce("label", _node("a", "b"))))
    named = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = classes.join(named, "label").select("a", "b", "component_id", F.lit(True).alias("known"))
    out = texts.join(classes, ["a", "b"], "left")
    single = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("id"))
    return named_id(out.select("id", "k1", "k2", F.col("n").alias("n_shingles"), single.alias("component_id")), id_col)


def _weights(described: DataFrame):
    """Place in the global order by sketch slot: at most SLOTS rows come to the driver."""
    import numpy as np

    found = described.filter("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[found["a"].to_numpy()] = found["n"].to_numpy()
    return np.minimum(2048 * np.log2(counts + 1.0), 65535).astype(np.uint64)


def _meetings(prefixes: DataFrame, percent: int) -> DataFrame:
    """``(token, span, a, b, n, centre)``: n-grams that classes of similar length have in common, once for each class.

    Rows of an n-gram meet in one exchange; what is counted, dropped and chosen follows there.  Only n-grams of
    very many documents, which are dealt out, need another one.
    """
    here = Window.partitionBy("token", "salt")
    met = prefixes.withColumn("met", F.count(F.lit(1)).over(here)).filter("met > 1 OR salt > 0").drop("met").distinct()
    met = met.select("token", "salt", "a", F.shiftrightunsigned("bn", 32).alias("b"), F.col("bn").bitwiseAND(F.lit(0xFFFFFFFF)).alias("n"), "limit")

    # similar lengths fall into the same or neighbouring ranges; a class stands in its own, and in the next if it can have a partner there
    def span(n: str) -> Column:
        return F.floor(F.log(n) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")

    own = span("n")
    spans = F.when(span("limit") > own, F.array(own, own + 1)).otherwise(F.array(own))
    ranged = met.withColumn("span", F.explode(spans))
    group = Window.partitionBy("token", "salt", "span")
    ranged = ranged.withColumns({"least": F.min("n").over(group), "most": F.max("limit").over(group)}).filter("salt > 0 OR least <= limit AND n <= most").drop("least", "most")
    ranged = ranged.withColumns({"centre": F.min(F.struct("a", "b")).over(group), "size": F.count(F.lit(1)).over(group)}).filter("salt > 0 OR size > 1").drop("size")
    ranged = materialise(ranged)
    collect_garbage(prefixes.sparkSession)
    # n-grams that were dealt out: over all parts
    common = ranged.filter("salt > 0").drop("centre")
    groups = common.groupBy("token", "span").agg(
        F.min("n").alias("least"), F.max("limit").alias("most"), F.min(F.struct("a", "b")).alias("centre"), F.count(F.lit(1)).alias("size")
    )
    common = common.join(groups.filter("size > 1"), ["token", "span"]).filter("least <= limit AND n <= most")
    columns = ["token", "span", "a", "b", "n", "centre"]
    found = materialise(ranged.filter("salt = 0").select(columns).unionByName(common.select(columns)))
    discard(ranged)
    return found


def _links(rows: DataFrame, hists: DataFrame, words: int, percent: int, shared) -> DataFrame:
    """Links ``(a1, b1, a2, b2)`` that connect all classes that similar pairs connect."""
    spark = rows.sparkSession
    texts = rows.select("text")
    shared_rows = _meetings(texts.mapInArrow(_prefixes(words, percent, shared), "token long, a long, bn long, limit int, salt int"), percent)
    # each class joins the cluster whose centre it shares most n-grams with; all rows of a class meet once
    votes = F.count(F.lit(1)).over(Window.partitionBy("a", "b", "centre"))
    cluster = F.max(F.struct("votes", "centre")).over(Window.partitionBy("a", "b"))["centre"]
    spread = shared_rows.repartition("a", "b").withColumn("votes", votes).withColumn("cluster", cluster)
    spread = materialise(spread.select("token", "span", "a", "b", "n", "cluster"))
    discard(shared_rows)
    chosen = materialise(spread.select("a", "b", "n", "cluster").distinct())
    sizes = chosen.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("grams"))
    chunks = F.greatest(F.ceil(F.col("members") / BLOCK_SETS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    sizes = materialise(sizes.select("cluster", "members", chunks.alias("chunks")))
    placed = attach(chosen, sizes, "cluster").withColumn("chunk", F.pmod(F.xxhash64("a", "b"), F.col("chunks")).cast("int"))
    placed = materialise(placed)
    # n-grams shared by several clusters: the class of the smaller cluster looks into the larger
    together = Window.partitionBy("token", "span")
    several = spread.select("token", "span", "a", "b", "cluster").withColumn("low", F.min("cluster").over(together)).withColumn("high", F.max("cluster").over(together))
    several = materialise(several.filter("low != high").select("token", "span", "a", "b", "cluster"))
    discard(spread)
    mixed = several.join(sizes.select("cluster", "members"), "cluster")
    there = mixed.select("token", "span", F.col("cluster").alias("other"), F.col("members").alias("other_members")).distinct()
    crossing = mixed.join(there, ["token", "span"]).filter(
        F.struct("members", "cluster") < F.struct(F.col("other_members").alias("members"), F.col("other").alias("cluster"))
    )
    crossing = materialise(crossing.select("a", "b", F.col("other").alias("cluster")).distinct())
    discard(several, chosen)
    # a class alone in its cluster, into which no other looks, has nothing to be compared with
    looked_into = materialise(crossing.select("cluster").distinct())
    placed = placed.filter("members > 1").unionByName(placed.filter("members = 1").join(looked_into, "cluster", "left_semi"))

    found = []
    members = placed.select("cluster", "chunk", (F.col("chunks") == 1).alias("itself"), F.lit(False).alias("probe"), "a", "b")
    centres = placed.select("cluster", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "chunks").distinct()
    probes = crossing.join(sizes.select("cluster", "chunks"), "cluster").select(
        "cluster", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), (F.col("chunks") == 1).alias("itself"), "a", "b"
    )
    large = placed.filter("chunks > 1")
    if not large.isEmpty():
        # first each block of a large cluster by itself and with the centre ...
        own = large.select("cluster", "chunk", F.lit(True).alias("itself"), F.lit(False).alias("probe"), "a", "b")
        centre = centres.filter("chunks > 1").select("cluster", "chunk", F.lit(True).alias("itself"), F.lit(True).alias("probe"), F.col("cluster.a").alias("a"), F.col("cluster.b").alias("b"))
        first = materialise(_blocks(own.unionByName(centre), texts, hists, words, percent, shared))
        found.append(first)
        # ... then those that are not connected with the centre, in the other blocks
        labels = materialise(connected_components(first.select(_node("a1", "b1").alias("u"), _node("a2", "b2").alias("v"))))
        labelled = large.withColumn("node", _node("a", "b")).join(labels, "node", "left")
        centre_label = labels.select(F.col("node").alias("cluster"), F.col("label").alias("centre_label"))
        labelled = labelled.join(centre_label, "cluster", "left")
        apart = labelled.filter(~F.coalesce(F.col("label"), F.col("node")).eqNullSafe(F.coalesce(F.col("centre_label"), F.col("cluster"))))
        apart = apart.select("cluster", F.col("chunk").alias("home"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "a", "b")
        probes = probes.unionByName(apart.filter("chunk != home").select("cluster", "chunk", F.lit(False).alias("itself"), "a", "b"))
    second = _blocks(members.unionByName(probes.distinct().withColumn("probe", F.lit(True))), texts, hists, words, percent, shared)
    found.append(materialise(second))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _thin(percent: int):
    """Rows of blocks that have a partner in their block whose bound reaches the threshold."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        key, last, members, sizes, hists, found, alive, out = None, None, [], [], [], None, None, []

        def possible(n: int, hist):
            return (100 + percent) * np.minimum(found.bounds(hist), np.minimum(lengths(), n)) >= percent * (lengths() + n)

        def lengths():
            return np.array(sizes, np.int64)

        def grown() -> None:
            nonlocal found, alive
            if found is None and members:
                found, alive = Histograms(hists), np.zeros(len(members), bool)
                if key[-1]:
                    for i, hist in enumerate(hists):
                        partners = possible(sizes[i], hist)
                        partners[i] = False
                        alive |= partners

        def ended() -> None:
            grown()
            if members:
                out.extend((*key, False, *m) for m, a in zip(members, alive) if a)

        def flushed():
            nonlocal out
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64())
            cols = list(zip(*out)) if out else [[]] * len(kinds)
            done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["ca", "cb", "chunk", "itself", "probe", "a", "b"])
            out = []
            return done

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(8)]
            raw = batch.column(8)
            for i, (ca, cb, chunk, itself, probe, a, b, n) in enumerate(zip(*cols)):
                if (ca, cb, chunk, itself) != key:
                    ended()
                    key, last, members, sizes, hists, found, alive = (ca, cb, chunk, itself), None, [], [], [], None, None
                if last == (probe, a, b):
                    continue  # a copy of the class
                last = (probe, a, b)
                hist = np.frombuffer(raw[i].as_buffer(), np.uint8)
                if not probe:
                    members.append((a, b))
                    sizes.append(n)
                    hists.append(hist.copy())
                    continue
                grown()
                if found is None:
                    continue
                partners = possible(n, hist)
                for j in np.flatnonzero(partners):
                    if members[j] == (a, b):
                        partners[j] = False
                if partners.any():
                    alive |= partners
                    out.append((*key, True, a, b))
            if len(out) > 50_000:
                yield flushed()
        ended()
        yield flushed()

    return tidy(run)


def _thinned(tasks: DataFrame, hists: DataFrame, percent: int) -> DataFrame:
    rows = tasks.join(hists, ["a", "b"]).select("cluster.a", "cluster.b", "chunk", "itself", "probe", F.col("a").alias("xa"), F.col("b").alias("xb"), "n", "hist")
    rows = rows.toDF("ca", "cb", "chunk", "itself", "probe", "a", "b", "n", "hist")
    dealt = rows.repartition("ca", "cb", "chunk").sortWithinPartitions("ca", "cb", "chunk", "itself", "probe", "a", "b")
    out = dealt.mapInArrow(_thin(percent), "ca long, cb long, chunk int, itself boolean, probe boolean, a long, b long")
    return out.select(_node("ca", "cb").alias("cluster"), "chunk", "itself", "probe", "a", "b")


def _blocks(tasks: DataFrame, texts: DataFrame, hists: DataFrame, words: int, percent: int, shared) -> DataFrame:
    """Walk the probes of each block through the tree of its members.

    The sets are made again from the texts, only for classes that stand in ``tasks``.  Copies of
    a class in several partitions send the same set; a block drops them when they arrive.
    """
    spark = tasks.sparkSession
    tasks = materialise(_thinned(tasks, hists, percent))
    slot = F.expr(f"pmod(a, {NEEDED})")
    bits = tasks.select(F.floor(slot / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(pmod(a, {NEEDED}), 64) as int))").alias("bit"))
    bits = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    needed = spark.sparkContext.broadcast((shared.value, _bitmap(bits)))
    sets = texts.mapInArrow(_sets(words, needed), "a long, b long, grams binary")
    rows = tasks.join(sets, ["a", "b"]).select("cluster.a", "cluster.b", "chunk", "itself", "probe", F.col("a").alias("xa"), F.col("b").alias("xb"), "grams")
    rows = rows.toDF("ca", "cb", "chunk", "itself", "probe", "a", "b", "grams")
    dealt = rows.repartition("ca", "cb", "chunk").sortWithinPartitions("ca", "cb", "chunk", "itself", "probe", "a", "b")
    return dealt.mapInArrow(_join(percent), "a1 long, b1 long, a2 long, b2 long")


def _bitmap(found):
    import numpy as np

    bits = np.zeros(NEEDED // 64, np.uint64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bits
