"""N-best SentencePiece segmentation: forward Viterbi, backward A-star.

The lattice of a text has an edge for every piece of the model that matches, weighted by the
piece's score in the model file; a character that no piece has is spelled in bytes.  A forward
pass gives the best score from the beginning to every position.  These are exact heuristics for
a search from the end: A-star leaves its queue in the order of whole-text scores, so the first N
complete paths are the N best segmentations.

A position that no piece spans cuts the lattice: before a run of spaces, and between characters
of groups that no piece joins.  Between cuts lie short parts that repeat.  A forward pass over a
part gives its best segmentation and the loss of its second best; both are remembered.  The N best
of a text use at most N - 1 parts that are not segmented best, and these are among the N - 1 parts
that lose least by it.  Only these are searched backwards, and their combinations in the same
way, on the lattice of parts.
"""

from __future__ import annotations

import heapq
import re
from array import array
from bisect import insort
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_bytes, process_memo

SPACE = "▁"
#: A spelled character costs this much more than the worst piece (fixed value of the format).
UNKNOWN_PENALTY = 10
#: Parts remembered by one Python worker, and of these searched backwards; characters of text handled at a time.
MEMORY, SEARCHED, HELD = 500_000, 20_000, 1_000_000
LOWEST = float("-inf")


class _Parts(dict):
    """Numbers of parts; a new one is segmented when it is asked for."""

    def __init__(self, lattice: PieceLattice):
        self.lattice = lattice

    def __missing__(self, part: str) -> int:
        score, loss, ids = self.lattice.best_and_loss(part)
        lattice = self.lattice
        number = self[part] = len(lattice.blobs)
        lattice.blobs.append(array("I", ids).tobytes())
        lattice.scores.append(score)
        lattice.losses.append(loss)
        return number


class PieceLattice:
    """Segmentations by the pieces and scores of a SentencePiece model file."""

    def __init__(self, path: str, best: int):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.best = best
        self.pieces: dict[str, tuple[int, float]] = {}
        self.spelling: dict[int, int] = {}
        self.table: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.spelling[int(piece[1:-1], 16)] = i
                self.table.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.table.append(b"")
            else:
                self.pieces[piece] = (i, model.get_score(i))
                self.table.append(piece.replace(SPACE, " ").encode())
        #: what a piece can begin with, to stop looking for longer ones; None marks a mere beginning
        self.begins: dict[str, tuple[int, float] | None] = {p[:k]: None for p in self.pieces for k in range(1, len(p))}
        self.begins.update(self.pieces)
        self.unknown = min(score for _, score in self.pieces.values()) - UNKNOWN_PENALTY
        self.cut = re.compile(self._parts_pattern()).findall
        self.searched: dict[str, list[tuple[float, bytes]]] = {}
        self.parts = _Parts(self)
        self.forget()

    def _parts_pattern(self) -> str:
        """Spaces and a run of one group of characters; groups are what pieces join, directly or not."""
        group: dict[str, str] = {}

        def root(c: str) -> str:
            while group.setdefault(c, c) != c:
                c = group[c]
            return c

        for piece in self.pieces:
            for a, b in zip(piece, piece[1:]):
                if SPACE not in (a, b):
                    group[root(a)] = root(b)
        members: dict[str, list[str]] = {}
        for c in group:
            members.setdefault(root(c), []).append(c)
        runs = ["[" + re.escape("".join(sorted(m))) + "]+" for m in sorted(members.values(), key=len, reverse=True) if len(m) > 1]
        return f"{SPACE}*(?:{'|'.join([*runs, f'[^{SPACE}]'])})|{SPACE}+"

    def forget(self) -> None:
        self.parts.clear()
        self.blobs: list[bytes] = []
        self.losses, self.scores = array("d"), array("d")

    def best_and_loss(self, text: str) -> tuple[float, float, list[int]]:
        """Forward Viterbi with the best two scores: the best, what the second loses, ids of the best."""
        begins, size = self.begins, len(text)
        one, two, back = [0.0] + [LOWEST] * size, [LOWEST] * (size + 1), [None] * (size + 1)
        for start in range(size):
            best, second = one[start], two[start]
            end, hit = start + 1, begins.get(text[start], False)
            if not hit:
                score = best + self.unknown
                if score > one[end]:
                    one[end], two[end], back[end] = score, max(one[end], second + self.unknown), (start, None)
                elif score > two[end]:
                    two[end] = score
            while hit is not False:
                if hit:
                    number, weight = hit
                    score, old = best + weight, one[end]
                    if score > old:
                        other = second + weight
                        one[end], two[end], back[end] = score, old if old > other else other, (start, number)
                    elif score > two[end]:
                        two[end] = score
                end += 1
                hit = begins.get(text[start:end], False) if end <= size else False
        ids: list[int] = []
        at = size
        while at:
            start, number = back[at]
            ids[:0] = [number] if number is not None else [self.spelling[b] for b in text[start].encode()]
            at = start
        return one[size], one[size] - two[size], ids

    def edges(self, text: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """By end position: start, score and ids of each edge."""
        found: list[list] = [[] for _ in range(len(text) + 1)]
        begins, size = self.begins, len(text)
        for start in range(size):
            end, hit = start + 1, begins.get(text[start], False)
            if not hit:
                found[end].append((start, self.unknown, tuple(self.spelling[b] for b in text[start].encode())))
            while hit is not False:
                if hit:
                    found[end].append((start, hit[1], (hit[0],)))
                end += 1
                hit = begins.get(text[start:end], False) if end <= size else False
        return found

    def search(self, text: str) -> list[tuple[float, tuple[int, ...]]]:
        """The best segmentations of ``text``, best first: score, ids.

        A queue entry stands for paths that no other entry has, the best of them at exactly its
        score.  So an entry behind as many better ones as are still wanted can be dropped, and
        the queue never holds more than ``best`` entries.
        """
        edges = self.edges(text)
        ahead = [0.0]
        for own in edges[1:]:
            ahead.append(max([ahead[start] + score for start, score, _ in own], default=LOWEST))
        queue = [(-ahead[-1], (), len(text), 0.0)]
        found: list[tuple[float, tuple[int, ...]]] = []
        while queue:
            total, ids, at, behind = queue.pop(0)
            if at == 0:
                found.append((-total, ids))
                if len(found) == self.best:
                    break
                continue
            wanted = self.best - len(found)
            for start, score, more in edges[at]:
                key = -(behind + score + ahead[start])
                if len(queue) < wanted or key < queue[-1][0]:
                    insort(queue, (key, more + ids, start, behind + score))
                    del queue[wanted:]
        return found

    def combine(self, options: list[list[tuple[float, bytes]]]) -> list[tuple[float, list[int]]]:
        """The best choices of one option per list: score, numbers of the options."""
        ahead = [0.0]
        for o in options:
            ahead.append(ahead[-1] + o[0][0])
        queue = [(-ahead[-1], [], len(options), 0.0)]
        found = []
        while queue and len(found) < self.best:
            total, picks, at, behind = heapq.heappop(queue)
            if at == 0:
                found.append((-total, picks))
                continue
            for k, (score, _) in enumerate(options[at - 1]):
                heapq.heappush(queue, (-(behind + score + ahead[at - 1]), [k, *picks], at - 1, behind + score))
        return found

    def options(self, part: str) -> list[tuple[float, bytes]]:
        """The best segmentations of a part, searched backwards."""
        if part not in self.searched:
            if len(self.searched) >= SEARCHED:
                self.searched.clear()
            self.searched[part] = [(score, array("I", ids).tobytes()) for score, ids in self.search(part)]
        return self.searched[part]

    def encode(self, text: str) -> list[tuple[float, bytes]]:
        """The best segmentations of a whole text, best first: score, ids (little-endian, 32 bit)."""
        import numpy as np

        if not text:
            return [(0.0, b"")]
        if len(self.parts) > MEMORY:
            self.forget()
        parts = self.cut(SPACE + text.replace(" ", SPACE))
        numbers = list(map(self.parts.__getitem__, parts))
        at = np.array(numbers)
        total = float(np.frombuffer(self.scores)[at].sum())
        losses = np.frombuffer(self.losses)[at]
        k = min(self.best - 1, len(at))
        near = np.flatnonzero(losses <= np.partition(losses, k - 1)[k - 1]) if k else at[:0]
        near = near[np.isfinite(losses[near])]
        least = sorted(near[np.argsort(losses[near], kind="stable")][:k].tolist())
        blobs = list(map(self.blobs.__getitem__, numbers))
        options = [self.options(parts[i]) for i in least]
        base = total - sum(o[0][0] for o in options)
        # what lies between the parts that may change is the same for all
        between = [b"".join(blobs[a + 1 : b]) for a, b in zip([-1, *least], [*least, len(blobs)])]
        out = []
        for score, picks in self.combine(options):
            pieces = [between[0]]
            for o, p, kept in zip(options, picks, between[1:]):
                pieces += (o[p][1], kept)
            out.append((base + score, b"".join(pieces)))
        return out

    def spelled(self, ids: bytes) -> bytes:
        """The bytes of the pieces."""
        return b"".join(map(self.table.__getitem__, array("I", ids)))

    def decode(self, ids: bytes) -> str:
        """The text of ``ids``."""
        return self.spelled(ids).decode("utf-8", "replace").removeprefix(" ")

    def round_trips(self, found: list[bytes], text: str) -> list[bool]:
        """Whether each of ``found``, segmentations of one text, decodes to ``text``.

        The first is decoded whole.  Another one is decoded where it differs from the first: with
        the same bytes there it has the same bytes in all.  If they differ, it is decoded whole too.
        """
        import numpy as np

        out: list[bool] = []
        first = np.frombuffer(found[0], dtype=np.uint32)
        for ids in found:
            if not out:
                out.append(self.decode(ids) == text)
                continue
            own = np.frombuffer(ids, dtype=np.uint32)
            size = min(len(first), len(own))
            other = np.flatnonzero(first[:size] != own[:size])
            head = int(other[0]) if len(other) else size
            other = np.flatnonzero(first[len(first) - size :][::-1] != own[len(own) - size :][::-1])
            tail = min(int(other[0]) if len(other) else size, size - head)
            same = self.spelled(found[0][4 * head : len(found[0]) - 4 * tail]) == self.spelled(ids[4 * head : len(ids) - 4 * tail])
            out.append(out[0] if same else self.decode(ids) == text)
        return out


def _lattice(path: str, best: int) -> PieceLattice:
    memo = process_memo("lattices")
    if (path, best) not in memo:
        memo[path, best] = PieceLattice(path, best)
    return memo[path, best]


def _encode(path: str, best: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lattice = _lattice(path, best)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in by_bytes(texts, HELD):
                rows = []
                for row in range(a, b):
                    found = lattice.encode(texts[row])
                    trips = lattice.round_trips([ids for _, ids in found], texts[row])
                    for rank, ((score, ids), trip) in enumerate(zip(found, trips), 1):
                        rows.append((row, rank, score, len(ids) // 4, ids, trip))
                row, *cols = zip(*rows)
                kinds = (pa.int32(), pa.float64(), pa.int64(), pa.binary(), pa.bool_())
                arrays = [batch.column(0).take(pa.array(row)), *[pa.array(c, k) for c, k in zip(cols, kinds)]]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "rank", "score", "n_pieces", "ids", "round_trip"])

    return run


def encode_nbest(docs: DataFrame, model: str, best: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Up to ``best`` rows per row of ``docs``: id, ``rank`` from 1, ``score``, ``n_pieces``, ``ids``
    (binary, little-endian 32 bit), ``round_trip`` (the ids decode to the text).

    A text with fewer segmentations has fewer rows; null or empty text has one, without pieces.
    Equal scores come in a fixed order.  A text with U+2581 decodes to a space there, as the
    format says, so it does not round-trip.  Null ids pass on, repeated rows are encoded each, an
    empty table gives an empty result.  Other columns are not used.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, rank int, score double, n_pieces long, ids binary, round_trip boolean"
    return rows.mapInArrow(_encode(model, best), schema).withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, model: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids in ``text_col``; null ids give null."""

    @F.pandas_udf("string")
    def decoded(ids):
        lattice = _lattice(model, 1)
        return ids.map(lambda b: None if b is None else lattice.decode(bytes(b)))

    return encoded.withColumn(text_col, decoded(F.col(ids_col)))
