"""Language identification of code-switched text by a linear-chain conditional random field.

Every word gets a label.  A word's score for a language is the sum of learned weights of its
features: affixes of 1 to 3 letters, letter bigrams and trigrams, length, and membership in the
lexicons of frequent words; a learned matrix scores transitions between neighbouring labels.
Forward-backward gives each word's label probabilities; a document's are their mean.

Training uses a bounded sample: at most SAMPLE_DOCS documents per language and a window of
SAMPLE_WORDS words from each, chosen by a hash of the row.  Windows of several languages are
joined into code-switched sequences, so that transitions are learned too.  Prediction covers all
words of all texts.  The model has a fixed size, ``FEATURES`` rows of one weight per language.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fresh, named_id, process_memo, row_keys, slices, tidy
from tidemark.operators.support import attach
from tidemark.session import materialise

#: Bound of the training sample.
SAMPLE_DOCS, SAMPLE_WORDS = 500, 120
#: Windows of all languages together.
SAMPLE_ALL = 10_000
#: Words of each language's lexicon, taken from the sample.
LEXICON = 300
FEATURES = 1 << 15
#: Length of training sequences and of the runs of one language in them.
SEQUENCE, SHORTEST_RUN, LONGEST_RUN = 64, 6, 40
EPOCHS, BATCH, RATE = 4, 64, 0.3
#: Words of one block of the blocked forward-backward pass.
BLOCK = 128
#: Bytes of text handled at a time, and words remembered by one Python worker.
HELD, MEMORY = 500_000, 500_000

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case; other number characters, such as fractions, end a word too."""
    found = WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees; false for a null id (which training does not see either)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


class _Numbers(dict):
    """Feature numbers of letter groups, remembered."""

    def __missing__(self, group: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        number = self[group] = zlib.crc32(group.encode()) % FEATURES
        return number


def features(word: str, lexicon: dict[str, list[int]]) -> list[int]:
    """Feature numbers of a lower-case word; affixes are letter groups with the mark of an end."""
    numbers = process_memo("crf").setdefault("numbers", _Numbers())
    marked, n = f"<{word}>", len(word) + 2
    groups = [marked[i : i + 2] for i in range(n - 1)] + [marked[i : i + 3] for i in range(n - 2)] + [marked[:4], marked[-4:], f"#{min(n, 14)}"]
    groups += [f"={lang}" for lang in lexicon.get(word, ())]
    return [numbers[g] for g in dict.fromkeys(groups)]


def forward_backward(emissions, transitions, starts):
    """Label probabilities of every word: ``(n, labels)``.

    ``emissions`` are log scores of the words of all texts one after another, ``starts`` where
    each text begins.  Texts are cut into blocks.  The product of a block's matrices carries the
    messages across it, so all blocks of all texts are walked at once and a long text costs no
    more per word than a short one; the result is that of the plain recursion.
    """
    import numpy as np

    n, labels = emissions.shape
    if not n:
        return np.zeros((0, labels))
    e = np.exp(emissions - emissions.max(axis=1, keepdims=True)).astype(np.float64)
    t = np.exp(transitions - transitions.max()).astype(np.float64)
    ends = np.append(starts[1:], n)
    blocks = -(-(ends - starts) // BLOCK)
    owner = np.repeat(np.arange(len(starts)), blocks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    first = starts[owner] + number * BLOCK
    size = np.minimum(ends[owner] - first, BLOCK)
    order = np.argsort(-size, kind="stable")
    first, size, number, owner = first[order], size[order], number[order], owner[order]
    live = [int((size > k).sum()) for k in range(int(size.max()))]

    # products of the blocks' matrices
    across = np.broadcast_to(np.eye(labels), (len(first), labels, labels)).copy()
    for k, m in enumerate(live):
        step = (across[:m] @ t) * e[first[:m] + k][:, None, :]
        across[:m] = step / step.max(axis=(1, 2), keepdims=True)
    # messages at the blocks' borders, block number by block number
    place = np.full((len(starts), int(blocks.max())), -1)
    place[owner, number] = np.arange(len(first))
    ahead = np.full((len(first), labels), 1.0 / labels)
    behind = np.ones((len(first), labels))
    for k in range(1, place.shape[1]):
        to = place[place[:, k] >= 0]
        moved = np.einsum("bi,bij->bj", ahead[to[:, k - 1]], across[to[:, k - 1]])
        ahead[to[:, k]] = moved / moved.sum(axis=1, keepdims=True)
    for k in range(place.shape[1] - 2, -1, -1):
        to = place[place[:, k + 1] >= 0]
        moved = np.einsum("bij,bj->bi", across[to[:, k + 1]], behind[to[:, k + 1]])
        behind[to[:, k]] = moved / moved.sum(axis=1, keepdims=True)
    # within the blocks
    alpha = np.empty((n, labels))
    state = ahead
    for k, m in enumerate(live):
        at = first[:m] + k
        step = (state[:m] @ t) * e[at]
        state[:m] = step / step.sum(axis=1, keepdims=True)
        alpha[at] = state[:m]
    state = behind
    for k in range(len(live) - 1, -1, -1):
        m = live[k]
        at = first[:m] + k
        alpha[at] *= state[:m]
        step = (state[:m] * e[at]) @ t.T
        state[:m] = step / step.sum(axis=1, keepdims=True)
    return alpha / alpha.sum(axis=1, keepdims=True)


def train(sample: list[tuple[str, list[str]]], seed: int = 11) -> dict:
    """Model from ``(language, words)`` windows: languages, lexicon, weights, transitions."""
    import numpy as np

    langs = sorted({lang for lang, _ in sample})
    label = {lang: i for i, lang in enumerate(langs)}
    rng = np.random.default_rng(seed)
    counts: dict[str, dict[str, int]] = {lang: {} for lang in langs}
    for lang, words in sample:
        for w in words:
            counts[lang][w] = counts[lang].get(w, 0) + 1
    lexicon: dict[str, list[int]] = {}
    for lang in langs:
        for w in sorted(counts[lang], key=lambda w: (-counts[lang][w], w))[:LEXICON]:
            lexicon.setdefault(w, []).append(label[lang])

    # code-switched sequences: runs of one window after another, in random order
    runs = []
    for lang, words in sample:
        at = 0
        while at < len(words):
            size = int(rng.integers(SHORTEST_RUN, LONGEST_RUN + 1))
            runs.append([(w, label[lang]) for w in words[at : at + size]])
            at += size
    stream = [pair for i in rng.permutation(len(runs)) for pair in runs[i]]
    memo = {w: features(w, lexicon) for w in {w for w, _ in stream}}
    sequences = [stream[i : i + SEQUENCE] for i in range(0, len(stream), SEQUENCE)]

    size = len(langs)
    weights, moves = np.zeros((FEATURES, size)), np.zeros((size, size))
    seen, seen_moves = np.full((FEATURES, size), 1e-6), np.full((size, size), 1e-6)
    for _ in range(EPOCHS):
        shuffled = rng.permutation(len(sequences))
        for b in range(0, len(shuffled), BATCH):
            batch = [sequences[i] for i in shuffled[b : b + BATCH]]
            words = [w for s in batch for w, _ in s]
            gold = np.array([y for s in batch for _, y in s])
            starts = np.cumsum([0, *(len(s) for s in batch)])[:-1]
            feats = [memo[w] for w in words]
            flat = np.concatenate([np.array(f) for f in feats])
            heads = np.cumsum([0, *(len(f) for f in feats)])[:-1]
            emissions = np.add.reduceat(weights[flat], heads, axis=0)
            marginal = forward_backward(emissions, moves, starts)
            error = -marginal
            error[np.arange(len(gold)), gold] += 1
            slope = np.zeros_like(weights)
            np.add.at(slope, flat, np.repeat(error, [len(f) for f in feats], axis=0))
            slope /= len(batch)
            touched = np.unique(flat)
            seen[touched] += slope[touched] ** 2
            weights[touched] += RATE * slope[touched] / np.sqrt(seen[touched])
            # expected transitions from the marginals of neighbours, given their words
            inner = np.ones(len(gold), bool)
            inner[starts] = False
            right = np.flatnonzero(inner)
            pair = marginal[right - 1][:, :, None] * np.exp(moves) * marginal[right][:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            slope_moves = -pair.sum(axis=0)
            np.add.at(slope_moves, (gold[right - 1], gold[right]), 1)
            slope_moves /= len(batch)
            seen_moves += slope_moves**2
            moves += RATE * slope_moves / np.sqrt(seen_moves)
    return {"langs": langs, "lexicon": lexicon, "weights": weights.astype(np.float32), "moves": moves}


def _windows(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        langs, words, ranks = [], [], []
        for lang, text, h in zip(*(batch.column(i).to_pylist() for i in range(3))):
            found = words_of(text)
            if found:
                start = h % max(1, len(found) - SAMPLE_WORDS + 1)
                langs.append(lang)
                words.append(found[start : start + SAMPLE_WORDS])
                ranks.append(h)
        cols = [pa.array(langs, pa.string()), pa.array(words, pa.list_(pa.string())), pa.array(ranks, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["lang", "words", "h"])


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, list[str]]]:
    """At most SAMPLE_DOCS windows of SAMPLE_WORDS words per language, chosen by hash, and SAMPLE_ALL in all.

    With more languages than that, the ones with the most documents are learned.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    rows = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("id"), 1))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = materialise(sizes.orderBy(F.desc("n"), "lang").limit(SAMPLE_ALL))
    each = min(SAMPLE_DOCS, SAMPLE_ALL // max(1, sizes.count()))
    # a share of each language that holds twice the bound or so, then exactly the bound
    share = F.least(F.lit(1.0), F.lit(2.0 * each) / F.col("n")) * F.lit(float(2**63 - 1))
    near = attach(rows, sizes, "lang").filter(F.col("h") <= share)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("rank") <= each)
    found = ranked.select("lang", "text", "h").mapInArrow(_windows, "lang string, words array<string>, h long")
    return sorted((r["lang"], list(r["words"])) for r in found.collect())


class Tagger:
    """Word scores of one model, remembered per worker."""

    def __init__(self, model: dict):
        self.model, self.memory = model, process_memo("crf")
        if self.memory.get("of") is not model:  # another model than the last task's
            self.memory.update(of=model, place={}, scores=[])

    def emissions(self, words: list[str]):
        import numpy as np

        place, weights, lexicon = self.memory["place"], self.model["weights"], self.model["lexicon"]
        if len(place) > MEMORY:
            self.memory.update(place={}, scores=[])
            place = self.memory["place"]
        new = [w for w in dict.fromkeys(words) if w not in place]
        if new:
            feats = [features(w, lexicon) for w in new]
            heads = np.cumsum([0, *(len(f) for f in feats)])[:-1]
            scores = np.add.reduceat(weights[np.concatenate([np.array(f) for f in feats])], heads, axis=0)
            base = sum(len(s) for s in self.memory["scores"])
            place.update(zip(new, range(base, base + len(new))))
            self.memory["scores"].append(scores)
        if len(self.memory["scores"]) > 1:
            self.memory["scores"] = [np.concatenate(self.memory["scores"])]
        return self.memory["scores"][0][np.fromiter(map(place.__getitem__, words), np.int64, len(words))]


def _predict(shared, pred_name: str = "lang_pred", score_name: str = "score"):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        model = shared.value
        langs = model["langs"]
        tagger = Tagger(model) if langs else None
        for batch in batches:
            for piece in slices(batch, HELD):
                words = [words_of(t or "") for t in piece.column(0).to_pylist()]
                pred, score = ["und"] * len(words), [0.0] * len(words)
                full = [i for i, w in enumerate(words) if w]
                if full and langs:
                    sizes = np.array([len(words[i]) for i in full])
                    starts = np.cumsum(sizes) - sizes
                    flat = [w for i in full for w in words[i]]
                    share = np.add.reduceat(forward_backward(tagger.emissions(flat), model["moves"], starts), starts, axis=0) / sizes[:, None]
                    best = share.argmax(axis=1)
                    for i, k, s in zip(full, best.tolist(), share.max(axis=1).tolist()):
                        pred[i], score[i] = langs[k], min(1.0, s)
                cols = [*piece.columns[1:], pa.array(pred, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[1:], pred_name, score_name])

    return tidy(run)


def _model(docs: DataFrame, id_col: str, text_col: str, lang_col: str):
    sample = training_sample(docs, id_col, text_col, lang_col)
    return docs.sparkSession.sparkContext.broadcast(train(sample) if sample else {"langs": []})


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: id, key ``(k1, k2)`` of the row, ``held_out``, ``lang_pred``, ``score``.

    Learns from rows with a text, a language and an id that is not held out; predicts from the
    text alone.  ``und`` with score 0 if the text is null, empty or has no letter, or if nothing
    could be learned.  Repeated rows are judged alike, an empty table gives an empty result.
    Other columns are not used; a column of the result that is named like the id gets another name.
    """
    shared = _model(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    one, two = row_keys(rows, "id", "text")
    rows = rows.withColumns({"k1": one, "k2": two, "held_out": held_out(F.col("id"))})
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_predict(shared), f"id {kind}, k1 long, k2 long, held_out boolean, lang_pred string, score double")
    return named_id(out, id_col)


def keep_agreed(docs: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` in whose words a language is found with a score of ``least`` or more.

    Whole rows pass the prediction once and stay where they are.
    """
    shared = _model(docs, id_col, text_col, lang_col)
    pred, score = fresh(docs, "lang_pred", "score")
    rows = docs.select(F.col(text_col).cast("string").alias(fresh(docs, "whole_text")[0]), *[F.col(f"`{c}`") for c in docs.columns])
    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    judged = rows.mapInArrow(_predict(shared, pred, score), schema)
    return judged.filter((F.col(pred) != "und") & (F.col(score) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
