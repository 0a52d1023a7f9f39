"""Texts in slices, n-gram hashes of whole slices, and memory that tasks give back."""

import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyspark
import pytest

from tidemark.llm import common, hmm, lexical
from tidemark.llm import jaccard_join as join
from tidemark.llm.encoding import PieceEncoder


def test_slices_are_whole_and_bounded():
    rng = random.Random(1)
    texts = [rng.choice([None, "", "é" * rng.randint(0, 30), "x" * rng.randint(0, 300)]) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(range(200))], ["text", "id"]).slice(3)
    parts = list(common.slices(batch, 100))
    assert [i for p in parts for i in p.column(1).to_pylist()] == list(range(3, 200))
    for p in parts:
        held, starts = common.text_bytes(p.column(0))
        assert held.tobytes().decode() == "".join(t or "" for t in p.column(0).to_pylist()) and starts[-1] == len(held)
        assert p.num_rows == 1 or len(held) <= 100
    assert list(common.slices(batch.slice(0, 0), 100)) == []


@pytest.mark.parametrize("words", [1, 2, 5])
def test_shingles_are_those_of_plain_words(words):
    """Equal n-grams have equal hashes and others differ, within a text and across texts that lie next to each other."""
    rng = random.Random(2)
    long = "w" * 200
    pool = ["a", "A", "b", "ab", "ba", "Ab", "é", "É", "x.y", long, long.upper(), long + "v", "a" * 64, "a" * 65]
    texts = ["".join(rng.choice(pool) + rng.choice([" ", "\n", "\t \x0b", "  "]) for _ in range(rng.randint(0, 12))).strip(rng.choice([" ", ""])) for _ in range(300)]
    texts += [None, "", "  ", "a", "a b c d e f"]
    sets = join.shingles(*common.text_bytes(pa.array(texts, pa.string())), words)
    assert len(sets) == len(texts)
    hashes: dict = {}
    for text, found in zip(texts, sets):
        own = (text or "").encode().lower().split()
        plain = {tuple(own[i : i + words]) for i in range(len(own) - words + 1)} or ({tuple(own)} if own else set())
        assert len(found) == len(plain) and np.all(found[1:] > found[:-1])
        hashes.setdefault(frozenset(plain), set()).add(found.tobytes())
    assert all(len(v) == 1 for v in hashes.values())
    single = {v for s in hashes for v in s}
    assert len(np.unique(np.concatenate(sets))) == len(single)


def test_encoder_does_not_write_out_its_vocabulary(monkeypatch):
    """Special tokens and the kind of the tokenizer come from its parts; a text of the whole vocabulary would stay in the worker's memory."""
    import tokenizers

    load = tokenizers.Tokenizer.from_file

    class Sparing:
        from_file = staticmethod(lambda path: Sparing(load(path)))

        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            assert name != "to_str"
            return getattr(self.inner, name)

    want = {n: PieceEncoder(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}
    with monkeypatch.context() as m:
        import json

        for e in want.values():
            spec = json.loads(e.tokenizer.to_str())
            assert sorted(e.special) == sorted(t["content"] for t in spec.get("added_tokens") or [])
            assert e.spaced == (spec["pre_tokenizer"]["type"] == "ByteLevel")
        m.setattr(tokenizers, "Tokenizer", Sparing)
        for n, e in want.items():
            assert PieceEncoder(public_tokenizers.path(n)).encode("Some words, again.") == e.encode("Some words, again.")


def test_tasks_give_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    assert list(common.tidy(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3] and calls == [1]


def prefix_rows(weights, texts, words=2):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    found = pa.Table.from_batches(join._prefixes(words, 75, SimpleNamespace(value=weights))(iter([batch])))
    return found.to_pylist()


def test_ngrams_of_a_large_table_are_not_all_dealt_out():
    """On a large table every slot of the sketch counts many n-grams; only slots well above that hold a common one."""
    texts = [f"w{i} v{i}" for i in range(100)]
    weights = np.full(join.SLOTS, int(2048 * np.log2(30_000)), np.uint64)
    assert {r["salt"] for r in prefix_rows(weights, texts)} == {0}
    weights[np.random.default_rng(1).random(join.SLOTS) < 0.3] = int(2048 * np.log2(60_000))
    assert {r["salt"] > 0 for r in prefix_rows(weights, texts)} == {True, False}


def test_first_shared_ngram_of_a_similar_pair_passes_on_both_sides():
    rng, pairs = random.Random(3), 0
    for _ in range(3000):
        base = rng.sample(range(60), rng.randint(1, 30))
        x, y = (sorted({v for v in base if rng.random() > 0.1} | {rng.randrange(60) for _ in range(rng.randint(0, 3))}) for _ in range(2))
        common = sorted(set(x) & set(y))
        if common and 100 * len(common) >= 75 * len({*x, *y}):
            pairs += 1
            i, j = x.index(common[0]), y.index(common[0])
            assert len(y) <= join.longest_partner(len(x), i, 75) and len(x) <= join.longest_partner(len(y), j, 75)
            assert i < join.prefix_length(len(x), 75) and j < join.prefix_length(len(y), 75)
    assert pairs > 300


@pytest.mark.parametrize("salt", [0, 1])
def test_classes_meet_only_where_a_similar_pair_can(spark, salt):
    """An n-gram late in the prefixes of two sets of one size leaves too few elements for both; an early one does not."""
    late, early = join.longest_partner(100, 24, 75), join.longest_partner(100, 3, 75)
    rows = [(7, 1, 2 << 32 | 100, late, salt), (7, 2, 2 << 32 | 100, late, salt), (8, 1, 2 << 32 | 100, early, salt), (8, 2, 2 << 32 | 100, early, salt)]
    rows += [(8, 2, 2 << 32 | 100, early, salt), (9, 1, 2 << 32 | 100, early, salt)]
    found = join._meetings(spark.createDataFrame(rows, "token long, a long, bn long, limit int, salt int"), 75)
    assert {(r.token, r.a, r.b, r.n, r.centre.a) for r in found.collect()} == {(8, 1, 2, 100, 1), (8, 2, 2, 100, 1)}


def test_search_passes_small_batches(spark, monkeypatch):
    seen, key = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    write = lexical.materialise
    monkeypatch.setattr(lexical, "materialise", lambda df: seen.append(spark.conf.get(key)) or write(df))
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    found = lexical.lexical_search(docs, spark.createDataFrame([(5, "b a")], "item_id long, text string")).collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in found] == [(5, 1, 1), (5, 2, 2)]
    assert len(seen) > 2 and set(seen) == {str(lexical.HELD_DOCS)} and spark.conf.get(key) == before


def test_words_of_a_shard_leave_in_pieces(monkeypatch):
    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: SimpleNamespace(partitionId=lambda: 0)))
    for name, value in {"PIECE_DOCS": 3, "PIECE_WORDS": 4, "SHARD_WORDS": 15}.items():
        monkeypatch.setattr(hmm, name, value)
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randint(0, 9))) for _ in range(40)]
    held = [i % 5 == 1 for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(held), pa.array(texts)], ["id", "held_out", "text"])
    got = Counter()
    for part in hmm._shards(iter([batch])):
        rows = [r for r in part.to_pylist() if r["word"] is not None]
        assert len(rows) <= 4
        got.update({r["word"]: r["n"] for r in rows})
    want = Counter(w for t, h in zip(texts, held) for w in [*t.split(), hmm.END] if not h)
    assert +got == want


def test_groups_of_a_part_share_their_symbols(spark, monkeypatch):
    """Symbols move once a part, so as texts grow their rows grow no faster, and the scores stay as they are."""
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(random.Random(i).choices(words, k=200))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(hmm, "GROUP_TOKENS", 201 * 5)
    made, scores = {}, {}
    for n, parts in ((80, 16), (400, 20)):
        some = docs.filter(f"doc_id < {n}").repartitionByRange(n // 5, "doc_id")
        model = hmm.train_hmm(some, states=2, rounds=2)
        groups = model.table.docs.filter("tokens is not null").select("group").distinct().count()
        made[n] = model.table.symbols.count()
        assert groups > n // 10 and made[n] <= parts * 40 and model.table.symbols.groupBy("part", "symbol").count().filter("count > 1").isEmpty()
        scores[n] = {r.id: r.score for r in model.scores().collect()}
        model.table.drop()
    assert made[400] < 3 * made[80]
    monkeypatch.setattr(hmm, "GROUP_TOKENS", 10**9)
    alone = {r.doc_id: r.score for r in hmm.hmm_scores(docs, states=2, rounds=2).collect()}
    assert len(scores[400]) == 400 and all(abs(scores[400][i] - s) < 1e-3 * abs(s) for i, s in alone.items())


def test_sums_of_a_part_keep_their_precision(spark):
    docs = spark.createDataFrame([(i, "a b a c " * 700) for i in range(50)], "doc_id long, text string")
    model = hmm.train_hmm(docs, states=1, rounds=2)
    (first,) = model.first
    assert first == 1.0 and model.moves == [[1.0]]
    # one state: the texts' own word counts, smoothed
    counted = {r.symbol: r.g0 for r in model.counts.collect()}
    assert {w: round(n) for w, n in counted.items() if n > 1} == {w: n * model.train_tokens // 2801 for w, n in {"a": 1400, "b": 700, "c": 700, hmm.END: 1}.items()}
