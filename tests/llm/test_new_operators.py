"""Lexical search, spelling variants and the hidden Markov model against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from plain_versions import LOWER

from tidemark.llm import hmm, lexical, spelling
from tidemark.llm.hmm import END, OWN, UNKNOWN, expected_counts, hmm_scores, to_planes, train_hmm
from tidemark.llm.lexical import QueryBlock, count_levels, lexical_search, query_terms, sketch, term_hashes
from tidemark.llm.spelling import near_words, one_edit, spelling_variants


# --- spelling variants ------------------------------------------------------------------------


def plain_variants(rows, drop_every=97):
    counts = Counter()
    for r in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (r[1] or "").translate(LOWER)):
            h = crc32(f"{'' if r[0] is None else r[0]}:{w}".encode())
            if h % drop_every == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            counts[w] += len(w) >= 5
    words = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
    shapes = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            shapes[w[:i] + "\0" + w[i + 1 :]].add(w)  # one replaced
            if w[:i] + w[i + 1 :] in words:  # one inserted
                shapes[w, w[:i] + w[i + 1 :]] = {w, w[:i] + w[i + 1 :]}
    near = defaultdict(set)
    for group in shapes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def variants(df, **options):
    rows = spelling_variants(df, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r.word for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


@pytest.fixture(scope="module")
def misspelt(spark):
    """Words around a few stems, with every kind of edit at every place, nulls and long runs."""
    rng = random.Random(8)
    stems = ["éclairer", "wonder", "wonders", "thunder", "aaaaa", "ab×÷cde"]
    rows = []
    for i in range(300):
        words = []
        for _ in range(40):
            w = list(rng.choice(stems))
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "é", "x"])
            words.append("".join(w))
        rows.append((i, rng.choice([" ", "-", "_1"]).join(words).upper() if i % 9 == 0 else " ".join(words)))
    rows += [(None, "wonder wonder"), (400, None), (401, ""), (402, "12 !!"), (403, "z" * 5000 + " " + "z" * 4999), (404, "z" * 5000 + " " + "z" * 4999)]
    rows += [(405, "z" * 5000 + " " + "z" * 4999)] * 2
    return rows


def test_variants_are_those_of_all_pairs(spark, misspelt):
    df = spark.createDataFrame([(*r, "c", "c") for r in misspelt], "doc_id long, text string, word string, n string").repartition(7)
    assert variants(df) == plain_variants(misspelt)
    assert variants(df, drop_every=2) == plain_variants(misspelt, 2)


def test_variants_of_cut_blocks(spark, misspelt, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 5)
    df = spark.createDataFrame(misspelt, "doc_id long, text string")
    assert variants(df) == plain_variants(misspelt)


def test_variants_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = variants(docs)
    assert got == plain_variants(rows) and len(got) > 500


def test_variants_awkward(spark, empty):
    assert variants(empty) == set()
    names = spark.createDataFrame([("a", "hello hello hello hellos")] * 3, "word string, n string")
    assert {r.word: r.form for r in spelling_variants(names, "word", "n").collect()} == {"hello": None, "hellos": "hello"}


def test_one_edit_of_shortest_words():
    words = ["a", "b", "ab", "ba", "cc"]
    codes = np.array([[ord(c) - 96 for c in w.ljust(2, "`")] for w in words])
    bits = one_edit(codes, 1, np.array([1, 1, 2, 2, 2]), np.array([0, 1]))
    got = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little", count=5)
    assert got.tolist() == [[0, 1, 1, 1, 0], [1, 0, 1, 1, 0]]


def test_near_words_meet_once(spark):
    words = ["aaaaa", "aaaaaa", "aaaab", "baaaa", "aabaa", "aabaaa"]
    df = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    pairs = [(r.word, r.near) for r in near_words(df).collect()]
    assert len(pairs) == len(set(pairs)) and all((b, a) in pairs for a, b in pairs)
    assert {b for a, b in pairs if a == "aaaaa"} == {"aaaaaa", "aaaab", "baaaa", "aabaa", "aabaaa"}


# --- ranked lexical search --------------------------------------------------------------------


def plain_search(rows, items, k=20):
    cut = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall
    held = [(r[0], Counter(cut((r[1] or "").translate(LOWER)))) for r in rows]
    full = [sum(c.values()) for _, c in held]
    n_docs, n_terms = sum(n > 0 for n in full), sum(full)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for item, text in items:
        scores = []
        for (doc, c), n in zip(held, full):
            score = 0
            for t in cut((text or "").translate(LOWER)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)))
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        for rank, (score, none, doc) in enumerate(sorted(scores)[:k], 1):
            out[(item, rank, None if none else doc, -score)] += 1
    return out


def search(docs, items, **options):
    return Counter(tuple(r) for r in lexical_search(docs, items, **options).select("item_id", "rank", "doc_id", "score").collect())


ITEMS = [(1, "the of and"), (2, "mot fin mot mot"), (3, None), (4, ""), (5, "nowhere-to zzzz"), (6, "changed LONG words"), (7, "CC by 4 all rights"), (8, "été çà x"), (2, "over")]


@pytest.mark.parametrize("seeds,items", [(40, 512), (20, 2), (1, 3)])
def test_search_is_that_of_all_scores(spark, docs, rows, monkeypatch, seeds, items):
    monkeypatch.setattr(lexical, "SEEDS", seeds)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", items)
    asked = spark.createDataFrame([(*i, "c") for i in ITEMS], "item_id long, text string, score string")
    got = search(docs, asked)
    want = plain_search(rows, ITEMS)
    assert got == want and len(want) > 60
    assert search(docs, asked, k=3) == plain_search(rows, ITEMS, 3)


def test_search_of_a_table(spark):
    read = lambda name, *cols: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").select(*cols)
    docs, items = read("documents", "doc_id", "text"), read("benchmark", "item_id", "text")
    assert search(docs, items) == plain_search([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])


def test_search_awkward(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search(empty, items) == search(docs, items.limit(0)) == search(empty, items.limit(0)) == Counter()
    assert search(docs, items.filter("item_id in (3, 4, 5)")) == Counter()
    named = spark.createDataFrame([("b", "x y"), ("a", "y x"), ("c", "x"), (None, "x y")], "name string, body string")
    got = lexical_search(named, items.filter("item_id = 8"), 2, id_col="name", text_col="body").collect()
    assert [(r["rank"], r["name"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, "c"), (2, "a")]


def test_bounds_hold_and_are_close():
    rng = random.Random(4)
    words = [f"w{i}".encode() for i in range(3000)]
    queries = [[rng.choice(words) for _ in range(30)] for _ in range(20)]
    block = QueryBlock(queries, {w: rng.randrange(1, 9000) for w in words}, 1000, 300_000)
    loose = []
    for size in (0, 1, 5, 300, 5000):
        found = Counter(rng.choice(words[:1500]) for _ in range(size))
        found.update({words[0]: 3000} if size == 5000 else {})
        n = sum(found.values())
        bounds = block.bounds(n, *sketch(term_hashes(list(found)), np.array(list(found.values()), np.uint32)), count_levels())
        exact = np.array([block.score(q, found, n) for q in range(20)])
        assert (bounds >= exact).all()
        loose.append(bounds.sum() / max(1, exact.sum()))
    assert loose[3] < 1.6 and loose[4] < 1.3
    assert query_terms("A-b é_1\x7fZ") == ["a".encode(), b"b", "é".encode(), b"1", b"z"]


# --- hidden Markov model ----------------------------------------------------------------------


def plain_tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), END]


def plain_base(rows):
    """What the contract fixes: (id, held out, tokens, known, training tokens, base score)."""
    held = [crc32(str("" if r[0] is None else r[0]).encode()) % 5 == 1 for r in rows]
    c = Counter(t for r, h in zip(rows, held) if not h for t in plain_tokens(r[1]))
    n, v = sum(c.values()), len(c)
    out = []
    for r, h in zip(rows, held):
        ts = plain_tokens(r[1])
        out.append((r[0], h, len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)))
    return c, out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[5]))


def check_base(got, want):
    got, want = in_order(got), in_order(want)
    assert [tuple(r[:5]) for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)


def test_hmm_base_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = hmm_scores(docs, rounds=1).collect()
    check_base(got, plain_base([tuple(r) for r in docs.collect()])[1])


def counts_of(model):
    return {r["symbol"]: np.array(r[1:]) for r in model.counts.collect()}


def plain_model_score(model, counts, c, tokens):
    """Log likelihood of tokens by the plain recursion, from the model's counts."""
    all_states = sum(counts.values())
    everything = all_states.sum() + 0.5
    once, twice = sum(n == 1 for w, n in c.items() if w != END), sum(n == 2 for n in c.values())
    unseen = (once + 1) / (once + 2 * twice + 2) if once else 1.0
    rare = Counter()
    for w, n in c.items():
        if 1 < n < OWN and w != END:
            rare[UNKNOWN + w[-2:]] += n
    moves, state, total = np.array(model.moves), None, 0.0
    for w in tokens:
        n = c[w]
        if n >= OWN or (w == END and n):
            symbol, inner = w, 1.0
        elif n > 1:
            symbol, inner = UNKNOWN + w[-2:], n / rare[UNKNOWN + w[-2:]]
        else:
            symbol, inner = UNKNOWN, (1 - unseen) / once if n else unseen
        g = counts[symbol]
        b = (g + hmm.PRIOR * (g.sum() + (0.5 if symbol == UNKNOWN else 0)) / everything) / (all_states + hmm.PRIOR)
        state = (np.array(model.first) if state is None else state @ moves) * b * inner
        total += math.log10(state.sum())
        state /= state.sum()
    return total


def test_hmm_scores_are_likelihoods(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(hmm, "SHARD_WORDS", 40)
    monkeypatch.setattr(hmm, "BATCH_TOKENS", 300)
    monkeypatch.setattr(hmm, "GROUP_TOKENS", 1000)
    model = train_hmm(docs, states=3, rounds=6)
    got = model.scores().collect()
    c, want = plain_base(rows)
    check_base([(r.id, r.held_out, r.n_tokens, r.n_known, model.train_tokens, r.base_score) for r in got], want)
    texts, counts = {r[0]: r[1] for r in rows if r[0] is not None}, counts_of(model)
    for r in [r for r in got if r.id is not None and r.n_tokens < 2000]:
        assert math.isclose(r.score, plain_model_score(model, counts, c, plain_tokens(texts[r.id])), rel_tol=1e-5)
    assert all(b > a - 1e-3 * abs(a) for a, b in zip(model.likelihoods, model.likelihoods[1:])) and model.likelihoods[-1] > model.likelihoods[0]
    assert np.allclose(np.sum(model.moves, axis=1), 1) and math.isclose(sum(model.first), 1)
    # the same whatever the partitions and shards
    monkeypatch.setattr(hmm, "SHARD_WORDS", 10**6)
    again = {r.doc_id: r.score for r in hmm_scores(docs.repartition(2), states=3, rounds=6).collect()}
    assert all(math.isclose(again[r.id], r.score, rel_tol=1e-3) for r in got if r.id is not None)


def test_hmm_probabilities_add_up(spark):
    """Over every token that may come next, the known ones and the unknown word."""
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(3000)]
    texts = [(i, " ".join(words[i * 30 : i * 30 + 30])) for i in range(100)]
    c, _ = plain_base(texts)
    assert any(n == 1 for n in c.values()) and any(1 < n < OWN for n in c.values()) and any(n >= OWN for n in c.values())
    model = train_hmm(spark.createDataFrame(texts, "doc_id long, text string"), states=4, rounds=3)
    counts = counts_of(model)
    for begun in ([], ["w1"], ["w1", "never", "w2"]):
        share = 10 ** plain_model_score(model, counts, c, begun)
        assert math.isclose(sum(10 ** plain_model_score(model, counts, c, [*begun, w]) for w in [*c, "never"]), share, rel_tol=1e-9)


def test_expected_counts_by_enumeration():
    from itertools import product

    rng = np.random.default_rng(3)
    emissions, moves, first = rng.random((4, 2)), rng.random((2, 2)), rng.random(2)
    moves, first = moves / moves.sum(axis=1, keepdims=True), first / first.sum()
    tokens = [np.array([0, 3, 1, 1]), np.array([2]), np.array([3, 0])]
    counts, pairs, begun, total = np.zeros((4, 2)), np.zeros((2, 2)), np.zeros(2), 0.0
    for t in tokens:
        paths = {}
        for path in product(range(2), repeat=len(t)):
            p = first[path[0]] * np.prod([moves[a, b] for a, b in zip(path, path[1:])]) * np.prod([emissions[x, s] for x, s in zip(t, path)])
            paths[path] = p
        whole = sum(paths.values())
        total += math.log(whole)
        for path, p in paths.items():
            begun[path[0]] += p / whole
            for x, s in zip(t, path):
                counts[x, s] += p / whole
            for a, b in zip(path, path[1:]):
                pairs[a, b] += p / whole
    got = expected_counts([np.frombuffer(to_planes(t.astype(np.uint32)), np.uint8) for t in tokens], emissions.T.copy(), moves, first)
    assert np.allclose(got[0], counts.T) and np.allclose(got[1], pairs) and np.allclose(got[2], begun) and math.isclose(got[3], total)


def test_hmm_is_better_than_counts_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in hmm_scores(docs).collect() if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    gain = sum(r.score - r.base_score for r in held) / tokens
    assert len(held) > 150 and gain > 0.3
    assert sum(r.score > r.base_score for r in held if r.n_known > 50) > 0.9 * sum(r.n_known > 50 for r in held)


def test_hmm_awkward(spark, empty):
    assert hmm_scores(empty).collect() == []
    only_held = spark.createDataFrame([(1, "a b"), (1, None)], "doc_id long, text string")
    out = hmm_scores(only_held, folds=1, held_fold=0).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    long = spark.createDataFrame([("x", "y" * 100_000 + " Z"), ("y", "y" * 100_000)], "score2 string, text string")
    assert {r.score2: r.n_tokens for r in hmm_scores(long, "score2").collect()} == {"x": 3, "y": 2}
