"""Language identification, quality rules and the Jaccard join against plain versions."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from plain_versions import components

from tidemark.llm import jaccard_join as join
from tidemark.llm import langid
from tidemark.llm.components import connected_components
from tidemark.llm.jaccard_join import PrefixTree, near_duplicates
from tidemark.llm.langid import forward_backward, identify_languages
from tidemark.llm.quality import ORDER, KneserNey, class_table, count_grams, grams, quality_rules

SF = "/root/testdata/sf0.01"


def test_forward_backward(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 7)
    rng = np.random.default_rng(0)
    e, t, starts = rng.normal(size=(60, 3)) * 2, rng.normal(size=(3, 3)), np.array([0, 5, 6, 40])
    got = forward_backward(e, t, starts)
    for a, b in zip(starts, [5, 6, 40, 60]):
        # sums over all label sequences by the plain recursion in log space
        n = b - a
        ahead, behind = np.zeros((n, 3)), np.zeros((n, 3))
        state = np.log(np.ones(3) / 3)
        for i in range(n):
            state = np.logaddexp.reduce(state[:, None] + t, axis=0) + e[a + i]
            ahead[i] = state
        for i in range(n - 2, -1, -1):
            behind[i] = np.logaddexp.reduce(t + e[a + i + 1] + behind[i + 1], axis=1)
        both = ahead + behind
        want = np.exp(both - np.logaddexp.reduce(both, axis=1)[:, None])
        assert np.allclose(got[a:b], want)


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in out)


def test_languages_awkward(docs, rows):
    out = identify_languages(docs).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for i in (90, 91, 92, 93):
        assert by[i].lang_pred == "und" and by[i].score == 0
    assert {r.lang_pred for r in out} == {"en", "fr", "und"}


def test_code_switch_is_labelled_by_word():
    sample = [("en", "the thing of the word and the end".split())] * 20 + [("fr", "le mot de la fin et le début".split())] * 20
    model = langid.train(sample)
    words = "the thing of the word le mot de la fin".split()
    feats = [langid.features(w, model["lexicon"]) for w in words]
    scores = np.array([model["weights"][f].sum(axis=0) for f in feats])
    label = forward_backward(scores, model["moves"], np.array([0])).argmax(axis=1)
    assert [model["langs"][k] for k in label] == ["en"] * 5 + ["fr"] * 5


def test_quality_counts(docs, rows):
    want = Counter()
    for r in rows:
        text = r[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen = Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] >= 2 for k in range(3)}
        earlier, repeated = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                repeated += line in earlier
                earlier.add(line)
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        want[r[0], len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), repeated, len(covered), failed] += 1
    out = quality_rules(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == want
    assert not any(r.kept and r.base_failed for r in out)
    assert all(r.kept == (not r.base_failed and r.low <= r.log_perplexity <= r.high) for r in out)


def test_quality_rejects_rubble(spark):
    """Rubble that passes the base rules is rejected by its perplexity; labelled clean text is not."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    clean = docs.join(labels.filter("quality = 1"), "doc_id").filter("n_chars > 1000 and lang = 'en'").orderBy("doc_id").limit(20).collect()
    rubble = []
    for r in clean:
        words = r.text.split()
        rubble.append((-r.doc_id, " ".join(w + " ###" * (i % 2) for i, w in enumerate(words)), "en"))
    rows = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(rubble, "doc_id long, text string, lang string"))
    out = {r.doc_id: r for r in quality_rules(rows).collect()}
    passed = [-r.doc_id for r in clean if not out[-r.doc_id].base_failed]
    assert len(passed) > 10 and not any(out[i].kept for i in passed)
    share = {}
    for quality in (0, 1):
        own = [out[r.doc_id] for r in labels.filter(f"quality = {quality}").collect()]
        own = [r for r in own if not r.base_failed]
        share[quality] = sum(not r.kept for r in own) / len(own)
    assert share[0] > 0.7 and share[1] < 0.03, share


def test_quality_band_of_a_small_language(spark):
    """A language of 30 documents has a band of its own, which keeps its clean texts and rejects rubble."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1")
    clean = docs.join(labels, "doc_id", "left_semi").filter("lang = 'en' and length(text) > 1000").orderBy("doc_id").limit(30).collect()
    small = [(-r.doc_id, r.text, "small") for r in clean]
    rng = random.Random(2)
    noisy = lambda text: "".join(rng.choice("qxzjkvwy") if i % 25 == 0 else c for i, c in enumerate(text))
    rubble = [(-1_000_000 - r.doc_id, noisy(r.text), "small") for r in clean[:4]]
    rows = docs.unionByName(spark.createDataFrame(small + rubble, docs.schema))
    out = {r.doc_id: r for r in quality_rules(rows).collect()}
    passed = [out[i] for i, _, _ in small if not out[i].base_failed]
    noise = [out[i] for i, _, _ in rubble if not out[i].base_failed]
    assert len(passed) > 20 and sum(r.kept for r in passed) >= len(passed) - 2
    assert len(noise) > 2 and not any(r.kept for r in noise)


def test_kneser_ney(spark):
    """Counts by hand, probabilities that sum to one, and the textbook formula."""
    texts = ["the end of the thing.", "the thing, the end", "an end of it all, the thing"] * 3 + ["odd"]
    counted = count_grams(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)).toArrow()
    table = class_table()
    plain = Counter()
    for t in texts:
        padded = [0] * (ORDER - 1) + [int(table[ord(c)]) for c in t]
        for i in range(len(t)):
            plain[sum(c << (6 * k) for k, c in enumerate(reversed(padded[i : i + ORDER])))] += 1
    assert dict(zip(counted["key"].to_pylist(), counted["n"].to_pylist())) == plain
    model = KneserNey.estimated(counted["key"].to_numpy(), counted["n"].to_numpy())

    levels = [dict(plain)]
    for k in range(ORDER - 1, 0, -1):
        levels.append(Counter(key & ((1 << (6 * k)) - 1) for key in levels[-1]))
    cuts = [KneserNey.discounts(np.array(list(n.values()), float)) for n in levels]

    def p(key, level):
        if level == len(levels):
            return 1 / 64
        rest = p(key & ((1 << (6 * (ORDER - level - 1))) - 1), level + 1)
        own = {w: n for w, n in levels[level].items() if w >> 6 == key >> 6}
        if not own:
            return rest
        cut = lambda n: cuts[level][min(n, 3)]
        found = own.get(key, 0)
        return (max(found - cut(found), 0) if found else 0) / sum(own.values()) + sum(map(cut, own.values())) / sum(own.values()) * rest

    context = next(iter(plain)) >> 6 << 6
    keys = np.array([context + c for c in range(64)] + [123456 + c for c in range(3)], np.int32)
    got = np.exp(model.log_p(keys))
    assert np.allclose(got, [p(int(k), 0) for k in keys], rtol=1e-4)
    assert abs(got[:64].sum() - 1) < 1e-3


def test_grams_of_rare_characters():
    keys, real, starts, lengths = grams(["a😀", "", "é"], class_table())
    assert real.sum() == 3 and lengths.tolist() == [2, 0, 1] and len(starts) == 3
    assert keys.max() < 1 << 24


@pytest.mark.parametrize("block", [256, 2])
def test_jaccard_join(docs, rows, block, monkeypatch):
    monkeypatch.setattr(join, "BLOCK_SETS", block)
    out = near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == components(rows)


@pytest.mark.parametrize("block", [256, 5])
def test_jaccard_family(spark, block, monkeypatch):
    """One family of near copies on both sides of the threshold, and many strangers with a common passage."""
    monkeypatch.setattr(join, "BLOCK_SETS", block)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base, passage = [word() for _ in range(80)], [word() for _ in range(40)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(80)] = word()
        rows.append((i, " ".join(words)))
    for i in range(60, 100):
        rows.append((i, " ".join([word() for _ in range(rng.randint(1, 30))] + passage)))
    want = components(rows)
    assert 1 < len({w[2] for w in want if w[0] < 60}) < 60
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == want


def test_prefix_tree():
    rng = np.random.default_rng(3)
    for _ in range(25):
        base = [np.unique(rng.integers(0, 400, rng.integers(1, 120))).astype(np.uint64) for _ in range(3)]
        sets, seen = [], set()
        for _ in range(30):
            s = base[rng.integers(3)]
            s = np.unique(np.concatenate([s[rng.random(len(s)) > rng.choice([0, 0.03, 0.1, 0.2])], rng.integers(0, 400, rng.integers(0, 6)).astype(np.uint64)]))
            if len(s) and s.tobytes() not in seen:
                seen.add(s.tobytes())
                sets.append(s)
        tree = PrefixTree(sets)
        for p in sets:
            want = [i for i, q in enumerate(sets) if 100 * len(np.intersect1d(p, q)) >= 75 * len(np.union1d(p, q))]
            assert sorted(tree.links(p, 75)) == want


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(500, 500)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_empty(empty):
    assert identify_languages(empty).count() == 0
    assert quality_rules(empty).count() == 0
    assert near_duplicates(empty).count() == 0


def test_words_are_letters_only(spark):
    assert langid.words_of("½ ² ① x½y Ⅷ Été_2a") == ["x", "y", "été", "a"]
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("le mot de la fin", "fr"), ("the end of the word", "en")] * 10)]
    docs = spark.createDataFrame([*rows, (90, "½ ² ①", None)], "score long, text string, lang string")
    out = {r["score"]: r for r in identify_languages(docs, "score").collect()}
    assert out[90]["lang_pred"] == "und" and out[90]["_score"] == 0 and out[0]["_score"] > 0


def test_sample_is_bounded_in_all(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ALL", 12)
    rows = [(i, f"word number {i}", f"l{i % 40 if i % 3 else 0}") for i in range(600)]
    sample = langid.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert 0 < len(sample) <= 12 and "l0" in {lang for lang, _ in sample}


def test_null_and_empty_languages_have_bands_of_their_own(spark):
    rng = random.Random(5)
    words = "the of and in thing over word end".split()
    text = lambda k: " ".join(rng.choice(words) + rng.choice(["", "a", "x", "er"][:k]) for _ in range(60))
    rows = [(i, text(1), "") for i in range(30)] + [(100 + i, text(4), None) for i in range(30)]
    out = quality_rules(spark.createDataFrame(rows, "n_words long, text string, lang string"), "n_words").collect()
    assert len({(r["low"], r["high"]) for r in out}) == 2 and {r["_n_words"] for r in out} == {60}
