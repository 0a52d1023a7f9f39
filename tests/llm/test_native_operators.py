"""Exact dedup, line dedup, license scan and sharding against plain versions."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from plain_versions import LOWER, SPACES
from pyspark.sql import functions as F

from tidemark.llm import license_scan as licenses
from tidemark.llm import line_dedup as lines_
from tidemark.llm import sharding
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.license_scan import license_scan
from tidemark.llm.line_dedup import line_dedup


def squeeze(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup(docs, rows):
    got = exact_dedup(docs, with_digest=True)
    assert len(got.columns) == len(set(got.columns)) and {"k1", "text", "keep_id"} <= set(got.columns)
    groups = defaultdict(list)
    for r in rows:
        groups[squeeze(r[1])].append(r[0])
    want = Counter()
    for r in rows:
        ids = groups[squeeze(r[1])]
        keep = min((i for i in ids if i is not None), default=None)
        want[r[0], r[1], keep, len(ids), r[0] == keep, hashlib.sha256(squeeze(r[1]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.text, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()) == want


@pytest.mark.parametrize("batches", [1, 5])
def test_line_dedup(docs, rows, batches, monkeypatch):
    monkeypatch.setattr(lines_, "FANOUT", 2)
    got = line_dedup(docs, batches=batches)
    key = lambda line: line.strip(SPACES).translate(LOWER)
    held = defaultdict(list)
    for n, r in enumerate(rows):
        for k in {key(x) for x in (r[1] or "").split("\n")}:
            if len(k) >= 20:
                held[k].append(r[0])
    last = {k: max((i for i in v if i is not None), default=None) for k, v in held.items() if len(v) >= 3}
    want = Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == r[0]]
        want[r[0], len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    assert sum(w[2] > 0 for w in want) > 3
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == want


def test_line_dedup_of_other_ids(spark):
    line = "a line that is long enough to count"
    rows = [(f"id-{i:03d}", f"{line}\nown line of document number {i}") for i in range(40)]
    for cast in ("doc_id", "decimal(20,3)", "binary"):
        ids = F.col("doc_id") if cast == "doc_id" else F.substring("doc_id", 4, 3).cast(cast)
        out = line_dedup(spark.createDataFrame(rows, "doc_id string, text string").withColumn("doc_id", ids), batches=5)
        kept = [r["doc_id"] for r in out.filter("n_dropped = 0").collect()]
        assert len(kept) == 1 and kept[0] == out.agg(F.max("doc_id")).first()[0]


def test_line_runs_compact(spark):
    runs = lines_.LineRuns(spark, fanout=2)
    for i in range(5):
        runs.add(spark.createDataFrame([(k, k, 1, 100 - i) for k in range(i, 10)], "a long, b long, docs long, last long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    got = {r.a: (r.docs, r["last"]) for r in runs.merged(runs.runs()).collect()}
    assert got == {k: (min(k, 4) + 1, 100) for k in range(10)}
    names = runs.runs()
    runs.close()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_license_scan(docs, rows):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = Counter()
    for r in rows:
        text = (r[1] or "").translate(LOWER)
        words = word.findall(text)
        places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        best, labels = 0.0, {x for _, x in places}
        for line in text.split("\n"):
            held = set(word.findall(line))
            for label, template in licenses.TEMPLATES.items():
                tokens = set(template.split())
                if len(tokens & held) >= licenses.THRESHOLD * len(tokens):
                    labels.add(label)
                    best = max(best, len(tokens & held) / len(tokens))
        own = ",".join(sorted({x for _, x in places}))
        starts = [i for i, _ in places]
        want[r[0], len(words), len(places), min(starts, default=None), max(starts, default=None), own, ",".join(sorted(labels)), 1.0 if places else best] += 1
    assert any("cc-by-nc-4.0" in w[6] and w[2] == 3 for w in want)
    assert Counter(tuple(r) for r in license_scan(docs).collect()) == want


def test_license_notices_wrap(spark):
    """A notice is found wherever its lines end and however they are led in; scattered words are not."""
    texts, want = [], []
    for label, template in licenses.TEMPLATES.items():
        words = template.split()
        for cut in range(1, len(words)):
            for before in (0, 5, 8, 9, 30):
                lead = " ".join(["word"] * before)
                texts.append(f"{lead}\n * {' '.join(words[:cut])}\n * {' '.join(words[cut:])}\nmore")
                want.append(label)
        texts.append((" " + "word " * 24).join(words))
        want.append(None)
    out = license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert len(out) == len(texts)
    for r in out:
        assert (want[r.doc_id] in r.labels.split(",") and r.score == 1) if want[r.doc_id] else r.score == 0, texts[r.doc_id]


def test_hypergeometric_is_exact(spark):
    for good, bad, n in ((7, 5, 4), (40, 60, 30), (3, 0, 2), (0, 4, 3), (1, 200, 100), (300, 2, 250)):
        us = [(i + 0.5) / 400 for i in range(400)]
        df = spark.createDataFrame([(u,) for u in us], "u double").select(
            "u", sharding.hypergeometric(F.col("u"), F.lit(float(good)), F.lit(float(bad)), F.lit(float(n))).alias("k")
        )
        low, high = max(0, n - bad), min(good, n)
        weights = [math.comb(good, k) * math.comb(bad, n - k) for k in range(low, high + 1)]
        for u, k in df.collect():
            at, total = low, 0
            while at < high and total + weights[at - low] <= u * sum(weights):
                total += weights[at - low]
                at += 1
            assert k == at


def test_matrix_margins(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 3)
    sizes = [(p, (p * 7) % 23) for p in range(11)]
    total = sum(n for _, n in sizes)
    capacities = [total // 4 + (j < total % 4) for j in range(4)]
    got = {r.part: r.counts for r in sharding.communication_matrix(spark.createDataFrame(sizes, "part long, n long"), capacities, 3).collect()}
    assert {p: sum(c) for p, c in got.items()} == dict(sizes)
    assert [sum(c[j] for c in got.values()) for j in range(4)] == capacities


@pytest.mark.parametrize("run", [200_000, 4])
def test_shards(docs, rows, run, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", run)
    out = sharding.hypergeometric_shards(docs, 4).collect()
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = sorted(map(len, slots.values()))
    assert len(sizes) == 4 and sizes[-1] - sizes[0] <= 1
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r[0], r[1]) for r in rows)


def test_shuffle_is_uniform(spark):
    """Each row is in each shard about equally often over seeds, whatever its partition."""
    rows = spark.range(40).repartition(3)
    seen = Counter()
    for seed in range(24):
        seen.update((r.id, r.shard) for r in sharding.hypergeometric_shards(rows, 2, seed).collect())
    assert all(abs(seen[i, 0] - 12) <= 10 for i in range(40))
    half = sum(seen[i, 0] for i in range(20))
    assert abs(half - 240) < 60


def test_more_shards_than_rows(spark):
    out = sharding.hypergeometric_shards(spark.range(3), 5).collect()
    assert sorted((r.shard, r.slot) for r in out) == [(0, 0), (1, 0), (2, 0)]


def test_empty(empty):
    assert exact_dedup(empty).count() == 0
    assert line_dedup(empty).count() == 0
    assert license_scan(empty).count() == 0
    assert sharding.hypergeometric_shards(empty).count() == 0
