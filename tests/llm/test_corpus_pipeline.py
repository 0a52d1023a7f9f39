"""The pipeline's stages against plain versions of their decisions, on whole small tables."""

import re
from collections import Counter

import corpus_pipeline
import pytest
from plain_versions import components

from tidemark.llm.langid import identify_languages
from tidemark.llm.packing import piece_lengths
from tidemark.llm.quality import quality_rules
from tidemark.session import materialise

SF = "/root/testdata/sf0.001"


def kept(df):
    return Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output of every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        after = materialise(stage(spark, docs, SF))
        out.append((docs, after))
        docs = after
    return out


def test_stages_keep_columns_and_rows(steps):
    for before, after in steps[:-1]:
        assert after.columns == before.columns
        assert not kept(after) - kept(before)


def test_quality_and_language(steps):
    before, after = steps[0]
    good = {r.doc_id for r in quality_rules(before).collect() if r.kept}
    assert {r.doc_id for r in after.collect()} == good and len(good) < before.count()
    before, after = steps[1]
    good = {r.doc_id for r in identify_languages(before).collect() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_AGREEMENT}
    assert {r.doc_id for r in after.collect()} == good


def test_exact_and_near_copies(steps):
    before, after = steps[2]
    first = {}
    for r in sorted(before.collect(), key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert {r.doc_id for r in after.collect()} == set(first.values())
    before, after = steps[3]
    want = {w[0] for w in components([(r.doc_id, r.text) for r in before.collect()]) if w[0] == w[2]}
    assert {r.doc_id for r in after.collect()} == want


def test_packing(steps):
    before, after = steps[4]
    pieces = after.groupBy("doc_id", "doc_tokens").sum("length").collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in before.collect()}
    assert all(r[2] == r.doc_tokens for r in pieces)
    assert after.count() == sum(len(piece_lengths(r.doc_tokens, 1024)) for r in pieces)


def test_run(spark, steps):
    want = kept(steps[-1][1].drop("sequence_id", "ids"))
    assert kept(corpus_pipeline.run(spark, SF).drop("sequence_id", "ids")) == want


def test_stages_take_awkward_rows(spark, docs, empty):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() > 0 or name == "quality_rules"
        assert stage(spark, empty, SF).count() == 0


def test_copies_keep_rows_as_they_came(spark):
    """Columns named like the operators' own keep their values; of repeated rows one stays."""
    names = ["keep_id", "kept", "group_size", "text_sha256", "component_id", "n_shingles", "k1", "row", "full"]
    schema = "doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in names)
    text = "one two three four five six seven eight"
    rows = [(1, text), (1, text), (2, text), (3, "other words are here and stay as they are"), (3, "other words are here and stay as they are")]
    rows += [(None, "x y"), (None, "x  y"), (4, "a b c"), (5, None), (6, ""), (7, "unlike all of the others in each and every word")]
    docs = spark.createDataFrame([(*r, "en", *["mine"] * len(names)) for r in rows], schema)
    stages = dict(corpus_pipeline.STAGES)
    out = stages["exact_dedup"](spark, docs, SF)
    assert out.schema == docs.schema
    got = Counter(r.doc_id for r in out.collect())
    assert got == Counter([1, 3, None, 4, 5, 7]) and all(set(r[3:]) == {"mine"} for r in out.collect())
    out = stages["ngram_jaccard"](spark, docs, SF)
    assert out.schema == docs.schema and all(set(r[3:]) == {"mine"} for r in out.collect())
    assert Counter(r.doc_id for r in out.collect()) == Counter([1, 3, None, None, 4, 5, 6, 7])
