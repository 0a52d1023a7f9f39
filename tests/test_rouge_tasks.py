"""Words of ROUGE are dealt to tasks by their number."""

import pytest

from tidemark.operators import evaluation as ev


@pytest.mark.parametrize("score", [ev.rouge2, ev.rouge_l])
def test_rouge_deals_words_by_their_number(spark, score, monkeypatch):
    rows = [(i, f"select a{i} from t", "select a from t") for i in range(60)] + [(60, None, "x"), (61, "", None)]
    df = spark.createDataFrame(rows, "k long, p string, g string")
    want = {r.k: tuple(r)[1:] for r in score(df, "k", "p", "g").collect()}
    monkeypatch.setattr(ev, "TASK_WORDS", 4)  # 60 * 8 + 1 words
    out = score(df, "k", "p", "g")
    assert {r.k: tuple(r)[1:] for r in out.collect()} == want and len(want) == 62
    assert out.rdd.getNumPartitions() >= 121
