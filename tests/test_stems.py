import random

import duckdb

from bindings.evaluation import _stem_table
from tidemark.functions import stems, tokens
from tidemark.operators import evaluation
from tests.test_semantics import brute_lcs

# Word and stem as the published description and its known extensions give them.
KNOWN = """caresses caress, ponies poni, ties tie, caress caress, cats cat, feed feed, agreed agre, plastered plaster, bled bled,
motoring motor, sing sing, conflated conflat, troubled troubl, sized size, hopping hop, tanned tan, falling fall, hissing hiss,
fizzed fizz, failing fail, filing file, happy happi, sky sky, enjoy enjoy, cried cri, dies die, died die, relational relat, conditional condit,
rational ration, digitizer digit, radically radic, differently differ, vilely vile, analogously analog, vietnamization vietnam,
predication predic, operator oper, feudalism feudal, decisiveness decis, hopefulness hope, callousness callous, formality formal,
sensitivity sensit, sensibility sensibl, triplicate triplic, formative form, formalize formal, electricity electr, electrical electr,
hopeful hope, goodness good, hopefully hope, revival reviv, allowance allow, inference infer, airliner airlin, gyroscopic gyroscop,
adjustable adjust, defensible defens, irritant irrit, replacement replac, adjustment adjust, dependent depend, adoption adopt,
communism commun, activate activ, homologous homolog, effective effect, probate probat, rate rate, cease ceas, controller control,
roll roll, skies sky, dying die, news news, innings inning, proceed proceed, apology apolog, generally gener, rationally ration,
syzygy syzygi, yearly yearli, saying say, employed employ, order order, orders order, customers custom, 2024 2024, is is, was was, as as"""


def test_known_stems(spark):
    pairs = [p.split() for p in KNOWN.replace("\n", " ").split(",")]
    df = spark.createDataFrame([(w,) for w, _ in pairs] + [(None,), ("",)], "word string")
    got = {r["word"]: r["stem"] for r in stems.with_stem(df, "word").collect()}
    assert {w: got[w] for w, _ in pairs} == dict(pairs)
    assert got[None] is None and got[""] == ""


def test_words_of_one_stem_match(spark):
    df = spark.createDataFrame([(1, "counting the orders", "count the order"), (2, None, None), (3, "one", None)], "id int, p string, g string")
    for stem, whole in ((True, 1.0), (False, 0.0)):
        two = {r["id"]: r for r in evaluation.rouge2(df, "id", "p", "g", stem=stem).collect()}
        assert two[1]["rouge2_fmeasure"] == whole
        assert set(two) == {1, 2, 3} and two[2]["rouge2_fmeasure"] == two[3]["rouge2_fmeasure"] == 0.0
    long = {r["id"]: r for r in evaluation.rouge_l(df, "id", "p", "g").collect()}
    assert long[1]["rougel_fmeasure"] == 1.0 and set(long) == {1, 2, 3} and long[2]["rougel_recall"] == 0.0
    empty = df.limit(0)
    assert evaluation.rouge2(empty, "id", "p", "g").count() == evaluation.rouge_l(empty, "id", "p", "g").count() == 0


def test_common_subsequences_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(tokens, "CELLS", 40)
    rng = random.Random(5)
    pairs = [([rng.randrange(4) for _ in range(rng.randrange(n))], [rng.randrange(4) for _ in range(rng.randrange(n))]) for n in [1, 3, 9, 9, 9, 60] * 8]
    df = spark.createDataFrame(pairs, "a array<bigint>, b array<bigint>")
    got = df.select("a", "b", tokens.lcs_length()("a", "b").alias("n")).collect()
    assert len(got) == len(pairs) and all(r["n"] == brute_lcs(r["a"], r["b"]) for r in got)


def test_oracle_statement_gives_the_known_stems():
    pairs = [p.split() for p in KNOWN.replace("\n", " ").split(",")]
    con = duckdb.connect()
    con.execute("CREATE TABLE spoken AS SELECT unnest(?::VARCHAR[]) AS w", [[w for w, _ in pairs]])
    got = dict(con.execute(f"WITH {_stem_table('spoken')} SELECT w, s FROM stems").fetchall())
    assert got == dict(pairs)
