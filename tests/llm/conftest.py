import random

import pytest

#: Columns whose names operators use inside or add.
CLASHES = "k1 string, k2 string, keep_id string, kept string, group_size string, n_lines string, shard string, slot string, score string, id string, part string"
SCHEMA = f"doc_id long, text string, lang string, {CLASHES}"


def corpus(seed: int = 5) -> list[tuple]:
    """Small documents with copies, near copies, repeated lines, odd white space, nulls and one long text."""
    rng = random.Random(seed)
    vocabulary = {"en": "the of and in thing over word end".split(), "fr": "le la été où déjà mot fin çà".split()}
    lines = [" ".join(rng.choice(vocabulary["en"]) for _ in range(8)) for _ in range(6)]
    rows, texts = [], []
    for i in range(60):
        lang = rng.choice(["en", "fr"])
        words = [rng.choice(vocabulary[lang]) + rng.choice(["", "a", "x", "er", "."]) for _ in range(rng.randint(1, 90))]
        text = " ".join(words) + rng.choice(["", "\n" + rng.choice(lines), "\n  " + rng.choice(lines).upper() + " \n", "\t\x0b"])
        texts.append(text)
        rows.append((i, text, rng.choice([lang, lang, None])))
    for i in range(60, 75):  # near copies
        words = rng.choice(texts[:10]).split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), "en"))
    rows += [(80 + i, texts[3].replace(" ", rng.choice(["  ", "\n", " \t "])), "en") for i in range(5)]
    rows += [(None, texts[3], "en"), (None, "all of this stands alone", None), (90, None, "en"), (91, "", None), (92, " \n\t ", "fr"), (93, "12 34 !!", "en")]
    rows += [(7, texts[7], "en"), (7, texts[7], "en")]  # repeated rows
    rows += [(95, "Licensed under CC BY-NC 4.0.\nAll rights\nreserved. GNU General Public License", "en"), (96, "x" * 200_000 + " " + "long words here " * 3000, "en")]
    return [(*r, *["c"] * 11) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
