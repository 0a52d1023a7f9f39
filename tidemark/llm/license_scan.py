"""License scan: exact set-similarity join of text blocks with license templates.

A block is a window of consecutive words, wherever lines end; a template is a set of words.  A
window is one and a half times as long as the longest template, and windows overlap so that each
passage of a template's length lies within one.  A pair is a match when the block holds at least
``threshold`` of the template's words.  The join is exact and avoids comparing all pairs:

* tokens have one global order, by the number of blocks that hold them (rarest first), counted
  over all documents;
* prefix filter: a block with ``need`` of a template's ``size`` words holds one of the first
  ``size - need + 1`` of them in that order, so only these are joined on;
* length filter: a block with fewer than ``need`` template words cannot match;
* positional filter: a match at position i of the template and j of the block leaves at most
  ``1 + min(rest of template, rest of block)`` common words.

Blocks are reduced to the words that occur in templates.  The template index has at most one row
per template word, which bounds what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, let, row_keys, text_or_empty
from tidemark.session import materialise

#: Words are runs of ASCII letters and digits and of all characters beyond ASCII; this separates them.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: License notices, by label.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "mit": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "gpl-3.0": "licensed under the gnu general public license version 3",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "mpl-2.0": "subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
#: Share of a template's words that a block has to hold.
THRESHOLD = 0.9


def needed(size: int, threshold: float) -> int:
    """Smallest overlap that is at least ``threshold`` of ``size``."""
    return next(n for n in range(1, size + 1) if n >= threshold * size - 1e-9)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATOR, -1), lambda w: w != "")


def window_sizes(templates: dict[str, str]) -> tuple[int, int]:
    """Words in a window, and from one window's start to the next."""
    longest = max(len(t.split()) for t in templates.values())
    width = -(-3 * longest // 2)
    return width, width - longest + 1


def windows(words: Column, vocabulary: list[str], width: int, stride: int, least: int) -> Column:
    """``(no, tokens)`` of each window with ``least`` or more distinct words of ``vocabulary``."""

    def of_document(ws: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(ws) - (width - stride + 1), F.lit(0)), F.lit(stride))
        found = F.transform(starts, lambda at: F.struct(at.alias("no"), F.array_distinct(F.array_compact(F.slice(ws, at + 1, width))).alias("tokens")))
        return F.filter(found, lambda b: F.size(b["tokens"]) >= least)

    # words of no template become null once, not in each window
    return let(F.transform(words, lambda w: F.when(w.isin(vocabulary), w)), of_document)


def phrase_places(words: Column, phrases: dict[str, str]) -> Column:
    """``(at, label)`` of each place where a phrase's words stand consecutively."""

    def of_phrase(ws: Column, parts: list[str], label: str) -> Column:
        def here(i: Column) -> Column:
            test = F.get(ws, i) == parts[0]
            for k in range(1, len(parts)):
                test = test & (F.get(ws, i + k) == parts[k])
            return test

        starts = F.when(F.size(ws) >= len(parts), F.sequence(F.lit(0), F.size(ws) - len(parts))).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(starts, here), lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))

    def any_phrase(text: Column) -> Column:
        return F.array_max(F.array(*[F.contains(text, F.lit(f" {p} ")) for p in phrases]))

    def places(ws: Column) -> Column:
        none = F.array().cast("array<struct<at:bigint,label:string>>")
        found = F.concat(*[of_phrase(ws, p.split(), label) for p, label in phrases.items()])
        return F.when(let(F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" ")), any_phrase), found).otherwise(none)

    return let(words, places)


def template_matches(blocks: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """``(k1, k2, template, containment)`` for all matches in ``blocks (k1, k2, no, tokens)``.

    ``tokens`` are the distinct template words of a block.  The result has a row per block and
    template that match.
    """
    spark = blocks.sparkSession
    sets = {label: sorted(set(text.split())) for label, text in templates.items()}
    rows = [(label, token, len(s), needed(len(s), threshold)) for label, s in sets.items() for token in s]
    listed = spark.createDataFrame(rows, "template string, token string, size int, need int")
    # one global order over all template words: rarest in the corpus first
    counted = blocks.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    vocabulary = listed.select("token").distinct().join(counted, "token", "left")
    order = materialise(vocabulary.select("token", F.row_number().over(Window.orderBy(F.coalesce("n", F.lit(0)), "token")).alias("rank")))
    ranked = listed.join(F.broadcast(order), "token")
    place = Window.partitionBy("template").orderBy("rank")
    index = materialise(
        ranked.withColumn("i", F.row_number().over(place) - 1)
        .withColumn("all", F.sort_array(F.collect_list("rank").over(Window.partitionBy("template"))))
        .filter(F.col("i") <= F.col("size") - F.col("need"))
        .select("rank", "template", "i", "size", "need", "all")
    )
    ranks = F.from_json(
        F.lit("{}"), "map<string,int>"
    ) if not rows else F.map_from_entries(F.array(*[F.struct(F.lit(r["token"]), F.lit(r["rank"])) for r in order.collect()]))
    ordered = blocks.select("k1", "k2", "no", let(ranks, lambda m: F.sort_array(F.transform("tokens", lambda t: F.element_at(m, t)))).alias("ordered"))
    probes = ordered.select("k1", "k2", "no", "ordered", F.size("ordered").alias("width"), F.posexplode("ordered").alias("j", "rank"))
    found = (
        probes.join(F.broadcast(index), "rank")
        .filter(F.col("width") >= F.col("need"))
        .filter(1 + F.least(F.col("size") - F.col("i") - 1, F.col("width") - F.col("j") - 1) >= F.col("need"))
        .withColumn("common", F.size(F.array_intersect("ordered", "all")))
        .filter(F.col("common") >= F.col("need"))
    )
    # a pair may meet in several prefix tokens
    return found.select("k1", "k2", "no", "template", (F.col("common") / F.col("size")).alias("containment")).distinct()


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES,
    templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of ``docs``: id, word count, phrase places, labels, score.

    ``score`` is 1 where a phrase occurs, else the best containment of a matching template,
    else 0.  Null or empty text has no words: counts 0, places null, labels empty.  A null id
    is passed on; repeated rows get the same result each.  Other columns are not used.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    one, two = row_keys(rows, "id", "text")
    vocabulary = sorted({w for t in templates.values() for w in t.split()})
    least = min(needed(len(set(t.split())), threshold) for t in templates.values())
    split = rows.select("id", one.alias("k1"), two.alias("k2"), words_of(ascii_lower(text_or_empty("text"))).alias("words"))
    blocks = windows(F.col("words"), vocabulary, *window_sizes(templates), least)
    scanned = materialise(
        split.select(
            "id", "k1", "k2", let(F.col("words"), lambda ws: F.struct(F.size(ws).cast("long").alias("n"), phrase_places(ws, phrases).alias("places"))).alias("base"),
            blocks.alias("blocks"),
        )
    )
    matches = template_matches(scanned.select("k1", "k2", F.explode("blocks").alias("b")).select("k1", "k2", "b.no", "b.tokens"), templates, threshold)
    per_doc = matches.groupBy("k1", "k2").agg(F.collect_set("template").alias("found"), F.max("containment").alias("best"))
    places = F.col("base.places")
    own = F.array_sort(F.array_distinct(places["label"]))
    return scanned.join(per_doc, ["k1", "k2"], "left").select(
        F.col("id").alias(id_col),
        F.col("base.n").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places["at"]).alias("first_word"),
        F.array_max(places["at"]).alias("last_word"),
        F.array_join(own, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size(places) > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
