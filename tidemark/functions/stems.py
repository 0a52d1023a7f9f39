"""Porter stems of lower-case words, as column expressions.

A ``y`` that counts as a consonant (first letter, or after a vowel) is written ``Y`` while the
steps run; what precedes a suffix never changes, so the marks stay right to the end.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the published algorithm: suffix and what replaces it, by step.
STEP_1A = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = dict.fromkeys(
    ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"], ""
)
# Words with a stem of their own.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning",
    "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}

# How often a run of vowels is followed by a consonant, at least once or twice.
ONCE = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
TWICE = "^[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy]"
VOWEL = "[aeiouy]"
SHORT_END = "[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$"


def _cut(word: Column, n: Column | int) -> Column:
    return F.left(word, F.length(word) - n)


def _rewrite(word: Column, rules: Mapping[str, str], condition: str) -> Column:
    """The longest suffix of ``rules`` is replaced if what precedes it fulfils the condition."""
    suffix = F.regexp_extract(word, f"(?:{'|'.join(rules)})$", 0)
    rest = _cut(word, F.length(suffix))
    made = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
    return F.when((suffix != "") & rest.rlike(condition), F.concat(rest, F.element_at(made, suffix))).otherwise(word)


def _once_only(word: Column) -> Column:
    return word.rlike(ONCE) & ~word.rlike(TWICE)


def _past(word: Column) -> Column:
    """What precedes -ed or -ing, if it has a vowel; else null."""
    bare = F.regexp_extract(word, "^(.*)(?:ed|ing)$", 1)
    return F.when(bare.rlike(VOWEL), bare)


def _mended(bare: Column) -> Column:
    return (
        F.when(bare.rlike("(?:at|bl|iz)$"), F.concat(bare, F.lit("e")))
        .when(bare.rlike(r"([^aeiouy])\1$"), F.when(bare.rlike("[lsz]$"), bare).otherwise(_cut(bare, 1)))
        .when(_once_only(bare) & bare.rlike(SHORT_END), F.concat(bare, F.lit("e")))
        .otherwise(bare)
    )


def with_stem(df: DataFrame, word: str, stem: str = "stem", longer_than: int = 3) -> DataFrame:
    """Add the stem of each word; words up to ``longer_than`` letters stay.  Null gives null.

    Meant for a table of distinct words.  Each step is a projection of its own, so a step's
    result is made once however often the next one looks at it.
    """
    w = F.col(stem)
    steps = [
        F.regexp_replace(word, "(^|[aeiouy])y", "$1Y"),
        F.when(w.rlike("^.ies$"), _cut(w, 1)).otherwise(_rewrite(w, STEP_1A, "")),
        F.when(w.rlike("^.ied$"), _cut(w, 1))
        .when(w.rlike("ied$"), _cut(w, 2))
        .when(w.rlike("eed$"), F.when(_cut(w, 3).rlike(ONCE), _cut(w, 1)).otherwise(w))
        .when(_past(w).isNotNull(), _mended(_past(w)))
        .otherwise(w),
        F.when(w.rlike("..[yY]$") & _cut(w, 1).rlike("[^aeiouy]$"), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w),
        F.when(w.rlike("alli$") & _cut(w, 4).rlike(ONCE), _cut(w, 2)).otherwise(w),
        F.when(w.rlike("logi$"), F.when(_cut(w, 3).rlike(ONCE), _cut(w, 1)).otherwise(w)).otherwise(_rewrite(w, STEP_2, ONCE)),
        _rewrite(w, STEP_3, ONCE),
        F.when(w.rlike("ion$"), F.when(w.rlike("[st]ion$") & _cut(w, 3).rlike(TWICE), _cut(w, 3)).otherwise(w)).otherwise(
            _rewrite(w, STEP_4, TWICE)
        ),
        F.when(w.rlike("e$") & (_cut(w, 1).rlike(TWICE) | (_once_only(_cut(w, 1)) & ~_cut(w, 1).rlike(SHORT_END))), _cut(w, 1)).otherwise(w),
        F.when(w.rlike("ll$") & _cut(w, 1).rlike(TWICE), _cut(w, 1)).otherwise(w),
    ]
    own = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    out = df
    for step in steps:
        out = out.withColumn(stem, step)
    kept = F.when(F.length(word) <= longer_than, F.col(word))
    return out.withColumn(stem, F.coalesce(kept, F.element_at(own, F.col(word)), F.lower(w)))
