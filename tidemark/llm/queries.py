"""The operators bound to the test tables, and DuckDB SQL for the results that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import license_scan as licenses
from tidemark.llm.bitplanes import read_tokens, write_tokens
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.hmm import hmm_scores
from tidemark.llm.jaccard_join import near_duplicates
from tidemark.llm.langid import identify_languages
from tidemark.llm.lexical import lexical_search
from tidemark.llm.license_scan import license_scan
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.nbest import encode_nbest
from tidemark.llm.packing import pack_powers_of_two
from tidemark.llm.quality import quality_rules
from tidemark.llm.sharding import hypergeometric_shards
from tidemark.llm.spelling import spelling_variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, tables: tuple[str, ...] = ("documents",)):
    def bind(fn: Callable[..., DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])
        if oracle:
            ORACLES[name] = oracle.strip()
        return fn

    return bind


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


# --- 1: packing -------------------------------------------------------------------------------


@query("op1_packing")
def _(docs):
    out = pack_powers_of_two(docs, vocabulary("byte_bpe_50k.json"), window=1024, end_id=0)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


# --- 2: license scan --------------------------------------------------------------------------

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _template_values() -> str:
    rows = []
    for label, text in licenses.TEMPLATES.items():
        tokens = sorted(set(text.split()))
        listed = ", ".join(f"'{t}'" for t in tokens)
        rows.append(f"('{label}', [{listed}], {licenses.needed(len(tokens), licenses.THRESHOLD)})")
    return ", ".join(rows)


def _phrase_values() -> str:
    return ", ".join(f"('{label}', [{', '.join(repr(w) for w in phrase.split())}])" for phrase, label in licenses.PHRASES.items())


@query(
    "op2_license_scan",
    f"""
WITH lowered AS (SELECT doc_id, {_LOWER} AS t FROM documents),
worded AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORDS}') AS ws FROM lowered),
phrases(label, parts) AS (VALUES {_phrase_values()}),
places AS (
  SELECT doc_id, label, place FROM (SELECT doc_id, ws, unnest(range(len(ws))) AS place FROM worded), phrases
  WHERE ws[place + 1 : place + len(parts)] = parts
),
base AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list(DISTINCT label)) AS own
  FROM places GROUP BY doc_id
),
templates(label, tokens, need) AS (VALUES {_template_values()}),
blocks AS (SELECT doc_id, regexp_extract_all(line, '{_WORDS}') AS ws FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM lowered)),
found AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(common / len(tokens)) AS best
  FROM (SELECT doc_id, label, tokens, need, len(list_filter(tokens, lambda x: list_contains(ws, x))) AS common FROM blocks, templates)
  WHERE common >= need GROUP BY doc_id
)
SELECT w.doc_id, len(w.ws) AS n_words, coalesce(b.n_base, 0) AS n_base, b.first_word, b.last_word,
       coalesce(array_to_string(b.own, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.own, []), coalesce(f.labels, [])))), ','), '') AS labels,
       CASE WHEN b.n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(f.best, 0.0)::DOUBLE END AS score
FROM worded w LEFT JOIN base b ON w.doc_id = b.doc_id LEFT JOIN found f ON w.doc_id = f.doc_id
""",
)
def _(docs):
    return license_scan(docs)


# --- 3: token-id files ------------------------------------------------------------------------


@query("op3_bit_planes")
def _(docs):
    path = write_tokens(docs, vocabulary("word_bpe_49k.json"), end_id=1)
    return read_tokens(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


# --- 4: line dedup ----------------------------------------------------------------------------


@query(
    "op4_line_dedup",
    rf"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
),
repeated AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.last AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
)
def _(docs):
    out = line_dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


# --- 5: language identification --------------------------------------------------------------


@query("op5_language_id")
def _(docs):
    return identify_languages(docs).drop("k1", "k2")


# --- 6: sharding ------------------------------------------------------------------------------


@query("op6_sharding")
def _(docs):
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = hypergeometric_shards(rows, 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# --- 7: n-gram Jaccard join -------------------------------------------------------------------


@query("op7_ngram_jaccard")
def _(docs):
    return near_duplicates(docs).drop("k1", "k2")


# --- 8: n-best segmentation -------------------------------------------------------------------


@query("op8_nbest_pieces")
def _(docs):
    out = encode_nbest(docs, vocabulary("piece_bpe_32k.model"), best=4)
    return out.select("doc_id", "rank", "score", "n_pieces", F.crc32("ids").alias("ids_crc32"), "round_trip")


# --- 9: exact dedup ---------------------------------------------------------------------------


@query(
    "op9_exact_dedup",
    r"""
WITH hashed AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM hashed WINDOW w AS (PARTITION BY text_sha256)
""",
)
def _(docs):
    out = exact_dedup(docs.select("doc_id", "text"), with_digest=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


# --- 10: quality rules ------------------------------------------------------------------------


@query("op10_quality_rules")
def _(docs):
    return quality_rules(docs).drop("k1", "k2")


# --- 11: ranked lexical search ----------------------------------------------------------------

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query(
    "op11_lexical_search",
    f"""
WITH worded AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
sizes AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM worded),
items AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
tfs AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM worded)
  WHERE term IN (SELECT term FROM items) GROUP BY ALL
),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), sizes
),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM items JOIN tfs USING (term) JOIN weights USING (term), sizes GROUP BY ALL
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
""",
    ("documents", "benchmark"),
)
def _(docs, items):
    return lexical_search(docs, items, 20)


# --- 12: spelling variants --------------------------------------------------------------------


@query("op12_spelling_variants")
def _(docs):
    return spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n")


# --- 13: language-model scores ----------------------------------------------------------------


@query("op13_hmm_scores")
def _(docs):
    return hmm_scores(docs)
