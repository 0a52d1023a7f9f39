"""Corpus curation on a text-to-SQL corpus derived from events, and on documents.

``RAW`` is the raw corpus; ``ENG`` adds the prompt text and a three-way split in which val
and test are disjoint by construction (their prompts carry the split's own suffix), while
train holds copies of both.
"""

from pyspark.sql import functions as F

from bindings.evaluation import validity_sql
from bindings.registry import register
from bindings.statements import N, QUESTION, SQL, statement_log
from tidemark.operators import corpus, drift, leakage

# Class by position of the statement pattern: one class is large, one is small.
_CLASS = (
    f"CASE WHEN event_id % {N} IN (0, 1, 12, 13, 14, 15, 16, 18, 20, 21) THEN 'basic' WHEN event_id % {N} IN (2) THEN 'single join' "
    f"WHEN event_id % {N} IN (3, 4) THEN 'multiple_joins' WHEN event_id % {N} IN (5, 17) THEN 'set operations' "
    f"WHEN event_id % {N} IN (6, 7, 22) THEN 'window functions' WHEN event_id % {N} = 8 THEN 'aggregation' "
    f"WHEN event_id % {N} IN (9, 10, 11) THEN 'subqueries' END"
)
_CONTEXT = (
    "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 'CREATE TABLE ' || event_type || ' (id INT); INSERT INTO ' || event_type "
    "|| ' (id) VALUES (' || user_id || ');' ELSE 'CREATE TABLE ' || event_type || ' (id INT);' END"
)
_SPLIT2 = "CASE WHEN event_id % 10 = 9 THEN 'test' ELSE 'train' END"
_SPLIT3 = "CASE WHEN event_id % 10 = 9 THEN 'test' WHEN event_id % 10 = 8 THEN 'val' ELSE 'train' END"
# the val and test prompts differ by their suffix; some train rows carry the same suffixes
_SUFFIX = "CASE WHEN event_id % 10 = 9 OR event_id % 30 = 4 THEN ' (t)' WHEN event_id % 10 = 8 OR event_id % 30 = 3 THEN ' (v)' ELSE '' END"
RAW = (
    f"SELECT event_id AS row_id, {_SPLIT2} AS split, {QUESTION} AS sql_prompt, {_CONTEXT} AS sql_context, {SQL} AS sql, {_CLASS} AS sql_complexity FROM events"
)
TEXT = (
    "'translate English to SQL: ' || CASE WHEN sql_context IS NOT NULL THEN 'context: ' || sql_context || chr(10) || chr(10) ELSE '' END || 'query: ' || sql_prompt"
)
ENG = (
    f"SELECT event_id AS row_id, {_SPLIT3} AS split, replace({TEXT.replace('sql_context', '(' + _CONTEXT + ')').replace('sql_prompt', '(' + QUESTION + ')')}, '', '') || {_SUFFIX} AS input_text, "
    f"{SQL} AS sql, {_CLASS} AS sql_complexity FROM events"
)


def raw(t):
    return t.events.select(
        F.col("event_id").alias("row_id"), F.expr(_SPLIT2).alias("split"), F.expr(QUESTION).alias("sql_prompt"),
        F.expr(_CONTEXT).alias("sql_context"), F.expr(SQL).alias("sql"), F.expr(_CLASS).alias("sql_complexity"),
    )


def engineered(t):
    text = F.concat(corpus.input_text(F.expr(_CONTEXT), F.expr(QUESTION)), F.expr(_SUFFIX))
    return t.events.select(
        F.col("event_id").alias("row_id"), F.expr(_SPLIT3).alias("split"), text.alias("input_text"),
        F.expr(SQL).alias("sql"), F.expr(_CLASS).alias("sql_complexity"),
    )


_V = validity_sql("sql")


@register(
    "corpus_sql_validity",
    f"""SELECT row_id, f IS NULL AS is_valid, split_part(f, ':', 1) AS error_type, f AS error_message FROM (SELECT row_id, {_V} AS f FROM ({RAW}) r) v""",
)
def _(t):
    return corpus.flag_sql(raw(t), "sql").select("row_id", "is_valid", "error_type", "error_message")


@register(
    "corpus_anomaly_report",
    f"""SELECT split AS source, row_id AS row_index, sql AS sql_query, f AS error_message, split_part(f, ':', 1) AS error_type
    FROM (SELECT *, {_V} AS f FROM ({RAW}) r) v WHERE f IS NOT NULL""",
)
def _(t):
    return corpus.anomalies(raw(t), "sql", "row_id", "split")


@register(
    "corpus_schema_check",
    f"""SELECT * FROM (
    SELECT 'null_value' AS check_name, 'sql_context' AS column_name, count(*) FILTER (sql_context IS NULL) AS n_rows FROM ({RAW}) r
    UNION ALL SELECT 'null_value', 'sql_complexity', count(*) FILTER (sql_complexity IS NULL) FROM ({RAW}) r
    UNION ALL SELECT 'empty_value', 'sql', count(*) FILTER (trim(sql) = '') FROM ({RAW}) r
    UNION ALL SELECT 'missing_text', 'sql_prompt', count(*) FILTER (NOT contains(sql_prompt, 'users')) FROM ({RAW}) r
    UNION ALL SELECT 'missing_column', 'db_id', count(*) FROM ({RAW}) r
    UNION ALL SELECT 'wrong_type', 'row_id', count(*) FROM ({RAW}) r
    UNION ALL SELECT 'column_order', 'row_id,split,sql_prompt,sql_context,sql,sql_complexity', count(*) FROM ({RAW}) r) c
    WHERE n_rows > 0""",
)
def _(t):
    return corpus.schema_violations(
        raw(t),
        {"sql_prompt": "string", "sql_context": "string", "sql": "string", "sql_complexity": "string", "row_id": "string", "db_id": "string"},
        critical=["sql_prompt", "sql_context", "sql", "sql_complexity"],
        non_empty=["sql_prompt", "sql"],
        must_contain={"sql_prompt": "users"},
        exact_order=True,
    )


def _stats_sql(source, col, by, percents, extra):
    ps = ", ".join(f"quantile_cont(length({col}), {p}) AS {n}" for n, p in percents.items())
    return f"""SELECT {by}, '{col}' AS column_name, count({col}) AS n_values, count(*) - count({col}) AS null_count, {extra}
      count(DISTINCT {col}) AS unique_count, min(length({col})) AS len_min, max(length({col})) AS len_max, avg(length({col})) AS len_mean,
      stddev_samp(length({col})) AS len_std, {ps} FROM {source} GROUP BY {by}"""


_FULL = {"len_median": 0.5, "len_p25": 0.25, "len_p75": 0.75, "len_p90": 0.9, "len_p95": 0.95, "len_p99": 0.99}
_LITE = {"len_median": 0.5, "len_p90": 0.9, "len_p99": 0.99}
_R = {"len_mean": 4, "len_std": 4, **{k: 4 for k in _FULL}}


@register(
    "corpus_text_stats",
    _stats_sql("documents", "text", "lang", _FULL, "(count(*) - count(text)) * 1.0::DOUBLE / count(*) AS null_rate,"),
    {**_R, "null_rate": 6},
)
def _(t):
    return corpus.text_stats(t.documents, ["text"], ["lang"])


_DUP = "count(*) - count(DISTINCT coalesce({c}, chr(0))) AS duplicate_count,"


@register(
    "corpus_text_stats_lite",
    " UNION ALL ".join(_stats_sql(f"({ENG}) e", c, "split", _LITE, _DUP.replace("{c}", c)) for c in ("input_text", "sql")),
    {k: v for k, v in _R.items() if k in ("len_mean", "len_std", *_LITE)},
)
def _(t):
    return corpus.text_stats_lite(engineered(t), ["input_text", "sql"])


@register(
    "corpus_class_distribution",
    f"""SELECT split, sql_complexity, count(*) AS n_rows, count(*) / sum(count(*)) OVER (PARTITION BY split) AS share FROM ({ENG}) e
    WHERE sql_complexity IS NOT NULL GROUP BY split, sql_complexity""",
    {"share": 9},
)
def _(t):
    return corpus.class_distribution(engineered(t), "sql_complexity", ["split"])


@register(
    "corpus_quality_counts",
    f"""SELECT split, CAST(sum(n - 1) AS BIGINT) AS duplicates, CAST(sum(ep) AS BIGINT) AS empty_sql_prompt, CAST(sum(es) AS BIGINT) AS empty_sql FROM (
    SELECT split, sql_prompt, sql, count(*) AS n, count(*) FILTER (trim(sql_prompt) = '') AS ep, count(*) FILTER (trim(sql) = '') AS es
    FROM ({RAW}) r GROUP BY ALL) g GROUP BY split""",
)
def _(t):
    return corpus.quality(raw(t), ["sql_prompt", "sql"])


@register(
    "corpus_context_rate",
    f"SELECT split, avg(CASE WHEN contains(input_text, 'context:') THEN 1.0::DOUBLE ELSE 0 END) AS rate FROM ({ENG}) e GROUP BY split",
    {"rate": 9},
)
def _(t):
    return corpus.contains_rate(engineered(t), "input_text", "context:")


@register(
    "corpus_split_sizes",
    f"""SELECT count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test, count(*) AS total,
    count(*) FILTER (split = 'train') / count(*) FILTER (split = 'val') AS train_val_ratio FROM ({ENG}) e""",
    {"train_val_ratio": 9},
)
def _(t):
    return corpus.split_sizes(engineered(t))


_COUNTS = f"(SELECT sql_complexity AS c, count(*) AS n FROM ({RAW}) r WHERE sql_complexity IS NOT NULL GROUP BY 1)"


@register(
    "corpus_imbalance",
    f"""WITH k AS {_COUNTS}, a AS (SELECT * FROM k ORDER BY n DESC, c LIMIT 1), b AS (SELECT * FROM k ORDER BY n, c LIMIT 1)
    SELECT a.c AS max_class, a.n AS max_count, b.c AS min_class, b.n AS min_count, a.n / b.n AS imbalance_ratio,
    CASE WHEN a.n / b.n >= 10 THEN 'SEVERE' WHEN a.n / b.n >= 5 THEN 'MODERATE' WHEN a.n / b.n >= 2 THEN 'MILD' ELSE 'None' END AS bias_level,
    a.n / b.n >= 2 AS bias_detected FROM a, b""",
    {"imbalance_ratio": 6},
)
def _(t):
    return corpus.imbalance(raw(t), "sql_complexity")


@register(
    "corpus_minority_classes",
    f"""SELECT c AS sql_complexity, n AS n_rows, round(n * 100.0::DOUBLE / (SELECT count(*) FROM ({RAW}) r), 2) AS pct FROM {_COUNTS} k WHERE n < 0.5 * (SELECT max(n) FROM {_COUNTS} m)""",
)
def _(t):
    return corpus.minority_classes(raw(t), "sql_complexity")


_LISTED = ", ".join(f"('{c}')" for c in corpus.SYNTHETIC_CLASSES)


@register(
    "corpus_balance_targets",
    f"""SELECT l.c AS sql_complexity, (SELECT max(n) FROM {_COUNTS} m) - coalesce(k.n, 0) AS needed FROM (VALUES {_LISTED}) l(c) LEFT JOIN {_COUNTS} k ON k.c = l.c
    WHERE (SELECT max(n) FROM {_COUNTS} m) - coalesce(k.n, 0) > 0""",
)
def _(t):
    return corpus.balance_targets(raw(t), "sql_complexity")


@register(
    "corpus_input_text",
    f"SELECT row_id, {TEXT} AS input_text FROM ({RAW}) r",
)
def _(t):
    return raw(t).select("row_id", corpus.input_text(F.col("sql_context"), F.col("sql_prompt")).alias("input_text"))


@register(
    "corpus_stratified_split",
    """WITH d AS (SELECT doc_id, CASE WHEN source = 'src1' THEN NULL WHEN doc_id = 5 THEN 'alone' ELSE source END AS source, ('0x' || substr(md5('42:' || doc_id), 1, 15))::BIGINT AS h FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM d)
    SELECT doc_id, source, CASE WHEN n >= 2 AND k <= round(n * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM r""",
)
def _(t):
    source = F.when(F.col("source") == "src1", None).when(F.col("doc_id") == 5, "alone").otherwise(F.col("source"))
    return corpus.stratified_split(t.documents.select("doc_id", source.alias("source")), "source", "doc_id")


@register(
    "corpus_dedup_keep_first",
    f"""SELECT row_id, split, input_text, sql, sql_complexity FROM (SELECT *, row_number() OVER (PARTITION BY split, input_text, sql ORDER BY row_id) AS k
    FROM ({ENG}) e) d WHERE k = 1""",
)
def _(t):
    return leakage.dedup_keep_first(engineered(t), ["input_text", "sql"], "row_id")


_KEY = "input_text, sql"
#: The engineered rows with null keys, in all splits.
ENGN = f"SELECT * REPLACE (CASE WHEN row_id % 7 = 0 THEN NULL ELSE sql END AS sql) FROM ({ENG}) full_rows"


def with_nulls(t):
    return engineered(t).withColumn("sql", F.when(F.col("row_id") % 7 == 0, None).otherwise(F.col("sql")))



@register(
    "corpus_leak_overlap",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS left_split, '{b}' AS right_split, count(*) AS n_shared FROM (SELECT {_KEY} FROM ({ENGN}) e WHERE split = '{a}'
        INTERSECT SELECT {_KEY} FROM ({ENGN}) e WHERE split = '{b}') x"""
        for a, b in (("train", "val"), ("train", "test"), ("val", "test"))
    ),
)
def _(t):
    return leakage.overlap(with_nulls(t), ["input_text", "sql"])


@register(
    "corpus_leak_remove",
    f"""WITH e AS ({ENGN}), h AS (SELECT DISTINCT {_KEY} FROM e WHERE split <> 'train')
    SELECT * FROM e WHERE split <> 'train' UNION ALL SELECT * FROM e WHERE split = 'train' AND NOT EXISTS (
    SELECT 1 FROM h WHERE h.input_text = e.input_text AND h.sql IS NOT DISTINCT FROM e.sql)""",
)
def _(t):
    return leakage.remove_leaks(with_nulls(t), ["input_text", "sql"])


@register(
    "corpus_leak_report",
    f"""WITH k AS (SELECT {_KEY}, count(*) FILTER (split = 'train') AS tr, count(*) FILTER (split = 'val') AS va, count(*) FILTER (split = 'test') AS te FROM ({ENGN}) e GROUP BY ALL),
    s AS (SELECT sum(tr) AS otr, sum(va) AS ova, sum(te) AS ote, sum(greatest(tr - 1, 0)) AS itr, sum(greatest(va - 1, 0)) AS iva, sum(greatest(te - 1, 0)) AS ite,
      count(*) FILTER (tr > 0 AND va + te > 0) AS cr, count(*) FILTER (tr > 0 AND va > 0) AS tv, count(*) FILTER (tr > 0 AND te > 0) AS tt,
      count(*) FILTER (va > 0 AND te > 0) AS vt FROM k)
    SELECT otr::BIGINT AS original_train, ova::BIGINT AS original_val, ote::BIGINT AS original_test, itr::BIGINT AS intra_train, iva::BIGINT AS intra_val, ite::BIGINT AS intra_test,
    cr AS cross_removed, tv AS overlap_train_val, tt AS overlap_train_test, vt AS overlap_val_test, (otr - itr - cr)::BIGINT AS final_train, (ova - iva)::BIGINT AS final_val,
    (ote - ite)::BIGINT AS final_test, (itr + iva + ite)::BIGINT AS total_intra, (itr + iva + ite + cr)::BIGINT AS total_removed, itr + iva + ite + cr > 0 AS leakage_cleaned FROM s""",
)
def _(t):
    return leakage.leak_report(with_nulls(t), ["input_text", "sql"])


@register(
    "corpus_benchmark_contamination",
    """WITH b AS (SELECT DISTINCT lower(trim(unnest(string_split(text, chr(10))))) AS p FROM benchmark),
    l AS (SELECT doc_id, lower(trim(unnest(string_split(text, chr(10))))) AS p FROM documents)
    SELECT doc_id, count(DISTINCT p) AS n_passages, count(*) AS n_lines FROM l WHERE p <> '' AND p IN (SELECT p FROM b) GROUP BY doc_id""",
)
def _(t):
    return leakage.contamination(t.documents, "doc_id", "text", t.benchmark, "text")


_CLEAN = f"""SELECT row_id, split, regexp_replace(regexp_replace(input_text, '(?is)insert\\s+into.*?\\n\\nquery:', 'query:', 'g'),
  '(?is)translate\\s+english\\s+to\\s+sql.*?context:', 'context:', 'g') AS input_text, replace(sql, chr(10), ' ') AS sql, sql_complexity
  FROM ({ENG}) e WHERE NOT regexp_matches(sql, '(?i)insert\\s+into')"""


@register("corpus_clean_text", _CLEAN)
def _(t):
    return corpus.clean(engineered(t))


@register(
    "corpus_clean_report",
    f"""SELECT split, count(*) AS original, count(*) FILTER (NOT regexp_matches(sql, '(?i)insert\\s+into')) AS final,
    count(*) FILTER (regexp_matches(sql, '(?i)insert\\s+into')) AS removed FROM ({ENG}) e GROUP BY split""",
)
def _(t):
    return corpus.clean_report(engineered(t), corpus.clean(engineered(t)))


_CUR, _PREV = "documents WHERE doc_id % 3 <> 0", "documents WHERE doc_id % 3 = 0"


def _snapshots(t):
    d = t.documents.select("doc_id", "lang", "source", "text")
    return d.filter("doc_id % 3 <> 0"), d.filter("doc_id % 3 = 0")


_SHARES = f"""(SELECT source, coalesce(pp, 0) AS pp, coalesce(cp, 0) AS cp, CASE WHEN coalesce(pp, 0) > 0 THEN (coalesce(cp, 0) - pp) / pp * 100
  WHEN cp > 0 THEN 100.0 ELSE 0.0 END AS ch FROM (SELECT source, count(*) * 1.0::DOUBLE / sum(count(*)) OVER () * 100 AS cp FROM {_CUR} GROUP BY source) c
  FULL JOIN (SELECT source, count(*) * 1.0::DOUBLE / sum(count(*)) OVER () * 100 AS pp FROM {_PREV} GROUP BY source) p USING (source))"""


@register(
    "drift_class_distribution",
    f"""SELECT source, round(pp, 2) AS previous_pct, round(cp, 2) AS current_pct, round(cp - pp, 2) AS pct_point_change, round(ch, 2) AS pct_change,
    abs(ch) > 10 AS exceeds FROM {_SHARES} s""",
)
def _(t):
    return drift.class_drift(*_snapshots(t), "source")


def _lens(where):
    return f"""(SELECT lang, avg(length(text)) AS mean, quantile_cont(length(text), 0.5) AS median, stddev_samp(length(text)) AS std,
      min(length(text)) AS mn, max(length(text)) AS mx FROM {where} GROUP BY lang)"""


@register(
    "drift_length_stats",
    f"""SELECT lang, round(p.mean, 2) AS previous_mean_length, round(c.mean, 2) AS current_mean_length, round((c.mean - p.mean) / p.mean * 100, 2) AS mean_pct_change,
    round(p.median, 2) AS previous_median_length, round(c.median, 2) AS current_median_length, round((c.median - p.median) / p.median * 100, 2) AS median_pct_change,
    round(p.std, 2) AS previous_std_length, round(c.std, 2) AS current_std_length, p.mn AS previous_min_length, c.mn AS current_min_length,
    p.mx AS previous_max_length, c.mx AS current_max_length, abs((c.mean - p.mean) / p.mean * 100) > 5 AS exceeds
    FROM {_lens(_CUR)} c JOIN {_lens(_PREV)} p USING (lang)""",
)
def _(t):
    return drift.length_drift(*_snapshots(t), "lang", "text")


@register(
    "drift_size_change",
    f"""SELECT p AS previous_rows, c AS current_rows, round((c - p) * 100.0::DOUBLE / p, 2) AS size_change_pct FROM (
    SELECT (SELECT count(*) FROM {_PREV}) AS p, (SELECT count(*) FROM {_CUR}) AS c) n""",
)
def _(t):
    return drift.size_change(*_snapshots(t))


@register(
    "drift_decision",
    f"""WITH r AS (SELECT 'class_share' AS kind, source AS cls, round(ch, 2) AS v FROM {_SHARES} s WHERE abs(ch) > 10
    UNION ALL SELECT 'text_length', source, round((c.mean - p.mean) / p.mean * 100, 2) FROM {_lens(_CUR).replace('lang', 'source')} c
      JOIN {_lens(_PREV).replace('lang', 'source')} p USING (source) WHERE abs((c.mean - p.mean) / p.mean * 100) > 5)
    SELECT array_to_string(list_sort(list(printf('%s ''%s'' changed by %+.2f%%', kind, cls, v))), '; ') AS trigger_reasons, count(*) AS n_reasons, count(*) > 0 AS drift_detected FROM r""",
)
def _(t):
    out = drift.decision(*_snapshots(t), "source", "text")
    return out.withColumn("trigger_reasons", F.array_join("trigger_reasons", "; "))


@register(
    "corpus_sample_n",
    "SELECT doc_id, source FROM documents ORDER BY ('0x' || substr(md5('42:' || doc_id), 1, 15))::BIGINT, doc_id LIMIT 100",
)
def _(t):
    return corpus.sample_n(t.documents.select("doc_id", "source"), "doc_id", 100)
