"""The curation run as a whole."""

from pyspark.sql import functions as F

from bindings.corpus import ENGN, RAW, TEXT, raw, with_nulls
from bindings.evaluation import validity_sql
from bindings.registry import ORACLES, register
from bindings.synthetic import catalogue
from bindings.synthetic_sql import synthetic_sql
from tidemark.operators import corpus
from tidemark.plans import curation

_V = f"(SELECT *, {validity_sql('sql')} AS f FROM ({RAW}) r)"
_LEAKS = ["total_intra", "cross_removed", "total_removed", "final_train", "final_val", "final_test"]


def _unpivot(stage, source, metrics):
    return " UNION ALL ".join(f"SELECT '{stage}', '{m}', {m}::DOUBLE FROM ({source}) s" for m in metrics)


@register(
    "curation_summary",
    f"""SELECT 'load' AS stage, split || '_n_rows' AS metric, count(*)::DOUBLE AS value FROM ({RAW}) r GROUP BY split
    UNION ALL SELECT 'validate', split || '_n_valid', count(*) FILTER (f IS NULL)::DOUBLE FROM {_V} v GROUP BY split
    UNION ALL SELECT 'validate', split || '_n_invalid', count(*) FILTER (f IS NOT NULL)::DOUBLE FROM {_V} v GROUP BY split
    UNION ALL {_unpivot('balance', ORACLES['corpus_imbalance'], ['max_count', 'min_count', 'imbalance_ratio'])}
    UNION ALL SELECT 'generate', 'rows_needed', sum(needed)::DOUBLE FROM ({ORACLES['corpus_balance_targets']}) b
    UNION ALL {_unpivot('leakage', ORACLES['corpus_leak_report'], _LEAKS)}
    UNION ALL SELECT 'clean', split || '_original', count(*)::DOUBLE FROM ({ENGN}) e GROUP BY split
    UNION ALL SELECT 'clean', split || '_removed', count(*) FILTER (regexp_matches(sql, '(?i)insert\\s+into'))::DOUBLE FROM ({ENGN}) e GROUP BY split""",
    {"value": 6},
)
def _(t):
    return curation.summary(raw(t), with_nulls(t))


_VALID = f"(SELECT * FROM {_V} v WHERE f IS NULL)"
_TRAIN = f"(SELECT * FROM {_VALID} t WHERE split = 'train')"
_COUNTS = f"(SELECT sql_complexity AS c, count(*) AS n FROM {_TRAIN} k WHERE sql_complexity IS NOT NULL GROUP BY 1)"
_NEED = f"""SELECT c AS sql_complexity, (SELECT max(n) FROM {_COUNTS} m) - coalesce(n, 0) AS needed
  FROM (VALUES {', '.join(f"('{c}')" for c in corpus.SYNTHETIC_CLASSES)}) l(c) LEFT JOIN {_COUNTS} k USING (c) WHERE (SELECT max(n) FROM {_COUNTS} m) > coalesce(n, 0)"""
_TOP = f"(SELECT coalesce(max(row_id), -1) + 1 FROM {_VALID} x)"


_MARKED = rf"""WITH merged AS (
      SELECT row_id, sql_prompt, sql_context, sql, sql_complexity FROM {_TRAIN} t
      UNION ALL SELECT row_id + {_TOP}, sql_prompt, sql_context, sql, sql_complexity FROM ({synthetic_sql(_NEED)}) s
    ),
    ranked AS (
      SELECT *, count(*) OVER (PARTITION BY sql_complexity) AS n,
        row_number() OVER (PARTITION BY sql_complexity ORDER BY ('0x' || substr(md5('42:' || row_id), 1, 15))::BIGINT, row_id) AS k FROM merged
    ),
    all_rows AS (
      SELECT CASE WHEN n >= 2 AND k <= round(n * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split, row_id, sql_prompt, sql_context, sql, sql_complexity FROM ranked
      UNION ALL SELECT split, row_id, sql_prompt, sql_context, sql, sql_complexity FROM {_VALID} t WHERE split = 'test'
    ),
    texts AS (SELECT split, row_id, {TEXT} AS input_text, sql, sql_complexity FROM all_rows),
    firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split, input_text, sql ORDER BY row_id) AS k FROM texts) x WHERE k = 1),
    marked AS (
      SELECT *, bool_or(split = 'test') OVER (PARTITION BY input_text, sql) AS in_test, bool_or(split = 'val') OVER (PARTITION BY input_text, sql) AS in_val FROM firsts
    )
"""
_KEPT = r"(split = 'test' OR NOT in_test) AND (split <> 'train' OR NOT in_val) AND NOT coalesce(regexp_matches(sql, '(?i)insert\s+into'), false)"


@register(
    "curation_end_to_end",
    f"""{_MARKED}    SELECT split, sql_complexity, count(*) AS n_rows FROM marked
    WHERE {_KEPT}
    GROUP BY split, sql_complexity""",
)
def _(t):
    """Rows per split and class after all stages, synthetic rows included."""
    out = curation.curate(raw(t), catalogue(t), on_overlap="drop")
    return out.groupBy("split", "sql_complexity").agg(F.count(F.lit(1)).alias("n_rows"))


_CELLS = "VALUES " + ", ".join(f"('{m}', {m})" for m in ["previous_pct", "current_pct", "pct_change", "previous_mean_length", "current_mean_length", "mean_pct_change"])


@register(
    "curation_drift",
    f"""{_MARKED}, cur AS (SELECT sql_complexity AS c, replace(sql, chr(10), ' ') AS sql FROM marked WHERE {_KEPT} AND split = 'train'),
    prev AS (SELECT sql_complexity AS c, sql FROM ({RAW}) r WHERE split = 'train'),
    cs AS (SELECT c, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct, avg(length(sql)) AS m FROM cur WHERE c IS NOT NULL GROUP BY c),
    ps AS (SELECT c, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct, avg(length(sql)) AS m FROM prev WHERE c IS NOT NULL GROUP BY c),
    both_ AS (
      SELECT c, coalesce(ps.pct, 0) AS previous_pct, coalesce(cs.pct, 0) AS current_pct,
        CASE WHEN ps.pct > 0 THEN (coalesce(cs.pct, 0) - ps.pct) / ps.pct * 100 WHEN cs.pct > 0 THEN 100 ELSE 0 END AS pct_change,
        ps.m AS previous_mean_length, cs.m AS current_mean_length, (cs.m - ps.m) / ps.m * 100 AS mean_pct_change
      FROM cs FULL JOIN ps USING (c)
    ),
    n AS (SELECT (SELECT count(*) FROM prev) AS previous_rows, (SELECT count(*) FROM cur) AS current_rows),
    r AS (SELECT (count(*) FILTER (abs(pct_change) > 10) + count(*) FILTER (abs(mean_pct_change) > 5))::DOUBLE AS n_reasons FROM both_)
    SELECT 'drift' AS stage, v.metric, v.value FROM n, LATERAL (VALUES ('previous_rows', previous_rows::DOUBLE), ('current_rows', current_rows::DOUBLE),
      ('size_change_pct', round((current_rows - previous_rows) * 100.0::DOUBLE / previous_rows, 2))) v(metric, value)
    UNION ALL SELECT 'drift', v.metric, v.value FROM r, LATERAL (VALUES ('n_reasons', n_reasons), ('drift_detected', (n_reasons > 0)::INT::DOUBLE)) v(metric, value)
    UNION ALL SELECT 'drift', c || '_' || v.metric, round(v.value, 2) FROM both_, LATERAL ({_CELLS}) v(metric, value)
    WHERE v.metric LIKE '%pct' OR v.metric = 'pct_change' OR mean_pct_change IS NOT NULL""",
    {"value": 2},
)
def _(t):
    """How far the run moves the train split away from its input."""
    before = raw(t)
    after = curation.curate(before, catalogue(t), on_overlap="drop")
    return curation.drift_report(after.filter("split = 'train'"), before.filter("split = 'train'"))
