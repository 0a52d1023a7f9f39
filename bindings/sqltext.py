"""SQL-text analytics on the statement log."""

from pyspark.sql import functions as F

from bindings.registry import register
from bindings.statements import LOG, statement_log
from tidemark.functions import sqltext as st
from tidemark.operators import sqlreports


def _listed(names, pattern):
    cases = ", ".join(f"CASE WHEN regexp_matches(upper(sql), '{pattern.replace('@', n)}') THEN '{n}' END" for n in names)
    return f"concat_ws(',', {cases})"


def _count(pattern):
    return f"len(regexp_extract_all(upper(sql), '{pattern}'))"


_WIN = _listed(st.WINDOW_FUNCTIONS, r"\b@\s*\([^)]*\)\s+OVER\s*\(")
_SET = _listed(st.SET_OPERATIONS, r"\b@\b")
_AGG = _listed(st.AGGREGATES, r"\b@\s*\(")
_JOINS = "(" + " + ".join(_count(p) for p in st.JOIN_PATTERNS) + ")"
_SELECTS = _count(r"\bSELECT\b")

FEATURES = f"""(SELECT *, CASE WHEN blank THEN 'unknown' WHEN w <> '' THEN 'window_functions' WHEN s <> '' THEN 'set_operations'
  WHEN joins >= 2 THEN 'multiple_joins' WHEN nest > 0 THEN 'subqueries' WHEN a THEN 'aggregations' WHEN joins = 1 THEN 'single_join'
  ELSE 'simple' END AS primary_complexity,
  CASE WHEN blank THEN '' WHEN w = '' AND s = '' AND joins = 0 AND nest = 0 AND NOT a THEN 'simple' ELSE concat_ws(',',
    CASE WHEN w <> '' THEN 'window_functions' END, CASE WHEN s <> '' THEN 'set_operations' END,
    CASE WHEN joins >= 2 THEN 'multiple_joins' WHEN joins = 1 THEN 'single_join' END,
    CASE WHEN nest > 0 THEN 'subqueries' END, CASE WHEN a THEN 'aggregations' END) END AS all_complexities
FROM (SELECT *, {_WIN} AS w, {_SET} AS s, {_JOINS} AS joins, greatest({_SELECTS} - 1, 0) AS nest, trim(sql) = '' AS blank,
  ({_AGG} <> '' OR regexp_matches(upper(sql), '\\bGROUP\\s+BY\\b')) AS a FROM ({LOG}) log) f)"""
_SCORE = "CASE primary_complexity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in st.CLASS_SCORES.items()) + " ELSE 0 END"


@register("sqltext_window_functions", f"SELECT event_id, {_WIN} AS functions FROM ({LOG}) log")
def _(t):
    return statement_log(t).select("event_id", F.array_join(st.window_functions(F.col("sql")), ",").alias("functions"))


@register("sqltext_set_ops", f"SELECT event_id, {_SET} AS operations FROM ({LOG}) log")
def _(t):
    return statement_log(t).select("event_id", F.array_join(st.set_operations(F.col("sql")), ",").alias("operations"))


@register(
    "sqltext_joins",
    f"""SELECT event_id, {_JOINS} AS join_count, {_count(st.JOIN_PATTERNS[-1])} AS strict_count,
    array_to_string(list_sort(list_distinct(flatten([{', '.join(f"regexp_extract_all(upper(sql), '{p}')" for p in st.JOIN_PATTERNS)}]))), ',') AS join_types
    FROM ({LOG}) log""",
)
def _(t):
    return statement_log(t).select(
        "event_id",
        st.join_count(F.col("sql")).alias("join_count"),
        st.join_count(F.col("sql"), strict=True).alias("strict_count"),
        F.array_join(st.join_types(F.col("sql")), ",").alias("join_types"),
    )


_KINDS = ", ".join(
    f"CASE WHEN regexp_matches(upper(sql), '{p.replace('(?d)', '')}') THEN '{k}' END" for k, p in st.SUBQUERY_KINDS.items()
)


@register(
    "sqltext_subqueries",
    f"""SELECT event_id, {_SELECTS} AS select_count, greatest({_SELECTS} - 1, 0) AS nesting_level, concat_ws(',', {_KINDS}) AS kinds FROM ({LOG}) log""",
)
def _(t):
    return statement_log(t).select(
        "event_id",
        st.select_count(F.col("sql")).alias("select_count"),
        st.nesting_level(F.col("sql")).alias("nesting_level"),
        F.array_join(st.subquery_kinds(F.col("sql")), ",").alias("kinds"),
    )


@register(
    "sqltext_aggregations",
    f"""SELECT event_id, {_AGG} AS functions, regexp_matches(upper(sql), '\\bGROUP\\s+BY\\b') AS has_group_by,
    regexp_matches(upper(sql), '\\bHAVING\\b') AS has_having FROM ({LOG}) log""",
)
def _(t):
    return statement_log(t).select(
        "event_id",
        F.array_join(st.aggregate_functions(F.col("sql")), ",").alias("functions"),
        st.has_group_by(F.col("sql")).alias("has_group_by"),
        st.has_having(F.col("sql")).alias("has_having"),
    )


@register(
    "sqltext_primary_complexity",
    f"""SELECT event_id, primary_complexity, all_complexities, {_SCORE} AS complexity_score,
    CASE WHEN all_complexities = '' THEN 0 ELSE len(string_split(all_complexities, ',')) END AS feature_count FROM {FEATURES} x""",
)
def _(t):
    out = st.with_complexity(statement_log(t), "sql")
    return out.select(
        "event_id", "primary_complexity", F.array_join("all_complexities", ",").alias("all_complexities"),
        "complexity_score", "feature_count",
    )


def _buckets(section, col, buckets):
    rows = []
    for b in buckets:
        cond = f"{col} <= {b:g}" if b != float("inf") else "true"
        name = sqlreports._le(b)
        rows.append(
            f"SELECT db_type, '{section}' AS section, '{name}' AS item, count(*) AS n, NULL::DOUBLE AS mean_score FROM x "
            f"WHERE {col} > 0 AND {cond} GROUP BY db_type"
        )
    return " UNION ALL ".join(rows)


@register(
    "sqltext_complexity_report",
    f"""WITH x AS (SELECT *, {_SCORE} AS score FROM {FEATURES} y)
    SELECT db_type, 'distribution' AS section, primary_complexity AS item, count(*) AS n, NULL::DOUBLE AS mean_score FROM x GROUP BY ALL
    UNION ALL SELECT db_type, 'score', 'mean', count(*), avg(score) FROM x GROUP BY db_type
    UNION ALL SELECT db_type, 'feature', item, count(*), NULL FROM (SELECT db_type, unnest(string_split(all_complexities, ',')) AS item
      FROM x WHERE all_complexities <> '') u GROUP BY ALL
    UNION ALL {_buckets('join_count_le', 'joins', sqlreports.JOIN_BUCKETS)}
    UNION ALL {_buckets('nesting_level_le', 'nest', sqlreports.NESTING_BUCKETS)}""",
    {"mean_score": 6},
)
def _(t):
    return sqlreports.complexity_report(statement_log(t), "sql", "db_type")


GUARD = (
    "CASE "
    + " ".join(f"WHEN regexp_matches(upper(sql), '\\b{c}\\b') THEN 'dangerous_command_{c.lower()}'" for c in st.BLOCKED_COMMANDS)
    + " ".join(f" WHEN contains(upper(sql), '{f.upper()}') THEN 'dangerous_function_{f}'" for f in st.BLOCKED_FUNCTIONS)
    + " END"
)


@register("sqltext_guard", f"SELECT event_id, {GUARD} IS NULL AS allowed, {GUARD} AS failure_type FROM ({LOG}) log")
def _(t):
    fail = st.guard_failure(F.col("sql"))
    return statement_log(t).select("event_id", fail.isNull().alias("allowed"), fail.alias("failure_type"))


@register(
    "sqltext_guard_report",
    f"SELECT failure_type, count(*) AS n_blocked FROM (SELECT {GUARD} AS failure_type FROM ({LOG}) log) g WHERE failure_type IS NOT NULL GROUP BY failure_type",
)
def _(t):
    return sqlreports.guard_report(statement_log(t), "sql")


_FENCED = "CASE event_id % 3 WHEN 0 THEN '```sql' || chr(10) || sql || chr(10) || '```' WHEN 1 THEN sql || ';' ELSE '  ' || sql END"


@register(
    "sqltext_clean_markdown",
    f"""SELECT event_id, CASE WHEN c LIKE '%;' THEN c ELSE c || ';' END AS cleaned FROM (SELECT event_id,
    regexp_replace(regexp_replace(replace(replace({_FENCED}, '```sql', ''), '```', ''), '^\\s+', ''), '\\s+$', '') AS c FROM ({LOG}) log) f""",
)
def _(t):
    return statement_log(t).select("event_id", st.clean_markdown(F.expr(_FENCED)).alias("cleaned"))


_QUOTED = "'\"' || sql || '\"  ' || chr(92) || event_type"


@register(
    "sqltext_flatten",
    f"""SELECT event_id, trim(regexp_replace(replace(replace({_QUOTED}, chr(92), ''), '"', ''), '\\s+', ' ', 'g')) AS flat FROM ({LOG}) log""",
)
def _(t):
    return statement_log(t).select("event_id", st.flatten(F.expr(_QUOTED)).alias("flat"))


_ERR = "CASE WHEN contains(lower(message), 'syntax') THEN 'syntax_error' ELSE 'execution_error' END"


@register("sqltext_error_type", f"SELECT event_id, {_ERR} AS error_type FROM ({LOG}) log")
def _(t):
    return statement_log(t).select("event_id", st.error_type(F.col("message")).alias("error_type"))


@register(
    "sqltext_error_report",
    f"""SELECT db_type, primary_complexity, {_ERR} AS error_type, count(*) AS n_errors FROM {FEATURES} x
    GROUP BY ALL""",
)
def _(t):
    log = st.with_complexity(statement_log(t), "sql")
    return sqlreports.error_report(log, "message", ["db_type", "primary_complexity"])


_AGGS = "(contains(u, 'SUM(') OR contains(u, 'AVG(') OR contains(u, 'COUNT(') OR contains(u, 'MAX(') OR contains(u, 'MIN(') OR contains(u, 'STRING_AGG(') OR contains(u, 'LISTAGG('))"
_COLS = "(len(string_split(string_split(u, 'FROM')[1], ',')))"


@register(
    "prof_intent",
    f"""SELECT event_id, bi_score, eda_score, CASE WHEN bi_score > eda_score + 20 THEN 'bi' WHEN eda_score > bi_score + 20 THEN 'eda'
      WHEN g OR ag THEN 'bi' ELSE 'eda' END AS intent FROM (SELECT *,
      50 * g::INT + 40 * ag::INT + 30 * contains(u, 'HAVING')::INT + CASE WHEN cols <= 5 AND g THEN 20 ELSE 0 END + CASE WHEN n_rows = 1 THEN 20 ELSE 0 END
        + CASE WHEN n_cols <= 3 THEN 15 ELSE 0 END + CASE WHEN regexp_matches(q, 'total|sum|average|count|top|by category|breakdown|grouped') THEN 10 ELSE 0 END AS bi_score,
      50 * contains(u, 'SELECT *')::INT + CASE WHEN cols > 10 THEN 40 ELSE 0 END + CASE WHEN j >= 2 AND NOT g THEN 30 ELSE 0 END
        + CASE WHEN contains(u, 'WHERE') AND NOT g THEN 15 ELSE 0 END + CASE WHEN n_cols > 10 THEN 20 ELSE 0 END + CASE WHEN n_unique >= n_cols * 0.7::DOUBLE THEN 15 ELSE 0 END
        + CASE WHEN regexp_matches(q, 'show me|give me all|list all|contents|everything|explore|see all|display all|all') THEN 10 ELSE 0 END AS eda_score
    FROM (SELECT *, {_AGGS} AS ag, {_COLS} AS cols, contains(u, 'GROUP BY') AS g, len(string_split(u, 'JOIN')) - 1 AS j
      FROM (SELECT *, upper(sql) AS u, lower(question) AS q FROM ({LOG}) log) a) b) c""",
)
def _(t):
    out = sqlreports.intent(statement_log(t), "sql", "question", "n_rows", "n_cols", "n_unique")
    return out.select("event_id", "bi_score", "eda_score", "intent")
