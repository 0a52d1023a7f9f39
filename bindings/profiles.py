"""Result profiles and chart data on orders, events, lineitem and documents."""

from pyspark.sql import functions as F

from bindings.registry import register
from tidemark.operators import charts, profile

_COLS = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
}


@register(
    "prof_overview",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{k}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS null_count, count(*) AS total_rows, {len(_COLS)} AS total_columns FROM orders"
        for c, k in _COLS.items()
    ),
)
def _(t):
    return profile.overview(t.orders.select(*_COLS))


@register(
    "prof_describe",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c})::DOUBLE AS min, quantile_cont({c}, 0.25) AS q25,
        quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q75, max({c})::DOUBLE AS max FROM lineitem"""
        for c in ("l_quantity", "l_extendedprice", "l_discount")
    ),
    {"mean": 4, "std": 4, "q25": 4, "median": 4, "q75": 4},
)
def _(t):
    return profile.describe(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])


_LABELLED = "documents LEFT JOIN labels USING (doc_id)"


@register(
    "prof_missing",
    f"""SELECT * FROM (SELECT 'quality' AS column_name, count(*) - count(quality) AS missing_count, (count(*) - count(quality)) * 100.0::DOUBLE / count(*) AS missing_percentage FROM {_LABELLED}
    UNION ALL SELECT 'toxic', count(*) - count(toxic), (count(*) - count(toxic)) * 100.0::DOUBLE / count(*) FROM {_LABELLED}) m WHERE missing_percentage >= 1""",
    {"missing_percentage": 6},
)
def _(t):
    return profile.missing(t.documents.join(t.labels, "doc_id", "left").select("doc_id", "lang", "source", "quality", "toxic"))


@register(
    "prof_high_cardinality",
    """WITH c AS (SELECT CAST(o_custkey AS VARCHAR) AS value, count(*) AS n_rows FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1), t AS (SELECT count(*) AS n FROM orders),
    u AS (SELECT 'top' AS section, row_number() OVER (ORDER BY n_rows DESC, value) AS position, value, n_rows FROM c QUALIFY position <= 5
      UNION ALL SELECT 'bottom', row_number() OVER (ORDER BY n_rows, value DESC) AS position, value, n_rows FROM c QUALIFY position <= 5
      UNION ALL SELECT 'mode', 1, value, n_rows FROM (SELECT * FROM c ORDER BY n_rows DESC, value LIMIT 1) m
      UNION ALL SELECT 'total_unique', 0, NULL, count(*) FROM c
      UNION ALL SELECT 'singletons', 0, NULL, count(*) FROM c WHERE n_rows = 1)
    SELECT section, position, value, n_rows, CASE WHEN value IS NOT NULL THEN n_rows * 100.0::DOUBLE / n END AS percentage FROM u, t""",
    {"percentage": 6},
)
def _(t):
    return profile.high_cardinality(t.orders, "o_custkey")


_MESSY = "CASE event_id % 4 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('Infinity' AS DOUBLE) WHEN 2 THEN value ELSE -value END"


@register(
    "result_sanitize",
    """SELECT event_id, CAST(value AS DECIMAL(10,2))::DOUBLE AS amount, CASE event_id % 4 WHEN 2 THEN value WHEN 3 THEN -value END AS messy FROM events""",
)
def _(t):
    rows = t.events.select(
        "event_id", F.col("value").cast("decimal(10,2)").alias("amount"), F.expr(_MESSY).alias("messy")
    )
    return profile.sanitize(rows)


@register(
    "chart_histogram",
    """WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT CAST(unnest(range(30)) AS INT) AS bin),
    c AS (SELECT CAST(least(floor((value - lo) / ((hi - lo) / 30)), 29) AS INT) AS bin, count(*) AS n FROM events, e GROUP BY 1)
    SELECT b.bin, lo + b.bin * ((hi - lo) / 30) AS bin_start, lo + (b.bin + 1) * ((hi - lo) / 30) AS bin_end, coalesce(n, 0) AS n_rows
    FROM b JOIN e ON true LEFT JOIN c ON c.bin = b.bin""",
    {"bin_start": 6, "bin_end": 6},
)
def _(t):
    return charts.histogram(t.events, "value")


def _box(table, col, by=None):
    g = f"{by}, " if by else ""
    tail = f"GROUP BY {by}" if by else ""
    five = f"""SELECT {g}min({col}) AS min_value, quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.5) AS median,
      quantile_cont({col}, 0.75) AS q3, max({col}) AS max_value FROM {table} {tail}"""
    match = f"t.{by} = f.{by} AND " if by else ""
    return f"""WITH f AS (SELECT *, q1 - 1.5::DOUBLE * (q3 - q1) AS lower_fence, q3 + 1.5::DOUBLE * (q3 - q1) AS upper_fence FROM ({five}) x)
      SELECT f.*, (SELECT count(*) FROM {table} t WHERE {match}(t.{col} < f.lower_fence OR t.{col} > f.upper_fence)) AS n_outliers FROM f"""


_FIVE = {"q1": 4, "median": 4, "q3": 4, "lower_fence": 4, "upper_fence": 4}


@register("chart_box", _box("events", "value"), _FIVE)
def _(t):
    return charts.box(t.events, "value")


@register(
    "chart_box_outliers",
    """WITH f AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
    SELECT event_id, value FROM events, f WHERE value < q1 - 1.5::DOUBLE * (q3 - q1) OR value > q3 + 1.5::DOUBLE * (q3 - q1)""",
)
def _(t):
    return charts.box_outliers(t.events, "value", ["event_id"])


@register("chart_box_by_category", _box("events", "value", "event_type"), _FIVE)
def _(t):
    return charts.box_by_category(t.events, "value", "event_type")


@register(
    "chart_frequency_bar",
    "SELECT source, count(*) AS n_rows FROM documents WHERE source IS NOT NULL GROUP BY source",
)
def _(t):
    return charts.frequency_bar(t.documents, "source")


@register(
    "chart_top_n_bar",
    """SELECT p_partkey, count(*) AS n_rows FROM (SELECT l_partkey AS p_partkey FROM lineitem) l GROUP BY p_partkey
    ORDER BY n_rows DESC, p_partkey LIMIT 20""",
)
def _(t):
    return charts.top_n_bar(t.lineitem.select(F.col("l_partkey").alias("p_partkey")), "p_partkey", 20)


@register(
    "chart_metric_bar",
    "SELECT c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20",
)
def _(t):
    return charts.metric_bar(t.customer, "c_name", "c_acctbal", ["c_custkey"], 20)


@register(
    "chart_word_frequencies",
    "SELECT p_name, count(*) AS n_rows FROM part GROUP BY p_name ORDER BY n_rows DESC, p_name LIMIT 200",
)
def _(t):
    return charts.word_frequencies(t.part, "p_name", 200)


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register(
    "chart_correlation_matrix",
    " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS correlation FROM lineitem" for a in _NUM for b in _NUM),
    {"correlation": 6},
)
def _(t):
    return charts.correlation_matrix(t.lineitem, _NUM)


_P = ["p_size", "p_retailprice", "twice", "bucket"]
_PART = "(SELECT p_size, p_retailprice, p_retailprice * 2 + p_size AS twice, p_partkey % 7 + p_size AS bucket FROM part) s"
_PAIRS = [(a, b) for i, a in enumerate(_P) for b in _P[i + 1 :]]


@register(
    "chart_scatter_pairs",
    "SELECT x, y, correlation, near_unique, NOT near_unique AS show_regression FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS correlation,
        count(DISTINCT {a}) > 0.95 * count(*) AND count(DISTINCT {b}) > 0.95 * count(*) AS near_unique FROM {_PART}"""
        for a, b in _PAIRS
    )
    + ") q WHERE abs(correlation) > CASE WHEN near_unique THEN 0.3 ELSE 0.5 END",
    {"correlation": 6},
)
def _(t):
    rows = t.part.selectExpr("p_size", "p_retailprice", "p_retailprice * 2 + p_size AS twice", "p_partkey % 7 + p_size AS bucket")
    return charts.scatter_pairs(rows, _P)


@register(
    "chart_regression_line",
    """SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept,
    CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n_rows FROM lineitem""",
    {"slope": 4, "intercept": 4},
)
def _(t):
    return charts.regression_line(t.lineitem, "l_quantity", "l_extendedprice")


@register(
    "chart_line_over_time",
    "SELECT CAST(ts AS DATE) AS day, avg(value) AS avg_metric, count(value) AS n_rows FROM events GROUP BY 1",
    {"avg_metric": 4},
)
def _(t):
    return charts.line_over_time(t.events, "ts", "value")


@register("chart_line_points", "SELECT ts, value FROM events")
def _(t):
    return charts.line_points(t.events, "ts", "value")


@register("chart_scatter_colored", "SELECT l_quantity, l_extendedprice, l_returnflag FROM lineitem")
def _(t):
    return charts.scatter_colored(t.lineitem, "l_quantity", "l_extendedprice", "l_returnflag")


@register(
    "chart_sample",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE ('0x' || substr(md5('42:' || o_orderkey), 1, 15))::BIGINT < 576460752303423488""",
)
def _(t):
    return charts.sample_share(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 0.5)
