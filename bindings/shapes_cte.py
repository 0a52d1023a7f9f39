"""CTE shapes on orders (events where orders would give no rows)."""

from bindings.registry import cents, register
from tidemark.operators import cte, datefilters

G, M, D = "o_orderstatus", "o_totalprice", "o_orderdate"
SINCE, YEAR, AS_OF = "1997-01-01", 1998, "2001-08-02"


@register(
    "cte_total_above_threshold",
    """WITH t AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders
    WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY o_custkey)
    SELECT * FROM t WHERE total > 2000000 ORDER BY total DESC""",
    {"total": 2},
)
def _(t):
    return cte.total_above_threshold(t.orders, "o_custkey", M, D, SINCE, 2_000_000)


@register(
    "cte_topn_then_avg",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
    SELECT o_orderstatus, avg(o_totalprice) AS avg_metric, count(*) AS n_rows FROM r WHERE rn <= 25 GROUP BY o_orderstatus""",
    {"avg_metric": 4},
)
def _(t):
    return cte.topn_then_avg(t.orders, G, M, 25, ["o_orderkey"])


@register(
    "cte_year_summary_having",
    """SELECT o_custkey, count(*) AS n_rows, max(o_totalprice) AS max_metric, min(o_totalprice) AS min_metric FROM orders
    WHERE o_orderdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-12-31' GROUP BY o_custkey HAVING count(*) > 2""",
)
def _(t):
    return cte.year_summary_having(t.orders, "o_custkey", M, D, YEAR)


@register(
    "cte_recent_avg_vs_min",
    """SELECT * FROM (SELECT o_custkey, avg(o_totalprice) AS avg_metric, min(o_totalprice) AS min_metric, max(o_totalprice) AS max_metric
    FROM orders WHERE o_orderdate >= TIMESTAMP '2001-08-02' - INTERVAL 6 MONTH GROUP BY o_custkey) a
    WHERE avg_metric > min_metric * 1.5""",
    {"avg_metric": 4},
)
def _(t):
    return cte.recent_avg_vs_min(t.orders, "o_custkey", M, D, AS_OF)


@register(
    "cte_best_month",
    """WITH m AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice) AS monthly_total FROM orders
    WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY ALL),
    r AS (SELECT *, rank() OVER (PARTITION BY o_orderpriority ORDER BY monthly_total DESC) AS k FROM m)
    SELECT o_orderpriority, month, monthly_total FROM r WHERE k = 1""",
    {"monthly_total": 2},
)
def _(t):
    return cte.best_month(t.orders, "o_orderpriority", M, D, SINCE)


@register(
    "cte_sigma_outlier_count",
    """WITH b AS (SELECT event_type, avg(value) AS mu, stddev_samp(value) AS sd FROM events WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY event_type)
    SELECT e.event_type, count(*) AS outlier_count FROM events e JOIN b ON e.event_type = b.event_type
    WHERE e.ts >= TIMESTAMP '2024-01-05' AND (e.value > mu + 2 * sd OR e.value < mu - 2 * sd) GROUP BY e.event_type""",
)
def _(t):
    return cte.sigma_outlier_count(t.events, "event_type", "value", "ts", "2024-01-05")


@register(
    "cte_half_year_change",
    """WITH p AS (SELECT o_orderpriority,
      sum(CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-07-01' THEN o_totalprice ELSE 0 END) AS first_half,
      sum(CASE WHEN o_orderdate >= TIMESTAMP '1998-07-01' AND o_orderdate <= TIMESTAMP '1998-12-31' THEN o_totalprice ELSE 0 END) AS second_half
      FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-12-31' GROUP BY o_orderpriority)
    SELECT *, second_half - first_half AS difference,
      round((second_half - first_half) / nullif(first_half, 0) * 100, 2) AS pct_change FROM p WHERE first_half > 0""",
    {"first_half": 2, "second_half": 2, "difference": 2},
)
def _(t):
    return cte.half_year_change(t.orders, "o_orderpriority", M, D, YEAR)


@register(
    "cte_yearly_growth_lag",
    """WITH y AS (SELECT year(o_orderdate) AS year, o_orderpriority, sum(o_totalprice) AS yearly_total FROM orders GROUP BY ALL),
    g AS (SELECT *, lag(yearly_total) OVER (PARTITION BY o_orderpriority ORDER BY year) AS prev_year_total FROM y)
    SELECT *, yearly_total - prev_year_total AS growth FROM g WHERE year >= 1998 AND prev_year_total IS NOT NULL""",
    {"yearly_total": 2, "prev_year_total": 2, "growth": 2},
)
def _(t):
    return cte.yearly_growth_lag(t.orders, "o_orderpriority", M, D, YEAR)


@register(
    "cte_significant_categories",
    """SELECT * FROM (SELECT o_custkey, count(*) AS record_count, avg(CAST(o_totalprice AS DECIMAL(18,2))) AS avg_metric, stddev_samp(o_totalprice) AS std_metric
    FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY o_custkey) c
    WHERE record_count >= 5 AND std_metric > avg_metric * 0.2""",
    {"avg_metric": 6, "std_metric": 4},
)
def _(t):
    return cte.significant_categories(cents(t.orders, M), "o_custkey", M, D, SINCE)


@register(
    "cte_top2_quarters",
    """WITH q AS (SELECT o_orderpriority, concat(year(o_orderdate), '-Q', quarter(o_orderdate)) AS quarter,
      sum(o_totalprice) AS quarterly_total, count(*) AS transaction_count FROM orders WHERE year(o_orderdate) = 1998 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY quarterly_total DESC, quarter) AS rn FROM q)
    SELECT o_orderpriority, quarter, quarterly_total, transaction_count FROM r WHERE rn <= 2""",
    {"quarterly_total": 2},
)
def _(t):
    return cte.top2_quarters(t.orders, "o_orderpriority", M, D, YEAR)


@register(
    "cte_cohort_month_avg",
    """WITH c AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS cohort_month, avg(o_totalprice) AS a FROM orders
    WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY ALL)
    SELECT cohort_month, avg(a) AS overall_avg, max(a) AS max_avg, min(a) AS min_avg FROM c GROUP BY cohort_month""",
    {"overall_avg": 4, "max_avg": 4, "min_avg": 4},
)
def _(t):
    return cte.cohort_month_avg(t.orders, "o_orderpriority", M, D, SINCE)


@register(
    "cte_milestone_date",
    """WITH c AS (SELECT o_orderstatus, o_orderdate, sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate) AS s
    FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01')
    SELECT o_orderstatus, min(o_orderdate) AS milestone_date FROM c WHERE s >= 5000000 GROUP BY o_orderstatus""",
)
def _(t):
    return cte.milestone_date(t.orders, G, M, D, SINCE, 5_000_000)


@register(
    "cte_volatility_class",
    """WITH d AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS v FROM orders
      WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY ALL),
    s AS (SELECT o_orderpriority, avg(v) AS avg_daily, stddev_samp(v) AS std_daily, max(v) - min(v) AS range_daily FROM d GROUP BY o_orderpriority)
    SELECT *, CASE WHEN std_daily / nullif(avg_daily, 0) > 0.5 THEN 'High Volatility'
      WHEN std_daily / nullif(avg_daily, 0) > 0.2 THEN 'Medium Volatility' ELSE 'Low Volatility' END AS volatility_category FROM s""",
    {"avg_daily": 4, "std_daily": 4, "range_daily": 2},
)
def _(t):
    return cte.volatility_class(t.orders, "o_orderpriority", M, D, SINCE)


@register(
    "cte_top_and_bottom",
    """WITH s AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY o_custkey)
    SELECT * FROM (SELECT 'Top Performers' AS category, * FROM s ORDER BY total DESC, o_custkey LIMIT 10) a
    UNION ALL SELECT * FROM (SELECT 'Bottom Performers' AS category, * FROM s ORDER BY total, o_custkey LIMIT 10) b""",
    {"total": 2},
)
def _(t):
    return cte.top_and_bottom(t.orders, "o_custkey", M, D, SINCE, 10)


@register(
    "cte_weekly_trend_corr",
    """WITH w AS (SELECT o_orderpriority, isoyear(o_orderdate) * 100 + week(o_orderdate) AS yw, sum(o_totalprice) AS v FROM orders
      WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY ALL),
    c AS (SELECT o_orderpriority, corr(yw, v) AS trend_correlation, count(*) AS n FROM w GROUP BY o_orderpriority HAVING count(*) >= 10)
    SELECT o_orderpriority, trend_correlation, CASE WHEN trend_correlation > 0.5 THEN 'Strong Upward' WHEN trend_correlation > 0 THEN 'Weak Upward'
      WHEN trend_correlation > -0.5 THEN 'Weak Downward' ELSE 'Strong Downward' END AS trend_direction FROM c""",
    {"trend_correlation": 6},
)
def _(t):
    return cte.weekly_trend_corr(t.orders, "o_orderpriority", M, D, SINCE)


@register(
    "date_filter_styles",
    """SELECT 'since_day' AS style, count(*) AS n_rows FROM orders WHERE o_orderdate >= TIMESTAMP '1998-03-15'
    UNION ALL SELECT 'calendar_year_between', count(*) FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-12-31'
    UNION ALL SELECT 'year_equals', count(*) FROM orders WHERE year(o_orderdate) = 1998
    UNION ALL SELECT 'since_month_start', count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1998-03-01'
    UNION ALL SELECT 'last_n_days', count(*) FROM orders WHERE o_orderdate > TIMESTAMP '2001-08-02' - INTERVAL 120 DAY""",
)
def _(t):
    return datefilters.date_filter_styles(t.orders, D, day="1998-03-15", year=YEAR, month=3, as_of=AS_OF, last_days=120)


@register(
    "aggregate_variants",
    """SELECT o_orderpriority, sum(o_totalprice) AS sum_metric, avg(o_totalprice) AS avg_metric, max(o_totalprice) AS max_metric,
    min(o_totalprice) AS min_metric, count(o_totalprice) AS count_metric FROM orders GROUP BY o_orderpriority""",
    {"sum_metric": 2, "avg_metric": 4},
)
def _(t):
    return datefilters.aggregate_variants(t.orders, "o_orderpriority", M)
