"""Join shapes: orders to customer; lineitem to orders where both sides need a date."""

from bindings.registry import register
from tidemark.operators import joins

FK, PK, G1, G2, M, D = "o_custkey", "c_custkey", "o_orderstatus", "c_mktsegment", "o_totalprice", "o_orderdate"
SINCE, AS_OF = "1997-01-01", "2001-08-02"
OC = "orders JOIN customer ON o_custkey = c_custkey"
W = "o_orderdate >= TIMESTAMP '1997-01-01'"


@register(
    "join_inner_total_topn",
    f"""SELECT o_orderstatus, c_mktsegment, sum(o_totalprice) AS total FROM {OC} WHERE {W}
    GROUP BY ALL ORDER BY total DESC LIMIT 10""",
    {"total": 2},
)
def _(t):
    return joins.inner_total_topn(t.orders, t.customer, FK, PK, G1, G2, M, D, SINCE, 10)


@register(
    "join_left_matched_avg",
    """SELECT o_orderstatus, c_mktsegment, avg(o_totalprice) AS avg_metric, count(*) AS record_count
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_custkey IS NOT NULL GROUP BY ALL HAVING count(*) >= 3""",
    {"avg_metric": 4},
)
def _(t):
    return joins.left_matched_avg(t.orders, t.customer, FK, PK, G1, G2, M)


@register(
    "join_related_distinct_count",
    f"""SELECT o_orderstatus, count(DISTINCT c_custkey) AS related_count, max(o_totalprice) AS max_metric FROM {OC} WHERE {W}
    GROUP BY o_orderstatus HAVING max(o_totalprice) > 100000""",
)
def _(t):
    return joins.related_distinct_count(t.orders, t.customer, FK, PK, G1, M, D, SINCE, 100_000)


@register(
    "join_share_of_total",
    f"""SELECT o_orderstatus, c_mktsegment, sum(o_totalprice) AS total,
    round(sum(o_totalprice) * 100.0 / sum(sum(o_totalprice)) OVER (), 2) AS percentage FROM {OC} WHERE {W}
    GROUP BY ALL HAVING sum(o_totalprice) > 100000""",
    {"total": 2},
)
def _(t):
    return joins.share_of_total(t.orders, t.customer, FK, PK, G1, G2, M, D, SINCE, 100_000)


@register(
    "join_right_stats",
    """SELECT o_orderstatus, c_mktsegment, avg(o_totalprice) AS avg_metric, min(o_totalprice) AS min_metric, max(o_totalprice) AS max_metric,
    stddev_samp(o_totalprice) AS stddev_metric FROM orders RIGHT JOIN customer ON o_custkey = c_custkey WHERE o_orderdate IS NOT NULL GROUP BY ALL""",
    {"avg_metric": 4, "stddev_metric": 4},
)
def _(t):
    return joins.right_stats(t.orders, t.customer, FK, PK, G1, G2, M, D)


@register(
    "join_full_outer_activity",
    """SELECT l_returnflag, o_orderpriority, count(DISTINCT l_partkey) AS unique_records, sum(l_extendedprice) AS total_metric
    FROM lineitem FULL OUTER JOIN orders ON l_orderkey = o_orderkey
    WHERE l_shipdate >= TIMESTAMP '1997-01-01' OR o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY ALL""",
    {"total_metric": 2},
)
def _(t):
    return joins.full_outer_activity(
        t.lineitem, t.orders, "l_orderkey", "o_orderkey", "l_partkey", "l_returnflag", "o_orderpriority",
        "l_extendedprice", "l_shipdate", D, SINCE,
    )


@register(
    "join_above_avg_with_group_avg",
    f"""SELECT o_orderstatus, c_mktsegment, o_totalprice AS table1_metric, avg(o_totalprice) OVER (PARTITION BY c_mktsegment) AS avg_by_table2
    FROM {OC} WHERE {W} AND o_totalprice > (SELECT avg(o_totalprice) FROM orders)""",
    {"avg_by_table2": 4},
)
def _(t):
    return joins.above_avg_with_group_avg(t.orders, t.customer, FK, PK, G1, G2, M, D, SINCE)


@register(
    "join_high_value_rate",
    f"""SELECT c_mktsegment, count(DISTINCT o_orderkey) AS related_count,
    CAST(sum(CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END) AS BIGINT) AS high_value_count,
    round(sum(CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END) * 100.0 / count(*), 2) AS high_value_pct
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE {W} OR o_orderdate IS NULL
    GROUP BY c_mktsegment HAVING count(DISTINCT o_orderkey) > 0""",
)
def _(t):
    return joins.high_value_rate(t.orders, t.customer, FK, PK, "o_orderkey", G2, M, D, SINCE, 300_000)


@register(
    "join_activity_span",
    f"""SELECT o_orderstatus, c_mktsegment, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date,
    date_diff('day', min(o_orderdate), max(o_orderdate)) AS days_span, sum(o_totalprice) AS total_metric
    FROM {OC} WHERE {W} GROUP BY ALL HAVING date_diff('day', min(o_orderdate), max(o_orderdate)) >= 30""",
    {"total_metric": 2},
)
def _(t):
    return joins.activity_span(t.orders, t.customer, FK, PK, G1, G2, M, D, SINCE)


@register(
    "join_rank_within_group",
    f"""SELECT c_mktsegment, o_orderstatus, o_totalprice, rank() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC) AS rank_within_group
    FROM {OC} WHERE {W} QUALIFY rank_within_group <= 10""",
)
def _(t):
    return joins.rank_within_group(t.orders, t.customer, FK, PK, G1, G2, M, D, SINCE, 10)


@register(
    "join_category_list",
    f"""WITH j AS (SELECT o_orderstatus, c_mktsegment, o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE {W}),
    g AS (SELECT o_orderstatus, count(DISTINCT c_mktsegment) AS distinct_categories, avg(o_totalprice) AS avg_metric FROM j GROUP BY 1 HAVING count(DISTINCT c_mktsegment) >= 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY c_mktsegment) AS place FROM (SELECT DISTINCT o_orderstatus, c_mktsegment FROM j WHERE c_mktsegment IS NOT NULL)),
    p AS (SELECT o_orderstatus, ((place - 1) // 2)::BIGINT AS page, string_agg(c_mktsegment, ', ' ORDER BY place) AS category_list FROM k GROUP BY 1, 2)
    SELECT o_orderstatus, page, distinct_categories, category_list, avg_metric FROM p JOIN g USING (o_orderstatus)""",
    {"avg_metric": 4},
)
def _(t):
    """Pages of two names, so that the few segments of the test table fill several."""
    return joins.category_list(t.orders, t.customer, FK, PK, G1, G2, M, D, SINCE, page=2)


@register(
    "join_tier_counts",
    f"""SELECT c_mktsegment,
    CAST(sum(CASE WHEN o_totalprice BETWEEN 0 AND 450000/3 THEN 1 ELSE 0 END) AS BIGINT) AS low_tier,
    CAST(sum(CASE WHEN o_totalprice BETWEEN 450000/3 AND 2*450000/3 THEN 1 ELSE 0 END) AS BIGINT) AS mid_tier,
    CAST(sum(CASE WHEN o_totalprice > 2*450000/3 THEN 1 ELSE 0 END) AS BIGINT) AS high_tier
    FROM {OC} WHERE {W} GROUP BY c_mktsegment""",
)
def _(t):
    return joins.tier_counts(t.orders, t.customer, FK, PK, G2, M, D, SINCE, 450_000)


@register(
    "join_deviation_filter",
    f"""SELECT * FROM (SELECT o_orderstatus, c_mktsegment, o_totalprice,
    o_totalprice - avg(o_totalprice) OVER (PARTITION BY c_mktsegment) AS deviation_from_group_avg FROM {OC} WHERE {W}) d
    WHERE abs(deviation_from_group_avg) > 200000""",
    {"deviation_from_group_avg": 4},
)
def _(t):
    return joins.deviation_filter(t.orders, t.customer, FK, PK, G1, G2, M, D, SINCE, 200_000)


@register(
    "join_five_number_summary",
    f"""SELECT c_mktsegment, min(o_totalprice) AS min_value, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median,
    quantile_cont(o_totalprice, 0.75) AS q3, max(o_totalprice) AS max_value FROM {OC} WHERE {W} GROUP BY c_mktsegment""",
    {"q1": 4, "median": 4, "q3": 4},
)
def _(t):
    return joins.five_number_summary(t.orders, t.customer, FK, PK, G2, M, D, SINCE)


@register(
    "join_recent_active_count",
    """WITH a AS (SELECT o_custkey, c_mktsegment, max(o_orderdate) AS last_activity FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
    SELECT c_mktsegment, count(*) AS active_count FROM a WHERE last_activity >= TIMESTAMP '2001-08-02' - INTERVAL 90 DAY GROUP BY c_mktsegment""",
)
def _(t):
    return joins.recent_active_count(t.orders, t.customer, FK, PK, "o_custkey", G2, D, AS_OF)
