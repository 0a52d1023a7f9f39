"""Window shapes on orders, group o_orderstatus, partition o_orderpriority, key o_orderkey."""

from bindings.registry import register
from tidemark.operators import windows as win

G, P, M, D, K = "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate", ["o_orderkey"]
SINCE = "1997-01-01"
FROM = "FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'"
PART = "PARTITION BY o_orderpriority"
GD = "PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey"


@register(
    "win_rank_topn_with_avg",
    f"""SELECT * FROM (SELECT o_orderstatus, o_totalprice, rank() OVER ({PART} ORDER BY o_totalprice DESC) AS rank,
    avg(o_totalprice) OVER ({PART}) AS avg_metric {FROM}) r WHERE rank <= 10""",
    {"avg_metric": 4},
)
def _(t):
    return win.rank_topn_with_avg(t.orders, G, P, M, D, SINCE, 10)


@register(
    "win_lag_lead_change",
    f"""SELECT o_orderstatus, o_orderdate, o_totalprice, o_orderkey, lag(o_totalprice) OVER w AS prev_metric,
    lead(o_totalprice) OVER w AS next_metric, o_totalprice - lag(o_totalprice) OVER w AS change {FROM} WINDOW w AS ({GD})""",
    {"change": 4},
)
def _(t):
    return win.lag_lead_change(t.orders, G, M, D, SINCE, K)


@register(
    "win_row_number_percent_rank_cume",
    f"""SELECT o_orderstatus, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS overall_rank,
    percent_rank() OVER ({PART} ORDER BY o_totalprice) AS percentile, cume_dist() OVER ({PART} ORDER BY o_totalprice) AS cumulative_dist {FROM}""",
    {"percentile": 9, "cumulative_dist": 9},
)
def _(t):
    return win.row_number_percent_rank_cume(t.orders, G, P, M, D, SINCE, K)


@register(
    "win_running_total_mavg3",
    f"""SELECT o_orderstatus, o_totalprice, o_orderdate, o_orderkey,
    sum(o_totalprice) OVER ({PART} ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_total,
    avg(o_totalprice) OVER ({PART} ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS moving_avg_3 {FROM}""",
    {"running_total": 2, "moving_avg_3": 4},
)
def _(t):
    return win.running_total_mavg3(t.orders, G, P, M, D, SINCE, K)


@register(
    "win_ntile_dense_rank",
    f"""SELECT o_orderstatus, o_orderpriority, o_totalprice, ntile(4) OVER ({PART} ORDER BY o_totalprice, o_orderkey) AS quartile,
    dense_rank() OVER ({PART} ORDER BY o_totalprice DESC) AS dense_rank, rank() OVER ({PART} ORDER BY o_totalprice DESC) AS rank {FROM}""",
)
def _(t):
    return win.ntile_dense_rank(t.orders, G, P, M, D, SINCE, K)


@register(
    "win_first_last_value",
    f"""SELECT o_orderstatus, o_orderdate, o_totalprice, first_value(o_totalprice) OVER w AS period_start_value,
    last_value(o_totalprice) OVER w AS period_end_value, o_totalprice - first_value(o_totalprice) OVER w AS change_from_start
    {FROM} WINDOW w AS ({PART} ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    {"change_from_start": 4},
)
def _(t):
    return win.first_last_value(t.orders, G, P, M, D, SINCE, K)


@register(
    "win_sigma_category",
    f"""SELECT o_orderstatus, o_orderpriority, o_totalprice, o_orderdate, o_totalprice - avg(o_totalprice) OVER w AS deviation_from_avg,
    CASE WHEN o_totalprice > avg(o_totalprice) OVER w + stddev_samp(o_totalprice) OVER w THEN 'Above Avg'
    WHEN o_totalprice < avg(o_totalprice) OVER w - stddev_samp(o_totalprice) OVER w THEN 'Below Avg' ELSE 'Within Avg' END AS performance_category
    {FROM} WINDOW w AS ({PART})""",
    {"deviation_from_avg": 4},
)
def _(t):
    return win.sigma_category(t.orders, G, P, M, D, SINCE)


@register(
    "win_pct_total_to_date",
    f"""SELECT o_orderstatus, o_orderdate, o_totalprice, o_orderkey,
    sum(o_totalprice) OVER ({PART} ORDER BY o_orderdate) / sum(o_totalprice) OVER ({PART}) * 100 AS pct_of_total_to_date,
    row_number() OVER ({PART} ORDER BY o_orderdate, o_orderkey) AS period_number {FROM}""",
    {"pct_of_total_to_date": 6},
)
def _(t):
    return win.pct_total_to_date(t.orders, G, P, M, D, SINCE, K)


@register(
    "win_pareto_cumulative",
    f"""SELECT o_orderstatus, o_orderpriority, o_totalprice, o_orderdate, o_totalprice / sum(o_totalprice) OVER ({PART}) * 100 AS pct_of_partition,
    sum(o_totalprice) OVER ({PART} ORDER BY o_totalprice DESC) / sum(o_totalprice) OVER ({PART}) * 100 AS cumulative_pct {FROM}""",
    {"pct_of_partition": 6, "cumulative_pct": 6},
)
def _(t):
    return win.pareto_cumulative(t.orders, G, P, M, D, SINCE, K)


@register(
    "win_mavg7_deviation",
    f"""SELECT o_orderstatus, o_totalprice, o_orderdate, o_orderkey, avg(o_totalprice) OVER w AS moving_avg,
    o_totalprice - avg(o_totalprice) OVER w AS deviation_from_ma {FROM}
    WINDOW w AS (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    {"moving_avg": 4, "deviation_from_ma": 4},
)
def _(t):
    return win.mavg7_deviation(t.orders, G, M, D, SINCE, K)


@register(
    "win_decile_bounds",
    f"""SELECT o_orderstatus, o_orderpriority, o_totalprice, decile, min(o_totalprice) OVER (PARTITION BY o_orderpriority, decile) AS decile_min,
    max(o_totalprice) OVER (PARTITION BY o_orderpriority, decile) AS decile_max
    FROM (SELECT *, ntile(10) OVER ({PART} ORDER BY o_totalprice, o_orderkey) AS decile {FROM}) d""",
)
def _(t):
    return win.decile_bounds(t.orders, G, P, M, D, SINCE, K)


@register(
    "win_next_change_trend",
    f"""SELECT o_orderstatus, o_orderdate, o_totalprice, o_orderkey, lead(o_totalprice) OVER w - o_totalprice AS next_period_change,
    CASE WHEN lead(o_totalprice) OVER w > o_totalprice THEN 'Increasing' WHEN lead(o_totalprice) OVER w < o_totalprice THEN 'Decreasing'
    ELSE 'Stable' END AS trend_direction {FROM} WINDOW w AS ({GD})""",
    {"next_period_change": 4},
)
def _(t):
    return win.next_change_trend(t.orders, G, M, D, SINCE, K)


@register(
    "win_topn_percentile",
    f"""SELECT * FROM (SELECT o_orderstatus, o_orderpriority, o_totalprice, row_number() OVER ({PART} ORDER BY o_totalprice DESC, o_orderkey) AS row_num,
    count(*) OVER ({PART}) AS partition_size,
    round(row_number() OVER ({PART} ORDER BY o_totalprice DESC, o_orderkey) * 100.0 / count(*) OVER ({PART}), 2) AS percentile_rank {FROM}) r
    WHERE row_num <= 15""",
)
def _(t):
    return win.topn_percentile(t.orders, G, P, M, D, SINCE, 15, K)


@register(
    "win_forward3_sum_avg",
    f"""SELECT o_orderstatus, o_orderdate, o_totalprice, o_orderkey, sum(o_totalprice) OVER w AS forward_3period_sum,
    avg(o_totalprice) OVER w AS forward_3period_avg {FROM} WINDOW w AS ({GD} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)""",
    {"forward_3period_sum": 2, "forward_3period_avg": 4},
)
def _(t):
    return win.forward3_sum_avg(t.orders, G, M, D, SINCE, K)


@register(
    "win_minmax_normalize",
    f"""SELECT o_orderstatus, o_orderpriority, o_totalprice, o_orderdate, o_totalprice - min(o_totalprice) OVER w AS distance_from_min,
    max(o_totalprice) OVER w - o_totalprice AS distance_from_max,
    (o_totalprice - min(o_totalprice) OVER w) / nullif(max(o_totalprice) OVER w - min(o_totalprice) OVER w, 0) AS normalized_score
    {FROM} WINDOW w AS ({PART})""",
    {"distance_from_min": 4, "distance_from_max": 4, "normalized_score": 6},
)
def _(t):
    return win.minmax_normalize(t.orders, G, P, M, D, SINCE)
