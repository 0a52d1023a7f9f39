"""Subquery shapes on orders; customer to orders for parent and child."""

from bindings.registry import cents, register
from tidemark.operators import subqueries as sq

G, M, D = "o_orderstatus", "o_totalprice", "o_orderdate"
SINCE = "1997-01-01"
W = "o_orderdate >= TIMESTAMP '1997-01-01'"


@register(
    "sub_above_global_avg",
    f"SELECT o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) AND {W}",
)
def _(t):
    return sq.above_global_avg(t.orders, G, M, D, SINCE)


@register(
    "sub_correlated_child_stats",
    """SELECT c_mktsegment, c_acctbal, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS related_count,
    (SELECT avg(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders WHERE o_custkey = c_custkey) AS avg_related
    FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) > 0""",
    {"avg_related": 6},
)
def _(t):
    return sq.correlated_child_stats(t.customer, cents(t.orders, M), "c_custkey", "o_custkey", "c_mktsegment", "c_acctbal", M)


@register(
    "sub_ge_latest_in_group",
    f"""WITH l AS (SELECT o_orderpriority AS g, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY 1)
    SELECT o_orderpriority, o_totalprice, o_orderdate FROM orders JOIN l ON g = o_orderpriority WHERE o_totalprice >= latest AND {W}""",
)
def _(t):
    return sq.ge_latest_in_group(t.orders, "o_orderpriority", M, D, SINCE, ["o_orderkey"])


@register(
    "sub_in_big_groups",
    f"""SELECT o_custkey, count(*) AS n_rows, avg(CAST(o_totalprice AS DECIMAL(18,2))) AS avg_metric FROM orders WHERE o_custkey IN (
    SELECT o_custkey FROM orders WHERE {W} GROUP BY o_custkey HAVING sum(o_totalprice) > 2000000) AND {W} GROUP BY o_custkey""",
    {"avg_metric": 6},
)
def _(t):
    return sq.in_big_groups(cents(t.orders, M), "o_custkey", M, D, SINCE, 2_000_000)


@register(
    "sub_group_max_rows",
    f"""SELECT o_custkey, o_totalprice, o_orderdate FROM orders t1 WHERE o_totalprice = (
    SELECT max(o_totalprice) FROM orders t2 WHERE t2.o_custkey = t1.o_custkey AND t2.{W}) AND {W}""",
)
def _(t):
    return sq.group_max_rows(t.orders, "o_custkey", M, D, SINCE)


@register(
    "sub_gt_all_prior_90d",
    f"""SELECT o_orderstatus, o_totalprice FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate
    RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND INTERVAL 1 SECOND PRECEDING) AS bar FROM orders) b
    WHERE (bar IS NULL OR o_totalprice > bar) AND {W}""",
)
def _(t):
    return sq.gt_all_prior(t.orders, G, M, D, SINCE)


@register(
    "sub_overall_rank_topn",
    f"""SELECT o_orderstatus, o_totalprice, overall_rank FROM (SELECT *, rank() OVER (ORDER BY o_totalprice DESC) AS overall_rank FROM orders) r
    WHERE {W} ORDER BY overall_rank, o_orderkey LIMIT 25""",
)
def _(t):
    return sq.overall_rank_topn(t.orders, G, M, D, SINCE, 25, ["o_orderkey"])


@register(
    "sub_above_q3",
    f"""SELECT o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_totalprice > (
    SELECT quantile_cont(o_totalprice, 0.75) FROM orders WHERE {W}) AND {W}""",
)
def _(t):
    return sq.above_q3(t.orders, G, M, D, SINCE)


@register(
    "sub_group_vs_overall_avg",
    f"""SELECT o_custkey, count(*) AS total_records, avg(CAST(o_totalprice AS DECIMAL(18,2))) AS avg_metric, (SELECT avg(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders) AS overall_avg,
    avg(CAST(o_totalprice AS DECIMAL(18,2))) - (SELECT avg(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders) AS avg_difference FROM orders WHERE {W}
    GROUP BY o_custkey HAVING avg(CAST(o_totalprice AS DECIMAL(18,2))) > (SELECT avg(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders)""",
    {"avg_metric": 6, "overall_avg": 4, "avg_difference": 4},
)
def _(t):
    return sq.group_vs_overall_avg(cents(t.orders, M), "o_custkey", M, D, SINCE)


@register(
    "sub_exists_high_child",
    """SELECT c_mktsegment, c_acctbal, c_name FROM customer WHERE EXISTS (
    SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)""",
)
def _(t):
    return sq.exists_high_child(t.customer, t.orders, "c_custkey", "o_custkey", ["c_mktsegment", "c_acctbal", "c_name"], M, 450_000)


@register(
    "sub_distinct_better_groups",
    f"""WITH g AS (SELECT o_custkey, max(o_totalprice) AS mx FROM orders GROUP BY o_custkey),
    c AS (SELECT o_custkey, o_orderkey, o_totalprice, (SELECT count(*) FROM g WHERE mx > o_totalprice) AS better_count,
      (SELECT count(DISTINCT o_custkey) FROM orders) AS total_count FROM orders WHERE {W}
      ORDER BY o_totalprice DESC, o_orderkey LIMIT 25)
    SELECT o_custkey, o_totalprice, better_count, total_count, round(better_count * 100.0 / total_count, 2) AS percentile FROM c""",
)
def _(t):
    return sq.distinct_better_groups(t.orders, "o_custkey", M, D, SINCE, 25, ["o_orderkey"])


@register(
    "sub_pct_of_total_ge5",
    f"""WITH t AS (SELECT sum(o_totalprice) AS grand FROM orders WHERE {W})
    SELECT o_orderpriority, sum(o_totalprice) AS total_metric, any_value(grand) AS grand_total,
    round(sum(o_totalprice) * 100.0 / any_value(grand), 2) AS pct_of_total FROM orders, t WHERE {W}
    GROUP BY o_orderpriority HAVING sum(o_totalprice) * 100.0 / any_value(grand) >= 5""",
    {"total_metric": 2, "grand_total": 2},
)
def _(t):
    return sq.pct_of_total_ge(t.orders, "o_orderpriority", M, D, SINCE)


@register(
    "sub_repeated_metric_rows",
    """SELECT l_returnflag, l_quantity, l_shipdate FROM lineitem WHERE l_quantity IN (
    SELECT l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01' GROUP BY l_quantity HAVING count(*) >= 2)
    AND l_shipdate >= TIMESTAMP '2001-06-01'""",
)
def _(t):
    return sq.repeated_metric_rows(t.lineitem, "l_returnflag", "l_quantity", "l_shipdate", "2001-06-01")


@register(
    "sub_recent_and_lifetime",
    """WITH k AS (SELECT o_custkey, CAST(sum(CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN 1 ELSE 0 END) AS BIGINT) AS recent_count,
      sum(o_totalprice) AS lifetime_total FROM orders GROUP BY o_custkey)
    SELECT c_mktsegment, c_acctbal, recent_count, lifetime_total FROM customer JOIN k ON o_custkey = c_custkey WHERE recent_count >= 3""",
    {"lifetime_total": 2},
)
def _(t):
    return sq.recent_and_lifetime(t.customer, t.orders, "c_custkey", "o_custkey", "c_mktsegment", "c_acctbal", M, D, "2000-01-01")


@register(
    "sub_group_avg_far_from_mean",
    f"""WITH o AS (SELECT avg(CAST(o_totalprice AS DECIMAL(18,2))) AS mu, stddev_samp(o_totalprice) AS sd FROM orders WHERE {W})
    SELECT o_custkey, avg(CAST(o_totalprice AS DECIMAL(18,2))) AS avg_metric, any_value(sd) AS overall_stddev FROM orders, o WHERE {W}
    GROUP BY o_custkey HAVING abs(avg(CAST(o_totalprice AS DECIMAL(18,2))) - any_value(mu)) > 0.25 * any_value(sd)""",
    {"avg_metric": 6, "overall_stddev": 4},
)
def _(t):
    return sq.group_avg_far_from_mean(cents(t.orders, M), "o_custkey", M, D, SINCE, k=0.25)
