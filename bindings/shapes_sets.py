"""Set-operation shapes: orders.o_custkey against lineitem.l_suppkey."""

from bindings.registry import cents, register
from tidemark.operators import setops

V1, V2 = "o_custkey", "l_suppkey"
M1, M2 = "o_totalprice", "l_extendedprice"
D1, D2 = "o_orderdate", "l_shipdate"
SINCE = "1997-01-01"


@register(
    "set_union_distinct_values",
    """SELECT o_custkey AS value FROM orders WHERE o_custkey IS NOT NULL
    UNION SELECT l_suppkey FROM lineitem WHERE l_suppkey IS NOT NULL""",
)
def _(t):
    return setops.union_distinct_values(t.orders, t.lineitem, V1, V2)


@register("set_intersect", "SELECT o_custkey AS value FROM orders INTERSECT SELECT l_suppkey FROM lineitem")
def _(t):
    return setops.intersect(t.orders, t.lineitem, V1, V2)


@register("set_except", "SELECT o_custkey AS value FROM orders EXCEPT SELECT l_suppkey FROM lineitem")
def _(t):
    return setops.except_(t.orders, t.lineitem, V1, V2)


@register(
    "set_union_all_counts",
    """SELECT o_custkey AS value, count(*) AS n_rows FROM orders GROUP BY o_custkey
    UNION ALL SELECT l_suppkey, count(*) FROM lineitem GROUP BY l_suppkey""",
)
def _(t):
    return setops.union_all_counts(t.orders, t.lineitem, V1, V2)


@register(
    "set_topn_each_side",
    """SELECT * FROM (SELECT o_custkey AS value, o_totalprice AS metric FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'
      ORDER BY metric DESC, value LIMIT 20) a
    UNION ALL SELECT * FROM (SELECT l_suppkey AS value, l_extendedprice AS metric FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01'
      ORDER BY metric DESC, value LIMIT 20) b""",
)
def _(t):
    return setops.topn_each_side(t.orders, t.lineitem, V1, V2, M1, M2, D1, D2, SINCE, 20)


@register(
    "set_overlap_summary",
    """SELECT 'Only in orders' AS source, count(*) AS n_values FROM (SELECT o_custkey FROM orders EXCEPT SELECT l_suppkey FROM lineitem) a
    UNION ALL SELECT 'Only in lineitem', count(*) FROM (SELECT l_suppkey FROM lineitem EXCEPT SELECT o_custkey FROM orders) b
    UNION ALL SELECT 'In both tables', count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT l_suppkey FROM lineitem) c""",
)
def _(t):
    return setops.overlap_summary(t.orders, t.lineitem, V1, V2, "orders", "lineitem")


@register(
    "set_activity_status",
    """SELECT o_custkey AS value, 'Active in orders' AS status FROM orders WHERE o_orderdate >= TIMESTAMP '2001-06-01'
    UNION SELECT l_suppkey, 'Active in lineitem' FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01'""",
)
def _(t):
    return setops.activity_status(t.orders, t.lineitem, V1, V2, D1, D2, "2001-06-01", "orders", "lineitem")


@register(
    "set_max_each_side",
    """SELECT o_custkey AS value, max(o_totalprice) AS max_value FROM orders GROUP BY o_custkey
    UNION ALL SELECT l_suppkey, max(l_extendedprice) FROM lineitem GROUP BY l_suppkey""",
)
def _(t):
    return setops.max_each_side(t.orders, t.lineitem, V1, V2, M1, M2)


@register(
    "set_intersect_above",
    """SELECT o_custkey AS value FROM orders WHERE o_totalprice > 90000
    INTERSECT SELECT l_suppkey FROM lineitem WHERE l_extendedprice > 90000""",
)
def _(t):
    return setops.intersect_above(t.orders, t.lineitem, V1, V2, M1, M2, 90_000)


@register(
    "set_singletons_of_union",
    """SELECT value, count(*) AS frequency FROM (SELECT user_id AS value FROM events UNION ALL SELECT c_custkey FROM customer) u
    GROUP BY value HAVING count(*) = 1""",
)
def _(t):
    return setops.singletons_of_union(t.events, t.customer, "user_id", "c_custkey")


@register(
    "set_labelled_totals",
    """SELECT 'orders' AS source, o_custkey AS value, sum(o_totalprice) AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY o_custkey
    UNION ALL SELECT 'lineitem', l_suppkey, sum(l_extendedprice) FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY l_suppkey""",
    {"total": 2},
)
def _(t):
    return setops.labelled_totals(t.orders, t.lineitem, V1, V2, M1, M2, D1, D2, SINCE, "orders", "lineitem")


@register(
    "set_new_vs_old_except",
    """SELECT o_custkey AS value FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'
    EXCEPT SELECT l_suppkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01'""",
)
def _(t):
    return setops.new_vs_old_except(t.orders, t.lineitem, V1, V2, D1, D2, SINCE)


@register(
    "set_union_high_avg",
    """SELECT o_custkey AS value, round(avg(CAST(o_totalprice AS DECIMAL(18,2))), 6) AS avg_metric FROM orders GROUP BY o_custkey HAVING avg(o_totalprice) > 50000
    UNION SELECT l_suppkey, round(avg(CAST(l_extendedprice AS DECIMAL(18,2))), 6) FROM lineitem GROUP BY l_suppkey HAVING avg(l_extendedprice) > 50000""",
    {"avg_metric": 6},
)
def _(t):
    return setops.union_high_avg(cents(t.orders, M1), cents(t.lineitem, M2), V1, V2, M1, M2, 50_000)


@register(
    "set_common_vs_unique",
    """SELECT value, 'Common' AS category, count(*) AS record_count FROM (SELECT o_custkey AS value FROM orders INTERSECT SELECT l_suppkey FROM lineitem) a GROUP BY value
    UNION ALL SELECT value, 'Unique to orders', count(*) FROM (SELECT o_custkey AS value FROM orders EXCEPT SELECT l_suppkey FROM lineitem) b GROUP BY value""",
)
def _(t):
    return setops.common_vs_unique(t.orders, t.lineitem, V1, V2, "orders")


@register(
    "set_union_topn",
    """SELECT * FROM (SELECT o_custkey AS value, o_totalprice AS metric FROM orders WHERE o_totalprice >= 50000 AND o_orderdate >= TIMESTAMP '1997-01-01'
    UNION SELECT l_suppkey, l_extendedprice FROM lineitem WHERE l_extendedprice >= 50000 AND l_shipdate >= TIMESTAMP '1997-01-01') u
    ORDER BY metric DESC, value LIMIT 50""",
)
def _(t):
    return setops.union_topn(t.orders, t.lineitem, V1, V2, M1, M2, D1, D2, SINCE, 50_000, 50)
