"""The synthetic rows as one DuckDB statement: catalogue, eligible pairs, draws and texts."""

from __future__ import annotations

from tidemark.plans import domains, synthetic, templates

#: Tables of each domain, with their columns and types.
DOMAINS = {
    "sales": ("what customers order", {
        "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
        "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
        "lineitem": "l_orderkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
        "nation": "n_nationkey int, n_name string, n_regionkey int",
    }),
    "supply": ("who supplies which parts", {
        "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
        "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
        "nation": "n_nationkey int, n_name string, n_regionkey int",
    }),
    "usage": ("what users do", {"events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"}),
}
_TYPES = {"int": "INT", "bigint": "BIGINT", "double": "DOUBLE", "timestamp": "TIMESTAMP", "string": "VARCHAR(255)"}


def columns_of(text: str) -> list[tuple]:
    return [tuple(c.split(" ")) for c in text.split(", ")]


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _texts(values) -> str:
    return "[" + ", ".join(map(_text, values)) + "]::VARCHAR[]"


def catalogue_sql() -> str:
    """Columns of the domains, and what each is for: the rules of the catalogue as statements."""
    rows = ", ".join(
        f"({_text(d)}, {_text(about)}, {_text(tab)}, {i}, {pos}, {_text(c)}, {_text(kind)})"
        for d, (about, tables) in DOMAINS.items()
        for i, (tab, cols) in enumerate(tables.items())
        for pos, (c, kind) in enumerate(columns_of(cols))
    )
    return f"""cols(domain, description, tab, ord, pos, col, kind) AS (VALUES {rows}),
    keyed AS (SELECT *, first_value(col) OVER (PARTITION BY domain, tab ORDER BY pos) AS pk, regexp_replace(col, '^[^_]*_', '') AS ending FROM cols),
    refs AS (
      SELECT c.domain, c.tab, c.pos, c.col, arg_max(o.tab, o.ord) AS other FROM keyed c JOIN keyed o
      ON o.domain = c.domain AND o.tab <> c.tab AND o.col = o.pk AND o.ending = c.ending AND c.col <> c.pk GROUP BY ALL
    ),
    used AS (SELECT k.*, r.other FROM keyed k LEFT JOIN refs r ON k.domain = r.domain AND k.tab = r.tab AND k.col = r.col),
    tabs AS (
      SELECT domain, any_value(description) AS description, tab, pk,
        coalesce(list(col ORDER BY pos) FILTER (col <> pk AND other IS NULL AND kind = 'string'), [pk]) AS g,
        coalesce(list(col ORDER BY pos) FILTER (col <> pk AND other IS NULL AND kind IN ('int', 'bigint', 'double')), []::VARCHAR[]) AS m,
        coalesce(list(col ORDER BY pos) FILTER (col <> pk AND other IS NULL AND kind IN ('date', 'timestamp')), []::VARCHAR[]) AS d
      FROM used GROUP BY domain, tab, pk
    )"""


def pairs_sql() -> str:
    """Templates, and for each the domains with enough tables that have what it needs."""
    rows = ", ".join(
        f"({_text(r['cls'])}, {_text(r['template'])}, {r['n_tables']}, {'m' in r['needs']}, {'d' in r['needs']}, {_texts(r['verbs'])}, "
        f"{_text(r['sql'])}, {_texts(r['prompts'])}, {_text(r['explanation'])})"
        for r in templates.template_rows()
    )
    return f"""templates(cls, template, n_tables, needs_m, needs_d, verbs, sql, prompts, explanation) AS (VALUES {rows}),
    fitting AS (
      SELECT cls, template, n_tables, domain, any_value(description) AS description, list(tab ORDER BY tab) AS tabs FROM templates, tabs
      WHERE (NOT needs_m OR len(m) > 0) AND (NOT needs_d OR len(d) > 0) GROUP BY cls, template, n_tables, domain HAVING count(*) >= n_tables
    ),
    pairs AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY template, domain) - 1 AS slot, count(*) OVER (PARTITION BY cls) AS n_pairs FROM fitting)"""


def _contexts_sql() -> str:
    parts = []
    for d, (_, tables) in DOMAINS.items():
        for tab, cols in tables.items():
            names = [c for c, _ in columns_of(cols)]
            typed = ", ".join(f"{c} {_TYPES[k]}" for c, k in columns_of(cols))
            cells = " || ', ' || ".join(
                f"coalesce('''' || {c}::VARCHAR || '''', 'NULL')" if k in ("string", "timestamp") else f"coalesce({c}::VARCHAR, 'NULL')" for c, k in columns_of(cols)
            )
            head = f"CREATE TABLE {tab} ({typed}); INSERT INTO {tab} ({', '.join(names)}) VALUES "
            parts.append(
                f"""SELECT {_text(d)} AS domain, {_text(tab)} AS tab, {_text(head)} || string_agg('(' || {cells} || ')', ', ' ORDER BY place) || ';' AS context
                FROM (SELECT {', '.join(names)}, row_number() OVER (ORDER BY {', '.join(names)}) AS place FROM {tab}) x WHERE place <= {domains.SAMPLE_ROWS}"""
            )
    return "contexts AS (" + " UNION ALL ".join(parts) + ")"


def _draw(n, slot: str) -> str:
    return f"(('0x' || substr(md5('42/{slot}:' || id), 1, 12))::BIGINT % ({n}))"


def _one_of(values: str, slot: str) -> str:
    return f"list_extract({values}, {_draw(f'greatest(len({values}), 1)', slot)} + 1)"


def synthetic_sql(need: str) -> str:
    """The rows for ``need (sql_complexity, needed)``."""
    since = [
        "'WHERE {date_col} >= ''' || date_string || ''''",
        "'WHERE {date_col} BETWEEN ''' || year || '-01-01'' AND ''' || year || '-12-31'''",
        "'WHERE YEAR({date_col}) = ' || year",
        "'WHERE {date_col} >= ''' || year || '-' || month || '-01'''",
        f"'WHERE {{date_col}} > DATE_SUB(CURDATE(), INTERVAL ' || ({_draw(336, 'days')} + 30) || ' DAY)'",
    ]
    where = " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(since))
    relation = "(SELECT arg_min(col, pos) FROM refs r WHERE r.domain = z.domain AND r.tab = z.{0} AND r.other = z.{1})"
    values = {
        "table1": "t1", "table2": "t2", "group_col": _one_of("g1", "group"), "group_col1": _one_of("g1", "group1"), "group_col2": _one_of("g2", "group2"),
        "partition_col": _one_of("g1", "part"), "metric_col": "metric_col", "metric_col2": f"coalesce({_one_of('m2', 'metric2')}, metric_col)",
        "date_col": "date_col", "year": "year", "month": "month", "day": "day", "date_string": "date_string", "threshold": "threshold",
        "threshold2": f"threshold + {_draw('least(50000, 150000 - threshold) + 1', 'threshold2')}", "top_n": f"{_draw(50, 'top_n')} + 1",
        "cte_name": "t1 || '_summary'", "pk1": "pk1", "pk2": "pk2", "fk1": "coalesce(fk12, fk21, 'id')", "verb": _one_of("verbs", "verb"),
        "comparison_op": _one_of("['>', '>=', '<', '<=', '!=']", "op"),
    }
    drawn = ", ".join(f"coalesce(({v})::VARCHAR, '') AS v_{k}" for k, v in values.items())

    def filled(text: str) -> str:
        for k in values:
            text = f"replace({text}, '{{{k}}}', v_{k})"
        return text

    statement = f"replace(replace(sql, 'SUM(', agg_func || '('), {_text(templates.BASE_DATE)}, since)"
    return f"""WITH {catalogue_sql()}, {pairs_sql()}, {_contexts_sql()},
    wanted AS (
      SELECT sql_complexity AS cls, needed, sum(needed) OVER (ORDER BY sql_complexity) - needed AS before FROM ({need}) n
      WHERE sql_complexity IN ({', '.join(map(_text, templates.CLASSES))}) AND needed > 0
    ),
    numbered AS (SELECT cls, (before + unnest(range(needed::BIGINT)))::BIGINT AS id FROM wanted),
    slots AS (SELECT id, n.cls, {_draw('s.n_pairs', 'pair')} AS slot FROM numbered n JOIN (SELECT DISTINCT cls, n_pairs FROM pairs) s ON s.cls = n.cls),
    chosen AS (
      SELECT s.id, p.cls, p.domain, p.description, p.tabs, p.n_tables, t.verbs, t.sql, t.prompts, t.explanation,
        {_draw('len(p.tabs)', 't1')} AS i1, {_draw('greatest(len(p.tabs) - 1, 1)', 't2')} AS i2
      FROM slots s JOIN pairs p ON p.cls = s.cls AND p.slot = s.slot JOIN templates t ON t.cls = p.cls AND t.template = p.template
    ),
    ids AS (SELECT *, tabs[i1 + 1] AS t1, tabs[CASE WHEN n_tables > 1 THEN i2 + (i2 >= i1)::INT ELSE i1 END + 1] AS t2 FROM chosen),
    z AS (
      SELECT t.*, a.g AS g1, a.m AS m1, a.d AS d1, a.pk AS pk1, b.g AS g2, b.m AS m2, b.pk AS pk2
      FROM ids t JOIN tabs a ON a.domain = t.domain AND a.tab = t.t1 JOIN tabs b ON b.domain = t.domain AND b.tab = t.t2
    ),
    parts AS (
      SELECT *, {_draw(100000, 'threshold')} + 1 AS threshold, 2015 + {_draw(10, 'year')} AS year, lpad(({_draw(12, 'month')} + 1)::VARCHAR, 2, '0') AS month,
        lpad(({_draw(28, 'day')} + 1)::VARCHAR, 2, '0') AS day, {_one_of("['SUM', 'AVG', 'MAX', 'MIN', 'COUNT']", 'agg')} AS agg_func,
        coalesce({_one_of('d1', 'date')}, 'created_date') AS date_col, coalesce({_one_of('m1', 'metric')}, 'id') AS metric_col,
        {relation.format('t1', 't2')} AS fk12, {relation.format('t2', 't1')} AS fk21 FROM z
    ),
    dated AS (SELECT *, year || '-' || month || '-' || day AS date_string FROM parts),
    valued AS (SELECT *, CASE {_draw(5, 'style')} {where} END AS since, {_one_of('prompts', 'prompt')} AS prompt, {drawn} FROM dated)
    SELECT id AS row_id, {filled('prompt')} AS sql_prompt,
      CASE WHEN n_tables > 1 THEN c1.context || ' ' || c2.context ELSE c1.context END AS sql_context,
      {filled(statement)} AS sql,
      {filled('explanation')} AS sql_explanation, v.domain, description AS domain_description, cls AS sql_complexity, {_text(synthetic.TASK_TYPE)} AS sql_task_type
    FROM valued v JOIN contexts c1 ON c1.domain = v.domain AND c1.tab = t1 JOIN contexts c2 ON c2.domain = v.domain AND c2.tab = t2"""
