"""Statement templates of the synthetic rows, put together from clauses.

A statement is a measure, a source and an ending; each class has its own sources and endings and
combines every measure with them.  Statements use one base form for the aggregate (``SUM(``) and
one for the date restriction (``BASE_DATE``); the generator swaps both.
"""

from __future__ import annotations

BASE_DATE = "WHERE {date_col} >= '{year}-01-01'"

#: Name, words and form of the measures.
MEASURES = [
    ("sum", "the sum of {metric_col}", "SUM"),
    ("mean", "the mean {metric_col}", "AVG"),
    ("peak", "the peak of {metric_col}", "MAX"),
    ("floor", "the floor of {metric_col}", "MIN"),
    ("spread", "the spread of {metric_col}", "STDDEV"),
]
REQUESTS = ["{verb} {what}", "{verb} {what} ({table1})", "I need {what}", "Out of {table1}: {what}"]
REASON = "The statement gives {what}, read from {table1}"


def _ctes():
    endings = [
        ("limit", "where it passes {threshold}", "WHERE v > {threshold}"),
        ("leaders", "for the {top_n} leaders", "ORDER BY v DESC LIMIT {top_n}"),
        ("better", "where it beats the mean group", "WHERE v > (SELECT AVG(v) FROM {cte_name})"),
    ]
    for name, words, form in MEASURES:
        inner = f"SELECT {{group_col}} AS k, {form}({{metric_col}}) AS v FROM {{table1}} {BASE_DATE} GROUP BY {{group_col}}"
        for end, more, clause in endings:
            yield f"{name}_{end}", 1, "gmd", f"{words} by {{group_col}} {more}", f"WITH {{cte_name}} AS ({inner}) SELECT k, v FROM {{cte_name}} {clause}"


def _sets():
    operations = [
        ("either", "in one or both of", "UNION"), ("stacked", "with repeats from", "UNION ALL"), ("shared", "in both", "INTERSECT"),
        ("missing", "in the first only of", "EXCEPT"), ("missing_rows", "left over from the first of", "EXCEPT ALL"),
    ]
    conditions = [
        ("plain", "g", "", "", ""),
        ("large", "gm", " above {threshold}", " WHERE {metric_col} > {threshold}", " WHERE {metric_col2} > {threshold}"),
        ("dated", "gd", " since {year}", f" {BASE_DATE}", ""),
    ]
    for name, words, operation in operations:
        for kind, needs, more, left, right in conditions:
            sql = f"SELECT {{group_col1}} AS k FROM {{table1}}{left} {operation} SELECT {{group_col2}} FROM {{table2}}{right}"
            yield f"{name}_{kind}", 2, needs, f"values {words} {{table1}} and {{table2}}{more}", sql


def _joins():
    kinds = [("matched", "matched rows", "JOIN"), ("kept", "all {table1} rows", "LEFT JOIN"), ("full", "all rows of both tables", "FULL OUTER JOIN")]
    for name, words, form in MEASURES:
        for kind, rows, join in kinds:
            sql = (
                f"SELECT a.{{group_col1}} AS k1, b.{{group_col2}} AS k2, {form}(a.{{metric_col}}) AS v FROM {{table1}} AS a {join} {{table2}} AS b "
                "ON a.{fk1} = b.{pk2} WHERE a.{date_col} >= '{date_string}' GROUP BY a.{group_col1}, b.{group_col2}"
            )
            yield f"{name}_{kind}", 2, "gmd", f"{words} by {{group_col1}} and {{group_col2}} over {rows}", sql


def _windows():
    functions = [
        ("place", "the place of every row by {metric_col}", "RANK() OVER ({part}ORDER BY {metric_col} DESC)"),
        ("so_far", "{metric_col} added up over time", "SUM({metric_col}) OVER ({part}ORDER BY {date_col})"),
        ("step", "the change of {metric_col} from row to row", "{metric_col} - LAG({metric_col}) OVER ({part}ORDER BY {date_col})"),
        ("quarter", "the quarter of {metric_col} that a row is in", "NTILE(4) OVER ({part}ORDER BY {metric_col})"),
        ("portion", "each row's portion of {metric_col}", "{metric_col} / SUM({metric_col}) OVER ({bare})"),
    ]
    parts = [("all", "overall", ""), ("part", "within each {partition_col}", "PARTITION BY {partition_col} "), ("year", "within each year", "PARTITION BY YEAR({date_col}) ")]
    for name, words, form in functions:
        for part, more, clause in parts:
            call = form.replace("{part}", clause).replace("{bare}", clause.strip())
            yield f"{name}_{part}", 1, "gmd", f"{words}, {more}", f"SELECT {{group_col}}, {{date_col}}, {{metric_col}}, {call} AS v FROM {{table1}} {BASE_DATE}"


def _nested():
    for name, words, form in MEASURES:
        inner = f"SELECT {form}(i.{{metric_col}}) FROM {{table1}} AS i"
        yield f"{name}_all", 1, "gm", f"rows above {words} of all rows", f"SELECT {{group_col}}, {{metric_col}} FROM {{table1}} WHERE {{metric_col}} >= ({inner})"
        same = "WHERE i.{group_col} = o.{group_col}"
        yield f"{name}_own", 1, "gm", f"rows next to {words} of their {{group_col}}", f"SELECT o.{{group_col}}, o.{{metric_col}}, ({inner} {same}) AS v FROM {{table1}} AS o"
        groups = f"SELECT {{group_col}} FROM {{table1}} GROUP BY {{group_col}} HAVING {form}({{metric_col}}) {{comparison_op}} {{threshold}}"
        sql = f"SELECT COUNT(*) AS n FROM {{table1}} {BASE_DATE} AND {{group_col}} IN ({groups})"
        yield f"{name}_in", 1, "gmd", f"how many rows have a {{group_col}} whose value of {words} is {{comparison_op}} {{threshold}}", sql


_BUILDERS = {"CTEs": _ctes, "set operations": _sets, "multiple_joins": _joins, "window functions": _windows, "subqueries": _nested}
CLASSES = list(_BUILDERS)
#: How a request begins, by class.
VERBS = {
    "CTEs": ["Report", "Tell me", "Give me"],
    "set operations": ["Collect", "Give me"],
    "multiple_joins": ["Report", "Work out"],
    "window functions": ["Put beside each row", "Report"],
    "subqueries": ["Tell me", "Look for"],
}


def template_rows() -> list[dict]:
    """Templates as rows for a DataFrame."""
    return [
        {
            "cls": cls, "template": name, "n_tables": tables, "needs": list(needs), "verbs": VERBS[cls], "sql": sql + ";",
            "prompts": [r.replace("{what}", words) for r in REQUESTS], "explanation": REASON.replace("{what}", words),
        }
        for cls, build in _BUILDERS.items()
        for name, tables, needs, words, sql in build()
    ]
