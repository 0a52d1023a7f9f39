"""Features, guard checks and clean-up of SQL statements held in a text column.

Everything is a column expression; patterns run on the upper-cased statement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import let

# Names looked for in a statement, class priority and scores.
WINDOW_FUNCTIONS = [
    "ROW_NUMBER", "RANK", "DENSE_RANK", "NTILE", "LAG", "LEAD", "FIRST_VALUE", "LAST_VALUE",
    "PERCENT_RANK", "CUME_DIST", "PERCENTILE_CONT", "PERCENTILE_DISC",
]
SET_OPERATIONS = ["UNION", "INTERSECT", "EXCEPT", "MINUS"]
AGGREGATES = [
    "COUNT", "SUM", "AVG", "MAX", "MIN", "STRING_AGG", "LISTAGG", "GROUP_CONCAT", "STDDEV", "VARIANCE", "ARRAY_AGG",
]
JOIN_PATTERNS = [
    r"\bINNER\s+JOIN\b", r"\bLEFT\s+(?:OUTER\s+)?JOIN\b", r"\bRIGHT\s+(?:OUTER\s+)?JOIN\b",
    r"\bFULL\s+(?:OUTER\s+)?JOIN\b", r"\bCROSS\s+JOIN\b", r"\bJOIN\b",
]
CLASS_SCORES = {
    "window_functions": 7, "set_operations": 6, "multiple_joins": 5, "subqueries": 4,
    "aggregations": 3, "single_join": 2, "simple": 1,
}
SUBQUERY_KINDS = {
    "FROM clause subquery": r"(?d)\bFROM\s*\(\s*SELECT\b",
    "WHERE IN subquery": r"(?d)\bWHERE\s+.*\bIN\s*\(\s*SELECT\b",
    "EXISTS subquery": r"(?d)\bEXISTS\s*\(\s*SELECT\b",
    "SELECT clause subquery": r"(?d)\bSELECT\s+.*\(\s*SELECT\b",
}
BLOCKED_COMMANDS = [
    "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE", "REPLACE", "MERGE", "GRANT",
    "REVOKE", "EXEC", "EXECUTE", "CALL", "RENAME", "COMMENT",
]
BLOCKED_FUNCTIONS = ["xp_cmdshell", "pg_sleep", "benchmark", "load_file", "into outfile", "into dumpfile"]
# Corpus label for each class name used here.
CORPUS_LABELS = {
    "window_functions": "window functions", "set_operations": "set operations", "single_join": "single join",
    "aggregations": "aggregation", "simple": "basic", "multiple_joins": "multiple_joins", "subqueries": "subqueries",
}


def _found(text: Column, patterns: dict[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in patterns.items()]))


def window_functions(sql: Column) -> Column:
    """Names of window functions called with OVER (white space needed before OVER)."""
    return _found(F.upper(sql), {f: rf"\b{f}\s*\([^)]*\)\s+OVER\s*\(" for f in WINDOW_FUNCTIONS})


def set_operations(sql: Column) -> Column:
    return _found(F.upper(sql), {op: rf"\b{op}\b" for op in SET_OPERATIONS})


def join_count(sql: Column, strict: bool = False) -> Column:
    """Joins in a statement.  A typed join counts twice (as itself and as JOIN) unless ``strict``."""
    text = F.upper(sql)
    if strict:
        return F.regexp_count(text, F.lit(JOIN_PATTERNS[-1]))
    total = F.lit(0)
    for pattern in JOIN_PATTERNS:
        total = total + F.regexp_count(text, F.lit(pattern))
    return total


def join_types(sql: Column) -> Column:
    text = F.upper(sql)
    hits = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in JOIN_PATTERNS]))
    return F.array_sort(F.array_distinct(hits))


def select_count(sql: Column) -> Column:
    return F.regexp_count(F.upper(sql), F.lit(r"\bSELECT\b"))


def nesting_level(sql: Column) -> Column:
    return F.greatest(select_count(sql) - 1, F.lit(0))


def subquery_kinds(sql: Column) -> Column:
    return _found(F.upper(sql), SUBQUERY_KINDS)


def aggregate_functions(sql: Column) -> Column:
    return _found(F.upper(sql), {f: rf"\b{f}\s*\(" for f in AGGREGATES})


def has_group_by(sql: Column) -> Column:
    return F.upper(sql).rlike(r"\bGROUP\s+BY\b")


def has_having(sql: Column) -> Column:
    return F.upper(sql).rlike(r"\bHAVING\b")


def with_complexity(df: DataFrame, sql: str, strict_joins: bool = False) -> DataFrame:
    """Add join_count, nesting_level, all_complexities, primary_complexity, complexity_score, feature_count."""
    df = df.withColumn("__u", F.upper(sql))
    text = F.col("__u")
    # one alternation per family answers "any of these?", cheaper than listing the names
    window = text.rlike(rf"\b(?:{'|'.join(WINDOW_FUNCTIONS)})\s*\([^)]*\)\s+OVER\s*\(")
    sets = text.rlike(rf"\b(?:{'|'.join(SET_OPERATIONS)})\b")
    aggregates = text.rlike(rf"\b(?:{'|'.join(AGGREGATES)})\s*\(|\bGROUP\s+BY\b")
    blank = text.isNull() | text.rlike(r"^\s*$")
    df = df.withColumns({"join_count": join_count(text, strict_joins), "nesting_level": nesting_level(text)})
    classes = F.array_compact(
        F.array(
            F.when(window, "window_functions"),
            F.when(sets, "set_operations"),
            F.when(F.col("join_count") >= 2, "multiple_joins").when(F.col("join_count") == 1, "single_join"),
            F.when(F.col("nesting_level") > 0, "subqueries"),
            F.when(aggregates, "aggregations"),
        )
    )
    empty = F.array().cast("array<string>")
    found = F.when(blank, empty).when(F.size(classes) == 0, F.array(F.lit("simple"))).otherwise(classes)
    df = df.withColumn("all_complexities", found)
    primary = F.coalesce(
        *[F.when(F.array_contains("all_complexities", c), F.lit(c)) for c in CLASS_SCORES], F.lit("unknown")
    )
    df = df.withColumn("primary_complexity", primary)
    score = F.coalesce(*[F.when(F.col("primary_complexity") == c, F.lit(s)) for c, s in CLASS_SCORES.items()], F.lit(0))
    return df.withColumns({"complexity_score": score, "feature_count": F.size("all_complexities")}).drop("__u")


def corpus_label(primary: Column) -> Column:
    """Corpus vocabulary for a class name of this module."""
    return F.coalesce(*[F.when(primary == k, F.lit(v)) for k, v in CORPUS_LABELS.items()], primary)


def guard_failure(sql: Column) -> Column:
    """Label of the first failed check, null when the statement is allowed.

    Commands match whole words and come first; functions match anywhere.
    """

    def first_failure(text: Column) -> Column:
        commands = F.coalesce(
            *[F.when(text.rlike(rf"\b{c}\b"), F.lit(f"dangerous_command_{c.lower()}")) for c in BLOCKED_COMMANDS]
        )
        functions = F.coalesce(
            *[F.when(text.contains(f.upper()), F.lit(f"dangerous_function_{f}")) for f in BLOCKED_FUNCTIONS]
        )
        any_command = text.rlike(rf"\b(?:{'|'.join(BLOCKED_COMMANDS)})\b")
        return F.when(any_command, commands).otherwise(functions)

    return let(F.upper(sql), first_failure)


def strip(text: Column) -> Column:
    """White space of any kind removed at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def clean_markdown(sql: Column) -> Column:
    bare = strip(F.replace(F.replace(sql, F.lit("```sql"), F.lit("")), F.lit("```"), F.lit("")))
    return F.when(bare.endswith(";"), bare).otherwise(F.concat(bare, F.lit(";")))


def flatten(sql: Column) -> Column:
    """One line: no backslashes, no double quotes, single spaces."""
    return F.trim(F.regexp_replace(F.translate(sql, '\\"', ""), r"\s+", " "))


def error_type(message: Column) -> Column:
    return F.when(F.lower(message).contains("syntax"), "syntax_error").otherwise("execution_error")


# Words that may start a statement.
LEADING_WORDS = ["SELECT", "WITH", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER", "TRUNCATE", "MERGE"]


def validity_error(sql: Column) -> Column:
    """Structural fault of a statement as ``type: message``, null when none is found.

    These are checks of form (leading word, quotes, brackets, select list, last clause),
    not a grammar.  Quoted text is blanked before brackets and clauses are looked at.
    """
    bare = F.regexp_replace(F.upper(strip(sql)), r"'[^']*'", "''")

    def fault(body: Column) -> Column:
        opened, closed = F.regexp_count(body, F.lit(r"\(")), F.regexp_count(body, F.lit(r"\)"))
        return (
            F.when(body.isNull() | (body == ""), "EmptyStatement: nothing to run")
            .when(~body.rlike(rf"^\(*\s*(?:{'|'.join(LEADING_WORDS)})\b"), "UnknownStatement: no known leading word")
            .when(F.regexp_count(body, F.lit("'")) % 2 != 0, "UnbalancedQuotes: a string is not closed")
            .when(opened != closed, "UnbalancedBrackets: brackets do not match")
            .when(body.rlike(r"\bSELECT\s+(?:FROM|WHERE)\b|\bSELECT$"), "EmptySelectList: nothing selected")
            .when(
                body.rlike(r"\b(?:FROM|WHERE|JOIN|ON|BY|HAVING|AND|OR|SET|VALUES|LIMIT|UNION|IN)$|[,=<>(]$"),
                "DanglingClause: the last clause has no operand",
            )
        )

    return let(F.regexp_replace(bare, r"[\s;]+$", ""), fault)
