"""Reports over a table of SQL statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import sqltext

# Upper bounds of the counters' buckets.
JOIN_BUCKETS = [0, 1, 2, 3, 4, 5, 10, float("inf")]
NESTING_BUCKETS = [0, 1, 2, 3, 4, 5, float("inf")]


def complexity_report(df: DataFrame, sql: str, by: str) -> DataFrame:
    """(by, section, item, n, value): class distribution, mean score, feature counts and cumulative buckets.

    Statements are first counted per feature combination, of which there are few, so
    everything after that works on a small table.
    """
    features = ["primary_complexity", "complexity_score", "join_count", "nesting_level", "all_complexities"]
    combos = sqltext.with_complexity(df.select(by, sql), sql).groupBy(by, *features).agg(F.count(F.lit(1)).alias("n"))

    def le(section: str, value: str, buckets, present):
        hits = [
            F.when(present & (F.col(value) <= b), F.struct(F.lit(section).alias("section"), F.lit(_le(b)).alias("item")))
            for b in buckets
        ]
        return F.array_compact(F.array(*hits))

    items = F.concat(
        F.array(F.struct(F.lit("distribution").alias("section"), F.col("primary_complexity").alias("item"))),
        F.array(F.struct(F.lit("score").alias("section"), F.lit("mean").alias("item"))),
        F.transform("all_complexities", lambda c: F.struct(F.lit("feature").alias("section"), c.alias("item"))),
        le("join_count_le", "join_count", JOIN_BUCKETS, F.col("join_count") > 0),
        le("nesting_level_le", "nesting_level", NESTING_BUCKETS, F.col("nesting_level") > 0),
    )
    return (
        combos.withColumn("i", F.explode(items))
        .groupBy(by, "i.section", "i.item")
        .agg(
            F.sum("n").alias("n"),
            (F.sum(F.col("complexity_score") * F.col("n")) / F.sum("n")).alias("mean_score"),
        )
        .withColumn("mean_score", F.when(F.col("section") == "score", F.col("mean_score")))
    )


def _le(bound: float) -> str:
    return "+Inf" if bound == float("inf") else f"{bound:g}"


def guard_report(df: DataFrame, sql: str) -> DataFrame:
    """Blocked statements by label.

    Allowed statements fall into the null label, whose non-null count is 0; a filter on
    the label itself would evaluate the guard twice per row.
    """
    labels = df.select(sqltext.guard_failure(F.col(sql)).alias("failure_type"))
    return labels.groupBy("failure_type").agg(F.count("failure_type").alias("n_blocked")).filter(F.col("n_blocked") > 0)


def error_report(df: DataFrame, message: str, by: list[str]) -> DataFrame:
    typed = df.withColumn("error_type", sqltext.error_type(F.col(message)))
    return typed.groupBy(*by, "error_type").agg(F.count(F.lit(1)).alias("n_errors"))


def intent(df: DataFrame, sql: str, question: str, n_rows: str, n_cols: str, n_unique: str) -> DataFrame:
    """Reporting (``bi``) or exploring (``eda``): weighted signs from statement, question and result shape."""
    s, q = F.upper(F.col(sql)), F.lower(F.col(question))
    grouped = s.contains("GROUP BY")
    # Signs and their weights.
    aggs = ["SUM(", "AVG(", "COUNT(", "MAX(", "MIN(", "STRING_AGG(", "LISTAGG("]
    eda_words = [
        "show me", "give me all", "list all", "contents", "everything", "explore", "see all", "display all", "all",
    ]
    bi_words = ["total", "sum", "average", "count", "top", "by category", "breakdown", "grouped"]

    def any_of(text, words):
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        return hit

    def points(*pairs):
        total = F.lit(0)
        for test, weight in pairs:
            total = total + F.when(test, weight).otherwise(0)
        return total

    has_agg = any_of(s, aggs)
    commas = F.substring_index(s, "FROM", 1)
    columns = F.length(commas) - F.length(F.replace(commas, F.lit(","), F.lit(""))) + 1
    joins = F.regexp_count(s, F.lit("JOIN"))
    rows, cols = F.col(n_rows), F.col(n_cols)
    bi = points(
        (grouped, 50), (has_agg, 40), (s.contains("HAVING"), 30), ((columns <= 5) & grouped, 20),
        (rows == 1, 20), (cols <= 3, 15), (any_of(q, bi_words), 10),
    )
    eda = points(
        (s.contains("SELECT *"), 50), (columns > 10, 40), ((joins >= 2) & ~grouped, 30),
        (s.contains("WHERE") & ~grouped, 15), (cols > 10, 20), (F.col(n_unique) >= cols * 0.7, 15),
        (any_of(q, eda_words), 10),
    )
    scored = df.withColumns({"bi_score": bi, "eda_score": eda})
    verdict = (
        F.when(F.col("bi_score") > F.col("eda_score") + 20, "bi")
        .when(F.col("eda_score") > F.col("bi_score") + 20, "eda")
        .when(grouped | has_agg, "bi")
        .otherwise("eda")
    )
    return scored.withColumn("intent", verdict)
