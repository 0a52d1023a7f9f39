"""Corpus checks, statistics, balance, cleaning and sampling.

A corpus is one DataFrame with a ``split`` column and a unique ``row_id``; stages are
functions from DataFrame to DataFrame and nothing is materialised between them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import sqltext
from tidemark.functions.draws import draw
from tidemark.operators.support import attach, per_class
from tidemark.session import materialise

# Fixed values.
SEVERE, MODERATE, MILD, MINORITY_SHARE = 10, 5, 2, 0.5
SYNTHETIC_CLASSES = ["CTEs", "set operations", "window functions", "subqueries", "multiple_joins"]
PROMPT_HEAD = "translate English to SQL: "


# ---- validity and schema -------------------------------------------------------------


def flag_sql(df: DataFrame, sql: str) -> DataFrame:
    """Add is_valid, error_type and error_message."""
    fault = sqltext.validity_error(F.col(sql))
    df = df.withColumn("__fault", fault)
    return df.withColumns(
        {
            "is_valid": F.col("__fault").isNull(),
            "error_type": F.substring_index("__fault", ":", 1),
            "error_message": F.col("__fault"),
        }
    ).drop("__fault")


def anomalies(df: DataFrame, sql: str, row_id: str, split: str) -> DataFrame:
    bad = flag_sql(df.select(split, row_id, sql), sql).filter(~F.col("is_valid"))
    return bad.select(
        F.col(split).alias("source"), F.col(row_id).alias("row_index"), F.col(sql).alias("sql_query"), "error_message", "error_type"
    )


def schema_violations(
    df: DataFrame,
    expected: dict[str, str],
    critical: Sequence[str] = (),
    non_empty: Sequence[str] = (),
    must_contain: dict[str, str] | None = None,
    exact_order: bool = False,
) -> DataFrame:
    """Violations as (check_name, column_name, n_rows): schema from the plan, data in one aggregation."""
    present = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    fixed = [("missing_column", c) for c in expected if c not in present]
    fixed += [("wrong_type", c) for c, t in expected.items() if c in present and present[c] != t]
    if exact_order and df.columns != list(expected):
        fixed.append(("column_order", ",".join(df.columns)))
    counts = [("null_value", c, F.count_if(F.col(c).isNull())) for c in critical if c in present]
    counts += [("empty_value", c, F.count_if(sqltext.strip(F.col(c)) == "")) for c in non_empty if c in present]
    counts += [
        ("missing_text", c, F.count_if(~F.coalesce(F.col(c).contains(needle), F.lit(False))))
        for c, needle in (must_contain or {}).items()
        if c in present
    ]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[c.alias(f"v{i}") for i, (_, _, c) in enumerate(counts)])
    cells = [f"'{name}', '{col}', v{i}" for i, (name, col, _) in enumerate(counts)]
    cells += [f"'{name}', '{col}', n" for name, col in fixed]
    if not cells:
        return row.selectExpr("'none' as check_name", "'' as column_name", "n as n_rows").filter(F.lit(False))
    long = row.selectExpr(f"stack({len(cells)}, {', '.join(cells)}) as (check_name, column_name, n_rows)")
    schema_rule = F.col("check_name").isin("missing_column", "wrong_type", "column_order")
    return long.filter(schema_rule | (F.col("n_rows") > 0))


# ---- statistics ----------------------------------------------------------------------


def _stats(df: DataFrame, col: str, by: Sequence[str], percents: dict[str, float], duplicates: bool) -> DataFrame:
    """Counts and lengths of one column.

    Rows are first counted by digest, which tells texts apart without moving them whole; what follows
    adds up these counts, so that one group, however large, is a plain aggregate: distinct
    values are rows, and moments and percentiles are taken over lengths with frequencies.
    """
    rows = df.select(*by, F.length(col).alias("len"), F.md5(F.col(col)).alias("digest"))
    counted = rows.groupBy(*by, "digest", "len").agg(F.count(F.lit(1)).alias("n"))
    names = list(percents)
    long, exact = F.col("len").cast("long"), F.col("n").cast("decimal(38,0)")
    aggs = [
        F.coalesce(F.sum(F.when(F.col("digest").isNotNull(), F.col("n"))), F.lit(0)).alias("n_values"),
        F.coalesce(F.sum(F.when(F.col("digest").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("digest").alias("unique_count"),
        F.sum("n").alias("all_rows"),
        F.min("len").alias("len_min"),
        F.max("len").alias("len_max"),
        F.sum(long * F.col("n")).alias("s1"),
        F.sum((long * long * exact).cast("decimal(38,0)")).alias("s2"),
        F.percentile("len", F.array(*[F.lit(percents[n]) for n in names]), F.col("n")).alias("p"),
    ]
    out = counted.groupBy(*by).agg(*aggs)
    n, s1 = F.col("n_values"), F.col("s1")
    # exact sums: nothing cancels before the one rounding to a double
    spread = (F.col("s2") * n - s1.cast("decimal(38,0)") * s1).cast("double")
    out = out.withColumns(
        {
            "null_rate": F.try_divide(F.col("null_count").cast("double"), F.col("all_rows")),
            "len_mean": F.try_divide(s1.cast("double"), n),
            "len_std": F.when(n > 1, F.sqrt(spread / n / F.greatest(n - 1, F.lit(1)))),
            **{name: F.col("p")[i] for i, name in enumerate(names)},
        }
    )
    if duplicates:
        # null is a value of its own here, as in a keep-first comparison
        distinct = F.col("unique_count") + (F.col("null_count") > 0).cast("int")
        out = out.withColumn("duplicate_count", F.coalesce("all_rows", F.lit(0)) - distinct)
    return out.withColumn("column_name", F.lit(col)).drop("p", "all_rows", "s1", "s2")


def text_stats(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    percents = {"len_median": 0.5, "len_p25": 0.25, "len_p75": 0.75, "len_p90": 0.9, "len_p95": 0.95, "len_p99": 0.99}
    return _union([_stats(df, c, by, percents, False) for c in cols])


def text_stats_lite(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("split",)) -> DataFrame:
    percents = {"len_median": 0.5, "len_p90": 0.9, "len_p99": 0.99}
    return _union([_stats(df, c, by, percents, True).drop("null_rate") for c in cols])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def class_distribution(df: DataFrame, cls: str, by: Sequence[str] = ()) -> DataFrame:
    """Count per class and share of the non-null rows (of the same ``by`` values)."""
    counts = df.filter(F.col(cls).isNotNull()).groupBy(*by, cls).agg(F.count(F.lit(1)).alias("n_rows"))
    totals = counts.groupBy(*by).agg(F.sum("n_rows").alias("__t"))
    if by:
        both = counts.join(totals, list(by))
    else:
        both = counts.withColumn("__t", totals.scalar())
    return both.withColumn("share", F.col("n_rows") / F.col("__t")).drop("__t")


def quality(df: DataFrame, keys: Sequence[str], split: str = "split") -> DataFrame:
    """Duplicates on the keys (null equals null, first copy not counted) and blank values, per split."""
    per_key = df.groupBy(split, F.md5(F.to_json(F.struct(*keys))).alias("k")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(sqltext.strip(F.col(c)) == "").alias(f"e_{c}") for c in keys]
    )
    return per_key.groupBy(split).agg(
        F.sum(F.col("n") - 1).alias("duplicates"), *[F.sum(f"e_{c}").alias(f"empty_{c}") for c in keys]
    )


def contains_rate(df: DataFrame, col: str, needle: str, by: Sequence[str] = ("split",)) -> DataFrame:
    has = F.coalesce(F.col(col).contains(needle), F.lit(False)).cast("double")
    return df.groupBy(*by).agg(F.avg(has).alias("rate"))


def split_sizes(df: DataFrame, split: str = "split") -> DataFrame:
    c = F.col(split)
    sizes = df.agg(*[F.count_if(c == s).alias(s) for s in ("train", "val", "test")], F.count(F.lit(1)).alias("total"))
    ratio = F.when(F.col("val") > 0, F.col("train") / F.col("val")).otherwise(F.lit(0.0))
    return sizes.withColumn("train_val_ratio", ratio)


# ---- balance -------------------------------------------------------------------------


def _class_counts(df: DataFrame, cls: str) -> DataFrame:
    return per_class(df.select(F.col(cls).alias("cls")), "cls", F.count(F.lit(1)).alias("n"))


def imbalance(df: DataFrame, cls: str) -> DataFrame:
    """Largest and smallest class (ties by name), their ratio and its level."""
    ends = _class_counts(df, cls).agg(
        F.min(F.struct((-F.col("n")).alias("neg"), "cls")).alias("hi"), F.min(F.struct("n", "cls")).alias("lo")
    )
    big, small = -F.col("hi.neg"), F.col("lo.n")
    ratio = big / small
    level = F.when(ratio >= SEVERE, "SEVERE").when(ratio >= MODERATE, "MODERATE").when(ratio >= MILD, "MILD").otherwise("None")
    return ends.select(
        F.col("hi.cls").alias("max_class"), big.alias("max_count"), F.col("lo.cls").alias("min_class"), small.alias("min_count"),
        ratio.alias("imbalance_ratio"), level.alias("bias_level"), (ratio >= MILD).alias("bias_detected"),
    )


def minority_classes(df: DataFrame, cls: str) -> DataFrame:
    counts = materialise(_class_counts(df, cls))
    top, total = counts.agg(F.max("n")).scalar(), df.agg(F.count(F.lit(1))).scalar()
    return counts.filter(F.col("n") < top * MINORITY_SHARE).select(
        F.col("cls").alias(cls), F.col("n").alias("n_rows"), F.round(F.col("n") / total * 100, 2).alias("pct")
    )


def balance_targets(df: DataFrame, cls: str, classes: Sequence[str] = tuple(SYNTHETIC_CLASSES)) -> DataFrame:
    """Rows each listed class needs to reach the largest class; classes that need none are left out."""
    counts = materialise(_class_counts(df, cls))
    listed = df.sparkSession.createDataFrame([(c,) for c in classes], "cls string")
    # One row per listed class on either side of the join.
    top = counts.agg(F.max("n")).scalar()
    both = listed.join(counts.filter(F.col("cls").isin(*classes)), "cls", "left")
    need = top - F.coalesce("n", F.lit(0))
    return both.select(F.col("cls").alias(cls), need.alias("needed")).filter(F.col("needed") > 0)


def merge_synthetic(train: DataFrame, synthetic: DataFrame, cols: Sequence[str]) -> DataFrame:
    return train.select(*cols).unionByName(synthetic.select(*cols))


def merge_report(train: DataFrame, synthetic: DataFrame, cls: str) -> DataFrame:
    """Class counts before and after the merge, from one grouping of both inputs."""
    tagged = train.select(cls, F.lit(1).alias("old")).unionByName(synthetic.select(cls, F.lit(0).alias("old")))
    sums = tagged.filter(F.col(cls).isNotNull()).groupBy(cls).agg(F.sum("old").alias("before"), F.count(F.lit(1)).alias("after"))
    return sums.withColumn("added", F.col("after") - F.col("before"))


def input_text(context: Column, prompt: Column) -> Column:
    """Prompt text; the context part is left out when it is null."""
    middle = F.when(context.isNotNull(), F.concat(F.lit("context: "), context, F.lit("\n\n"))).otherwise("")
    return F.concat(F.lit(PROMPT_HEAD), middle, F.lit("query: "), F.coalesce(prompt, F.lit("nan")))


# ---- cleaning ------------------------------------------------------------------------


#: Inserted sample rows, and the instruction, before the part of the prompt that stays.
SAMPLE_ROWS_PATTERN, INSTRUCTION_PATTERN = r"(?is)insert\s+into.*?\n\nquery:", r"(?is)translate\s+english\s+to\s+sql.*?context:"


def clean(df: DataFrame, text: str = "input_text", sql: str = "sql") -> DataFrame:
    """Inserted sample rows and the instruction are cut from the prompt; INSERT statements are dropped."""
    t = F.regexp_replace(F.col(text), SAMPLE_ROWS_PATTERN, "query:")
    t = F.regexp_replace(t, INSTRUCTION_PATTERN, "context:")
    kept = df.filter(~F.coalesce(F.col(sql).rlike(r"(?i)insert\s+into"), F.lit(False)))
    return kept.withColumns({text: t, sql: F.replace(F.col(sql), F.lit("\n"), F.lit(" "))})


def clean_report(before: DataFrame, after: DataFrame, split: str = "split") -> DataFrame:
    tagged = before.select(split, F.lit(1).alias("o"), F.lit(0).alias("f")).unionByName(
        after.select(split, F.lit(0).alias("o"), F.lit(1).alias("f"))
    )
    sums = tagged.groupBy(split).agg(F.sum("o").alias("original"), F.sum("f").alias("final"))
    return sums.withColumn("removed", F.col("original") - F.col("final"))


# ---- sampling and splitting ----------------------------------------------------------


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all), chosen by seeded draw."""
    return df.withColumn("__d", draw(F.col(key), seed)).orderBy("__d", key).limit(n).drop("__d")


def stratified_split(
    df: DataFrame, cls: str, key: str, share: float = 0.1, seed: int = 42, bits: int = 16, names=("train", "val")
) -> DataFrame:
    """Exactly ``round(share * n)`` seeded rows of every class to the second split.

    Every row comes out: null is a class of its own, and a class with fewer than two rows stays
    in the first split.  Draws are counted per (class, bucket); the counts tell which bucket a
    class is cut in, and only that bucket's rows, about 1 / 2**bits of the class, are ranked.
    The other rows are decided where they are.
    """
    # a key that is never null, so that the null class can be joined
    stratum = F.coalesce(F.concat(F.lit("="), F.col(cls).cast("string")), F.lit(""))
    rows = df.withColumn("__s", stratum).withColumn("__d", draw(F.col(key), seed))
    rows = rows.withColumn("__b", F.shiftright("__d", 60 - bits).cast("int"))
    counts = rows.groupBy("__s", "__b").agg(F.count(F.lit(1)).alias("__c"))
    whole = Window.partitionBy("__s")  # at most 2**bits rows of counts per class
    counts = counts.withColumns(
        {"__upto": F.sum("__c").over(whole.orderBy("__b")), "__n": F.sum("__c").over(whole)}
    ).withColumn("__want", F.when(F.col("__n") < 2, 0).otherwise(F.round(F.col("__n") * share)).cast("long"))
    cuts = (
        counts.filter(F.col("__upto") >= F.col("__want"))
        .groupBy("__s")
        .agg(F.min(F.struct(F.col("__b").alias("__b"), (F.col("__want") - (F.col("__upto") - F.col("__c"))).alias("__take"))).alias("__cut"))
    )
    rows = attach(rows, cuts, "__s")
    clear = rows.filter(F.col("__b") != F.col("__cut.__b")).withColumn(
        "split", F.when(F.col("__b") < F.col("__cut.__b"), names[1]).otherwise(names[0])
    )
    w = Window.partitionBy("__s").orderBy("__d", key)
    edge = rows.filter(F.col("__b") == F.col("__cut.__b")).withColumn("__r", F.row_number().over(w))
    edge = edge.withColumn("split", F.when(F.col("__r") <= F.col("__cut.__take"), names[1]).otherwise(names[0])).drop("__r")
    return clear.unionByName(edge).drop("__s", "__d", "__b", "__cut")
