"""Scores of predicted against gold SQL, and their summaries by class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import sqltext, stems, tokens
from tidemark.operators.support import per_class
from tidemark.session import materialise


def score(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    """Add exact_match, f1_score (micro) and token_f1 (binary).

    Token sets and their sizes are columns of their own, so each is made once per row.
    """
    p, g = F.col(predicted), F.col(gold)
    keep = df.columns
    df = df.withColumns({"__p": tokens.token_set(p), "__g": tokens.token_set(g)})
    df = df.withColumns(
        {"__both": F.size(F.array_intersect("__p", "__g")), "__np": F.size("__p"), "__ng": F.size("__g")}
    )
    sizes = [F.col(c) for c in ("__both", "__np", "__ng")]
    return df.select(
        *keep,
        tokens.exact_match(p, g).alias("exact_match"),
        tokens.f1_micro(*sizes).alias("f1_score"),
        tokens.f1_binary(*sizes).alias("token_f1"),
    )


def _prf(hits: Column, n_pred: Column, n_gold: Column, prefix: str) -> dict[str, Column]:
    precision = F.coalesce(F.try_divide(hits, n_pred), F.lit(0.0))
    recall = F.coalesce(F.try_divide(hits, n_gold), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return {f"{prefix}_precision": precision, f"{prefix}_recall": recall, f"{prefix}_fmeasure": f}


#: Words of one task, about, where words meet by key: a task's memory does not grow with the table.
TASK_WORDS = 500_000


def _word_rows(df: DataFrame, key: str, predicted: str, gold: str, stem: bool) -> DataFrame:
    """One row per word: __key, is_pred, pos and a number that equal stems (or words) share.

    Distinct words are stemmed once, in a written table whose size lets Catalyst choose how it
    is joined.  A row without any word keeps one row of nulls.  Rows come dealt by key, in as
    many partitions as their number asks for: left to itself, Spark joins small partitions by their
    size in the exchange, where repeated words shrink to little.
    """

    def side(text: str, is_pred: bool) -> Column:
        return F.transform(
            tokens.words(F.col(text)), lambda word, pos: F.struct(F.lit(is_pred).alias("is_pred"), pos.alias("pos"), word.alias("word"))
        )

    rows = df.select(F.col(key).alias("__key"), F.explode_outer(F.concat(side(predicted, True), side(gold, False))).alias("w"))
    rows = rows.select("__key", F.col("w.is_pred").alias("is_pred"), F.col("w.pos").alias("pos"), F.col("w.word").alias("word"))
    both = F.concat(tokens.words(F.col(predicted)), tokens.words(F.col(gold)))
    distinct = df.select(F.explode(both).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    known = stems.with_stem(distinct, "word") if stem else distinct.withColumn("stem", F.col("word"))
    alike = known.groupBy("stem").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    # written, so the numbers stay as they are when a task is repeated
    numbered = alike.withColumn("id", F.monotonically_increasing_id())
    numbered = materialise(numbered.select("id", F.inline("words")))
    total = numbered.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_WORDS))
    numbered = numbered.select("word", "id")
    return rows.join(numbered, "word", "left").select("__key", "is_pred", "pos", F.col("id").alias("word")).repartition(parts, "__key")


def rouge2(df: DataFrame, key: str, predicted: str, gold: str, stem: bool = True) -> DataFrame:
    """Bigram overlap counted as bags, of stemmed words unless ``stem`` is false.

    ``key`` is unique.  Words are rows and meet in one exchange by key, so a long text is
    sorted and counted on disk where memory is short.  No bigrams (null, empty, one word) on
    a side gives zeros.
    """
    rows = _word_rows(df, key, predicted, gold, stem)
    following = F.lead("word").over(Window.partitionBy("__key", "is_pred").orderBy("pos"))
    pairs = rows.withColumn("next", following)
    counts = pairs.groupBy("__key", "word", "next").agg(F.count_if("is_pred").alias("p"), F.count_if(~F.col("is_pred")).alias("g"))
    real = F.col("next").isNotNull()
    sums = counts.groupBy("__key").agg(
        *[F.sum(F.when(real, c).otherwise(0)).alias(n) for n, c in (("hits", F.least("p", "g")), ("n_p", F.col("p")), ("n_g", F.col("g")))]
    )
    return sums.select(F.col("__key").alias(key), *[c.alias(n) for n, c in _prf(F.col("hits"), F.col("n_p"), F.col("n_g"), "rouge2").items()])


def rouge_l(df: DataFrame, key: str, predicted: str, gold: str, stem: bool = True) -> DataFrame:
    """Longest common subsequence of words, stemmed unless ``stem`` is false.

    ``key`` is unique.  No words (null, empty) on a side gives zeros.  Stemmed words travel as
    numbers; an array holds one text of the input.
    """
    rows = _word_rows(df, key, predicted, gold, stem)
    at = F.struct("pos", "word")
    texts = rows.groupBy("__key").agg(
        F.collect_list(F.when(F.col("is_pred"), at)).alias("p"), F.collect_list(F.when(~F.col("is_pred"), at)).alias("g")
    )
    texts = texts.select("__key", *[F.sort_array(c).getField("word").alias(c) for c in ("p", "g")])
    scored = texts.select("__key", F.size("p").alias("n_p"), F.size("g").alias("n_g"), tokens.lcs_length()("p", "g").alias("hits"))
    return scored.select(F.col("__key").alias(key), *[c.alias(n) for n, c in _prf(F.col("hits"), F.col("n_p"), F.col("n_g"), "rougel").items()])


def overall(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.avg(m).alias(f"{m}_mean") for m in metrics])


def by_class(df: DataFrame, cls: str, metric: str = "f1_score") -> DataFrame:
    return (
        per_class(
            df, cls, F.avg(metric).alias(f"{metric}_mean"), F.avg("exact_match").alias("exact_match_mean"), F.count(metric).alias("n_rows")
        )
        .orderBy(F.desc(f"{metric}_mean"))
    )


def by_class_full(df: DataFrame, cls: str, metrics: Sequence[str], digits: int = 4) -> DataFrame:
    aggs = []
    for m in metrics:
        aggs += [
            F.round(F.avg(m), digits).alias(f"{m}_mean"),
            F.round(F.stddev_samp(m), digits).alias(f"{m}_std"),
            F.count(m).alias(f"{m}_count"),
        ]
    return per_class(df, cls, *aggs)


def class_distribution(df: DataFrame, cls: str) -> DataFrame:
    counts = per_class(df, cls, F.count(F.lit(1)).alias("n_rows"))
    total = counts.agg(F.sum("n_rows")).scalar()
    return counts.withColumn("pct", F.round(F.col("n_rows") / total * 100, 2))


def performance_gap(df: DataFrame, cls: str, metric: str, limit: float = 0.15) -> DataFrame:
    """Best and worst class by mean score (ties by class name) and the distance between them."""
    means = per_class(df, cls, F.avg(metric).alias("m"))
    ends = means.agg(
        F.min(F.struct((-F.col("m")).alias("neg"), F.col(cls).alias("c"))).alias("hi"),
        F.min(F.struct(F.col("m"), F.col(cls).alias("c"))).alias("lo"),
    )
    best, worst = -F.col("hi.neg"), F.col("lo.m")
    gap = best - worst
    return ends.select(
        F.col("hi.c").alias("best_class"), best.alias("best"), F.col("lo.c").alias("worst_class"), worst.alias("worst"),
        gap.alias("gap"), F.try_divide(gap, best).alias("relative_gap"), (gap > limit).alias("high_bias"),
    )


def class_importance(df: DataFrame, cls: str, metric: str, digits: int = 4) -> DataFrame:
    """How far each class mean lies below the mean of the class means, in points."""
    means = per_class(df, cls, F.round(F.avg(metric), digits).alias("mean"))
    base = means.agg(F.avg("mean")).scalar()
    return means.withColumn("importance", (base - F.col("mean")) * 100).orderBy(F.desc("mean"))


def syntax_validity(df: DataFrame, predicted: str, cls: str, digits: int = 4) -> DataFrame:
    """Share of structurally valid predictions, overall and per class."""
    valid = sqltext.validity_error(F.col(predicted)).isNull().cast("int")
    counts = df.select(F.col(cls).alias("cls"), valid.alias("v")).groupBy("cls").agg(
        F.sum("v").alias("valid"), F.count(F.lit(1)).alias("n")
    )
    named = counts.filter(F.col("cls").isNotNull()).select("cls", "valid", "n")
    total = counts.agg(F.sum("valid").alias("valid"), F.sum("n").alias("n")).select(F.lit("overall").alias("cls"), "valid", "n")
    return total.unionByName(named).select(
        F.col("cls").alias("scope"), "valid", "n", F.round(F.col("valid") / F.col("n"), digits).alias("validity")
    )


def confusion(df: DataFrame, true: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(true).alias("true_class"), F.col(predicted).alias("predicted_class")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def confusion_matrix(df: DataFrame, true: str, predicted: str, classes: Sequence[str]) -> DataFrame:
    """Wide form: one row per true class, one column per predicted class."""
    counts = confusion(df, true, predicted)
    return counts.groupBy("true_class").pivot("predicted_class", list(classes)).sum("n_rows").na.fill(0)


def class_report(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 per class, 0 where a denominator is 0."""
    counts = confusion(df, true, predicted)
    cells = counts.select(
        F.explode(
            F.array(
                F.struct(F.col("true_class").alias("cls"), F.col("n_rows").alias("support"), F.lit(0).cast("long").alias("named")),
                F.struct(F.col("predicted_class").alias("cls"), F.lit(0).cast("long").alias("support"), F.col("n_rows").alias("named")),
            )
        ).alias("s"),
        F.when(F.col("true_class") == F.col("predicted_class"), F.col("n_rows")).otherwise(0).alias("hit"),
    )
    # every correct cell contributes its hit twice (once per struct), hence the halving
    sums = cells.groupBy("s.cls").agg(
        F.sum("s.support").alias("support"), F.sum("s.named").alias("named"), (F.sum("hit") / 2).alias("hits")
    )
    prf = _prf(F.col("hits"), F.col("named"), F.col("support"), "cls")
    return sums.select(
        "cls", "support", prf["cls_precision"].alias("precision"), prf["cls_recall"].alias("recall"), prf["cls_fmeasure"].alias("f1")
    )


def param_correlation(df: DataFrame, params: Sequence[str], score_col: str) -> DataFrame:
    """Pearson correlation of every parameter with the score, from one aggregation."""
    row = df.agg(*[F.corr(p, score_col).alias(p) for p in params])
    pairs = ", ".join(f"'{p}', `{p}`" for p in params)
    return row.selectExpr(f"stack({len(params)}, {pairs}) as (param, correlation)").orderBy(F.desc("correlation"))

