"""The whole curation of a text-to-SQL corpus, and its run report.

Rows are materialised where several later steps read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import corpus, drift, leakage
from tidemark.plans import synthetic
from tidemark.session import materialise
from tidemark.sources import readers, sinks

COLUMNS = ["sql_prompt", "sql_context", "sql", "sql_complexity"]
KEYS = ["input_text", "sql"]


RAW_TYPES = {"row_id": "bigint", "split": "string", **dict.fromkeys(COLUMNS, "string")}


def check_schema(df: DataFrame, **rules) -> None:
    """Raise when ``corpus.schema_violations`` finds any."""
    found = corpus.schema_violations(df, **rules).filter("n_rows > 0").collect()
    if found:
        raise ValueError("; ".join(f"{r['check_name']} in {r['column_name']}: {r['n_rows']} rows" for r in found))


def curate(raw: DataFrame, catalogue: DataFrame, seed: int = 42, share: float = 0.1, on_overlap: str = "raise") -> DataFrame:
    """Check, validate, balance, split, de-duplicate, remove leaks, clean, check again.

    ``raw`` has row_id, split (train or test) and the four corpus columns; the result has
    row_id, split, input_text, sql, sql_complexity.  The test split is never resampled.  Rows
    without a class stay.  Identical samples in val and test raise an error, or leave val with
    ``on_overlap="drop"``.  ``catalogue`` describes the tables of synthetic rows.
    """
    if on_overlap not in ("raise", "drop"):
        raise ValueError("on_overlap is raise or drop")
    missing = [c for c in RAW_TYPES if c not in raw.columns]
    if missing:
        raise ValueError(f"missing_column {', '.join(missing)}")
    raw = raw.select(*RAW_TYPES)
    check_schema(raw, expected=RAW_TYPES, critical=["sql_prompt"])
    # written once: validity is used by the targets, the merge and the test branch
    valid = materialise(corpus.flag_sql(raw, "sql").filter("is_valid").select("row_id", "split", *COLUMNS))
    train, test = valid.filter("split = 'train'"), valid.filter("split = 'test'")
    drawn = synthetic.generate(raw.sparkSession, corpus.balance_targets(train, "sql_complexity"), catalogue, seed)
    # synthetic rows follow the originals in keep-first order
    top = valid.agg(F.coalesce(F.max("row_id"), F.lit(-1))).scalar()
    drawn = drawn.withColumn("row_id", F.col("row_id") + top + 1)
    merged = materialise(corpus.merge_synthetic(train, drawn, ["row_id", *COLUMNS]))
    split = corpus.stratified_split(merged, "sql_complexity", "row_id", share, seed)
    rows = split.unionByName(test.select("row_id", *COLUMNS, "split"))
    text = corpus.input_text(F.col("sql_context"), F.col("sql_prompt")).alias("input_text")
    rows = rows.select("row_id", "split", text, "sql", "sql_complexity")
    # one grouping by text gives first rows, leaks and shared samples alike
    clean = materialise(corpus.clean(leakage.settle_splits(rows, KEYS, "row_id", on_overlap=on_overlap)))
    check_schema(clean, expected={}, critical=["input_text", "sql"], non_empty=["input_text", "sql"], must_contain={"input_text": "query:"})
    return clean


def _long(stage: str, wide: DataFrame, metrics: list[str], prefix: str = "''") -> DataFrame:
    cells = ", ".join(f"concat({prefix}, '{m}'), cast({m} as double)" for m in metrics)
    long = wide.selectExpr(f"stack({len(metrics)}, {cells}) as (metric, value)")
    return long.select(F.lit(stage).alias("stage"), "metric", "value")


def drift_report(cur: DataFrame, prev: DataFrame, cls: str = "sql_complexity", text: str = "sql", **limits: float) -> DataFrame:
    """Drift of ``cur`` against ``prev`` in the form of the run report.

    Sizes, the decision, the share of each class then and now, and the mean lengths of classes
    that both have.  ``limits`` are those of ``drift.decision``.  The snapshots are read once; a
    few rows a class are written, from which all parts follow.
    """
    stats = materialise(drift.class_stats(cur, prev, cls, text))
    shares = drift.shares_of(stats, cls).withColumn("__name", F.col(cls))
    lengths = drift.lengths_of(stats, cls).withColumn("__name", F.col(cls))
    named = "concat(__name, '_')"
    parts = [
        _long("drift", drift.sizes_of(stats), ["previous_rows", "current_rows", "size_change_pct"]),
        _long("drift", drift.decision_of(stats, cls, **limits), ["n_reasons", "drift_detected"]),
        _long("drift", shares, ["previous_pct", "current_pct", "pct_change"], named),
        _long("drift", lengths, ["previous_mean_length", "current_mean_length", "mean_pct_change"], named),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def release(raw: DataFrame, catalogue: DataFrame, root: str, ts: str, limits: dict[str, float] | None = None, **options) -> DataFrame:
    """A whole run: curate, compare with the snapshot before, publish as ``root/ts``; returns the drift report.

    The train splits are compared.  The report is written beside the snapshot, and the pointer to
    the latest snapshot moves last.  Without an earlier snapshot the report has one row, ``compared``
    = 0; else this is 1 and the rows of :func:`drift_report` follow.  ``options`` go to :func:`curate`.
    """
    spark = raw.sparkSession
    rows = curate(raw, catalogue, **options)
    before = readers.published(spark, root)
    report = spark.range(1).select(
        F.lit("drift").alias("stage"), F.lit("compared").alias("metric"), F.lit(0.0 if before is None else 1.0).alias("value")
    )
    if before is not None:
        train = F.col("split") == "train"
        report = report.unionByName(drift_report(rows.filter(train), before.filter(train), **(limits or {})))
    folder = f"{root.rstrip('/')}/{ts}/drift"
    sinks.write_report(report, folder)
    sinks.publish(rows, root, ts)
    return spark.read.schema(report.schema).json(folder)


def summary(raw: DataFrame, engineered: DataFrame) -> DataFrame:
    """One row per stage and metric: load, validity, balance, generation, leakage, cleaning."""
    flagged = corpus.flag_sql(raw, "sql").groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("is_valid").alias("n_valid"), F.count_if(~F.col("is_valid")).alias("n_invalid")
    )
    bias = corpus.imbalance(raw, "sql_complexity")
    need = corpus.balance_targets(raw, "sql_complexity").agg(F.sum("needed").alias("rows_needed"))
    leaks = leakage.leak_report(engineered, KEYS)
    clean = corpus.clean_report(engineered, corpus.clean(engineered))
    parts = [
        _long("load", flagged, ["n_rows"], "concat(split, '_')"),
        _long("validate", flagged, ["n_valid", "n_invalid"], "concat(split, '_')"),
        _long("balance", bias, ["max_count", "min_count", "imbalance_ratio"]),
        _long("generate", need, ["rows_needed"]),
        _long("leakage", leaks, ["total_intra", "cross_removed", "total_removed", "final_train", "final_val", "final_test"]),
        _long("clean", clean, ["original", "removed"], "concat(split, '_')"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
