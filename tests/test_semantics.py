"""Literal cases for the semantics that an oracle over the driver tables does not reach."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import sqltext, timeconv, tokens
from tidemark.operators import charts, chats, corpus, drift, evaluation, joins, leakage, profile, subqueries, telemetry, vectors
from tidemark.sources import readers


def one(df):
    return df.first().asDict()


# ---- statements ------------------------------------------------------------------------


@pytest.mark.parametrize(
    "sql, primary",
    [
        ("SELECT a FROM t", "simple"),
        ("SELECT a FROM t JOIN u ON t.i=u.i", "single_join"),
        ("SELECT a FROM t INNER JOIN u ON t.i=u.i", "multiple_joins"),
        ("SELECT a FROM t UNION SELECT a FROM u", "set_operations"),
        ("SELECT ROW_NUMBER() OVER (ORDER BY a) FROM t", "window_functions"),
        ("SELECT ROW_NUMBER() OVER(ORDER BY a) FROM t", "window_functions"),
        ("SELECT ROW_NUMBER()OVER(ORDER BY a) FROM t", "simple"),
        ("SELECT COUNT(*) FROM t", "aggregations"),
        ("SELECT a FROM t WHERE i IN (SELECT i FROM u)", "subqueries"),
        ("  \n ", "unknown"),
        ("", "unknown"),
    ],
)
def test_primary_complexity(spark, sql, primary):
    row = one(sqltext.with_complexity(spark.createDataFrame([(sql,)], "sql string"), "sql"))
    assert row["primary_complexity"] == primary
    assert row["complexity_score"] == sqltext.CLASS_SCORES.get(primary, 0)
    assert row["feature_count"] == len(row["all_complexities"]) and (primary == "unknown") == (row["feature_count"] == 0)


def test_union_is_also_a_subquery_and_strict_joins(spark):
    df = spark.createDataFrame([("SELECT a FROM t UNION SELECT a FROM u LEFT OUTER JOIN v ON 1=1",)], "sql string")
    assert one(sqltext.with_complexity(df, "sql"))["all_complexities"] == ["set_operations", "multiple_joins", "subqueries"]
    assert one(df.select(sqltext.join_count(F.col("sql")).alias("a"), sqltext.join_count(F.col("sql"), strict=True).alias("b"))) == {"a": 2, "b": 1}


@pytest.mark.parametrize(
    "sql, label",
    [
        ("SELECT * FROM users WHERE age > 25", None),
        ("SELECT u.name FROM users u JOIN orders o ON u.id = o.user_id", None),
        ("SELECT created_at, updated_at FROM t", None),
        ("DELETE FROM users", "dangerous_command_delete"),
        ("delete from users", "dangerous_command_delete"),
        ("UPDATE users SET a = 1", "dangerous_command_update"),
        ("INSERT INTO users VALUES (1); DROP TABLE users", "dangerous_command_insert"),
        ("DROP TABLE users; INSERT INTO x VALUES (1)", "dangerous_command_insert"),
        ("TRUNCATE TABLE users", "dangerous_command_truncate"),
        ("SELECT xp_cmdshell('dir')", "dangerous_function_xp_cmdshell"),
        ("SELECT 1 INTO OUTFILE '/x'", "dangerous_function_into outfile"),
        ("SELECT comment FROM t", "dangerous_command_comment"),
        ("SELECT * FROM benchmark_results", "dangerous_function_benchmark"),
        ("GRANT ALL ON t TO u", "dangerous_command_grant"),
    ],
)
def test_guard(spark, sql, label):
    assert one(spark.createDataFrame([(sql,)], "s string").select(sqltext.guard_failure(F.col("s")).alias("f")))["f"] == label


@pytest.mark.parametrize(
    "sql, kind",
    [
        ("SELECT a FROM t WHERE b = 'it (s'", None),
        ("WITH x AS (SELECT 1) SELECT * FROM x;", None),
        ("", "EmptyStatement"),
        (" ; ", "EmptyStatement"),
        (None, "EmptyStatement"),
        ("SELEC a FROM t", "UnknownStatement"),
        ("SELECT * FROMM users WHERE", "DanglingClause"),
        ("SELECT (a FROM t", "UnbalancedBrackets"),
        ("SELECT 'a FROM t", "UnbalancedQuotes"),
        ("SELECT FROM t", "EmptySelectList"),
        ("SELECT a FROM t WHERE x =", "DanglingClause"),
    ],
)
def test_structural_validity(spark, sql, kind):
    row = one(corpus.flag_sql(spark.createDataFrame([(sql,)], "sql string"), "sql"))
    assert row["is_valid"] == (kind is None) and row["error_type"] == kind


def test_clean_and_flatten(spark):
    df = spark.createDataFrame([("```sql\nSELECT 1\n```", '  SELECT "a"\\n\n  FROM   t ')], "a string, b string")
    row = one(df.select(sqltext.clean_markdown(F.col("a")).alias("a"), sqltext.flatten(F.col("b")).alias("b")))
    assert row == {"a": "SELECT 1;", "b": "SELECT an FROM t"}


# ---- evaluation ------------------------------------------------------------------------


def test_token_scores(spark):
    df = spark.createDataFrame(
        [(1, "select a from t;", "SELECT a, b FROM t;"), (2, "x", "   "), (3, "a b", "c d"), (4, " SELECT 1\n", "select 1")],
        "id int, p string, g string",
    )
    got = {r["id"]: r for r in evaluation.score(df, "p", "g").collect()}
    assert math.isclose(got[1]["f1_score"], 5 / 7) and math.isclose(got[1]["token_f1"], 10 / 12)
    assert got[2]["f1_score"] == 1.0 and got[2]["token_f1"] == 1.0
    assert got[3]["f1_score"] == 0.0 and got[3]["token_f1"] == 0.0
    assert got[4]["exact_match"] == 1.0
    assert all(r["f1_score"] <= r["token_f1"] <= 1 for r in got.values())


def brute_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_rouge(spark):
    pairs = [(1, "the cat sat on the mat", "the cat lay on a mat"), (2, "", "a b"), (3, "a", "a"), (4, "b a b a b", "a b a b a b"), (5, "a b c", "a b c")]
    df = spark.createDataFrame(pairs, "id int, p string, g string")
    long = {r["id"]: r for r in evaluation.rouge_l(df, "id", "p", "g").collect()}
    two = {r["id"]: r for r in evaluation.rouge2(df, "id", "p", "g").collect()}
    for i, p, g in pairs:
        p, g = p.split(), g.split()
        n = brute_lcs(p, g)
        assert math.isclose(long[i]["rougel_recall"], n / len(g)) and math.isclose(long[i]["rougel_precision"], n / len(p) if p else 0)
    assert two[1]["rouge2_recall"] == 1 / 5 and two[5]["rouge2_fmeasure"] == 1.0 and two[3]["rouge2_fmeasure"] == 0.0
    assert math.isclose(two[4]["rouge2_recall"], 4 / 5) and two[4]["rouge2_precision"] == 1.0


def test_class_means_and_empty_input(spark):
    rows = list(zip("simple complex simple medium complex medium".split(), [1.0, 0, 1, 0, 1, 1], [0.95, 0.45, 0.90, 0.65, 0.50, 0.75]))
    df = spark.createDataFrame([(c, float(e), f) for c, e, f in rows], "sql_complexity string, exact_match double, f1_score double")
    means = {r["sql_complexity"]: r["f1_score_mean"] for r in evaluation.by_class(df, "sql_complexity").collect()}
    assert {k: round(v, 3) for k, v in means.items()} == {"simple": 0.925, "medium": 0.70, "complex": 0.475}
    assert evaluation.by_class(df.limit(0), "sql_complexity").count() == 0
    gap = one(evaluation.performance_gap(df, "sql_complexity", "f1_score"))
    assert (gap["best_class"], gap["worst_class"], gap["high_bias"]) == ("simple", "complex", True)


# ---- corpus ----------------------------------------------------------------------------


def triples(spark, **splits):
    rows = [(s, q, a) for s, pairs in splits.items() for q, a in pairs]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, split string, input_text string, sql string")


KEYS = ["input_text", "sql"]
Q = [("q0", "s0"), ("q1", "s1"), ("q2", "s2"), ("q3", "s3"), ("q4", "s4"), ("q5", "s5")]


def test_leakage_cases(spark):
    clean = one(leakage.leak_report(triples(spark, train=Q[1:3], val=Q[3:4], test=Q[4:5]), KEYS))
    assert clean["total_removed"] == 0 and not clean["leakage_cleaned"]
    inside = one(leakage.leak_report(triples(spark, train=[Q[1], Q[2], Q[1]], val=Q[3:4], test=Q[4:5]), KEYS))
    assert inside["intra_train"] == 1 and inside["cross_removed"] == 0 and inside["final_train"] == 2
    df = triples(spark, train=[Q[1], Q[2], Q[3]], val=[Q[2], Q[4]], test=[Q[5]])
    assert one(leakage.leak_report(df, KEYS))["cross_removed"] == 1
    left = leakage.remove_leaks(df, KEYS)
    assert sorted(r["input_text"] for r in left.filter("split = 'train'").collect()) == ["q1", "q3"]
    with pytest.raises(ValueError, match="both val and test"):
        leakage.remove_leaks(triples(spark, train=[Q[1]], val=[Q[2]], test=[Q[2]]), KEYS)
    no_test = one(leakage.leak_report(triples(spark, train=Q[1:3], val=Q[3:4]), KEYS))
    assert no_test["final_test"] == 0 and not no_test["leakage_cleaned"]


def test_dedup_keeps_first_with_null_keys_and_one_hot_text(spark):
    rows = [(i, "train", "same", None if i % 2 else "x") for i in range(500)] + [(900, "val", "same", "x")]
    df = spark.createDataFrame(rows, "row_id long, split string, input_text string, sql string").repartition(7)
    kept = leakage.dedup_keep_first(df, KEYS, "row_id")
    assert sorted((r["row_id"], r["split"]) for r in kept.collect()) == [(0, "train"), (1, "train"), (900, "val")]


def test_cleaning(spark):
    rows = [
        ("translate English to SQL: context: CREATE TABLE t (a INT); INSERT INTO t\nVALUES (1);\n\nquery: Q1", "SELECT\n1"),
        ("translate English to SQL: query: Q2", "SELECT 2"),
        ("translate English to SQL: query: Q3", "insert  into t values (1)"),
        ("translate English to SQL: query: Q4", None),
    ]
    got = corpus.clean(spark.createDataFrame(rows, "input_text string, sql string")).collect()
    assert [tuple(r) for r in got] == [
        ("context: CREATE TABLE t (a INT); query: Q1", "SELECT 1"),
        ("translate English to SQL: query: Q2", "SELECT 2"),
        ("translate English to SQL: query: Q4", None),
    ]


def test_imbalance_levels(spark):
    def level(**counts):
        rows = [(c,) for c, n in counts.items() for _ in range(n)]
        return one(corpus.imbalance(spark.createDataFrame(rows, "c string"), "c"))

    got = level(basic=50, CTEs=10, aggregation=40)
    assert (got["imbalance_ratio"], got["bias_level"], got["max_class"], got["min_class"]) == (5.0, "MODERATE", "basic", "CTEs")
    assert level(a=100, b=10)["bias_level"] == "SEVERE" and level(a=2, b=1)["bias_level"] == "MILD"
    single = level(only=7)
    assert single["bias_level"] == "None" and not single["bias_detected"]


def test_stratified_split_is_exact_and_repeatable(spark):
    df = spark.range(5000).selectExpr("id", "case when id < 4000 then 'hot' when id < 4999 then concat('c', id % 7) else 'lonely' end as cls")
    a = corpus.stratified_split(df, "cls", "id", bits=4)
    b = corpus.stratified_split(df.repartition(13), "cls", "id", bits=10)
    counts = {(r["cls"], r["split"]): r["n"] for r in a.groupBy("cls", "split").agg(F.count("*").alias("n")).collect()}
    assert counts[("hot", "val")] == 400 and counts[("hot", "train")] == 3600
    assert counts[("lonely", "train")] == 1 and ("lonely", "val") not in counts
    for i in range(7):
        n = counts[(f"c{i}", "val")] + counts[(f"c{i}", "train")]
        assert counts[(f"c{i}", "val")] == int(n * 0.1 + 0.5)
    assert sorted(map(tuple, a.select("id", "split").collect())) == sorted(map(tuple, b.select("id", "split").collect()))


def test_schema_violations(spark):
    df = spark.createDataFrame([("q", 1, None), ("", 2, "x")], "sql_prompt string, sql int, sql_complexity string")
    spec = {"sql_prompt": "string", "sql": "string", "sql_complexity": "string", "sql_context": "string"}
    got = {(r["check_name"], r["column_name"]): r["n_rows"] for r in corpus.schema_violations(df, spec, ["sql_complexity"], ["sql_prompt"]).collect()}
    assert got == {("missing_column", "sql_context"): 2, ("wrong_type", "sql"): 2, ("null_value", "sql_complexity"): 1, ("empty_value", "sql_prompt"): 1}
    ok = spark.createDataFrame([("query: a",)], "input_text string")
    assert corpus.schema_violations(ok, {"input_text": "string"}, ["input_text"], ["input_text"], {"input_text": "query:"}, True).count() == 0


def drift_frame(spark, **counts):
    return spark.createDataFrame([(c, "x" * length) for c, (n, length) in counts.items() for _ in range(n)], "c string, s string")


def test_drift_rules(spark):
    old = drift_frame(spark, a=(50, 100), b=(50, 100))
    assert not one(drift.decision(old, old, "c", "s"))["drift_detected"]
    # 50 % -> 45 %: a change of exactly ten percent is not flagged
    edge = {r["c"]: r for r in drift.class_drift(drift_frame(spark, a=(55, 100), b=(45, 100)), old, "c").collect()}
    assert edge["b"]["pct_change"] == -10.0 and not edge["b"]["exceeds"]
    new = {r["c"]: r for r in drift.class_drift(drift_frame(spark, a=(50, 100), n=(50, 100)), old, "c").collect()}
    assert new["n"]["pct_change"] == 100.0 and new["b"]["pct_change"] == -100.0
    longer = drift.length_drift(drift_frame(spark, a=(50, 106), n=(5, 1)), old, "c", "s").collect()
    assert [(r["c"], r["mean_pct_change"], r["exceeds"]) for r in longer] == [("a", 6.0, True)]


def test_text_stats_nulls(spark):
    df = spark.createDataFrame([("aa",), ("aa",), (None,), (None,), ("b",)], "t string")
    full = one(corpus.text_stats(df, ["t"]))
    assert (full["n_values"], full["null_count"], full["unique_count"], full["len_max"]) == (3, 2, 2, 2)
    lite = one(corpus.text_stats_lite(df.withColumn("split", F.lit("train")), ["t"]))
    assert lite["duplicate_count"] == 2
    single = one(corpus.text_stats(df.limit(1), ["t"]))
    assert single["len_std"] is None


# ---- queries, profiles, retrieval, activity ----------------------------------------------


def test_gt_all_prior_with_nulls(spark):
    rows = [("g", "2024-01-01", 5.0), ("g", "2024-02-01", 4.0), ("g", "2024-03-01", None), ("g", "2024-03-15", 9.0), ("g", "2024-08-01", 1.0), ("g", "2024-08-01", 2.0)]
    df = spark.createDataFrame(rows, "k string, d string, m double").withColumn("d", F.to_timestamp("d"))
    got = sorted(r["m"] for r in subqueries.gt_all_prior(df, "k", "m", "d", "2024-01-01").collect() if r["m"] is not None)
    assert got == [1.0, 2.0, 5.0]


def test_full_outer_keeps_both_lonely_sides(spark):
    fact = spark.createDataFrame([(1, 10, "x", 5.0, "2024-05-01"), (2, 99, "y", 7.0, "2024-05-01")], "id int, fk int, g1 string, m double, d string")
    dim = spark.createDataFrame([(10, "A", "2024-05-01"), (11, "B", "2024-05-01"), (12, "C", "2020-01-01")], "pk int, g2 string, e string")
    fact, dim = fact.withColumn("d", F.to_date("d")), dim.withColumn("e", F.to_date("e"))
    got = joins.full_outer_activity(fact, dim, "fk", "pk", "id", "g1", "g2", "m", "d", "e", "2024-01-01")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("x", "A", 1, 5.0), ("y", None, 1, 7.0), (None, "B", 0, None)], key=repr)


def test_column_kinds_and_sanitize(spark):
    df = spark.sql("select 1 as id, 2 as user_id, 3 as orderId, cast(1.5 as decimal(5,2)) as price, double('NaN') as x, array(1d, double('Infinity')) as xs, 'a' as name, timestamp'2024-01-01' as at")
    kinds = profile.column_kinds(df)
    assert kinds["ids"] == ["id", "user_id", "orderId"] and kinds["numeric"] == ["price", "x"] and kinds["datetime"] == ["at"]
    row = one(profile.sanitize(df))
    assert (row["price"], row["x"], row["xs"]) == (1.5, None, [1.0, None])


def test_histogram_of_equal_values_and_totals(spark):
    same = charts.histogram(spark.createDataFrame([(3.0,)] * 4, "v double"), "v", 5).collect()
    assert sum(r["n_rows"] for r in same) == 4
    many = charts.histogram(spark.range(1000).selectExpr("double(id) as v"), "v").collect()
    assert len(many) == 30 and sum(r["n_rows"] for r in many) == 1000


def test_cosine_and_batch_topk(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, [])], "id long, e array<float>")
    got = {r["id"]: r["s"] for r in df.filter("size(e) > 0").select("id", vectors.cosine(F.col("e"), vectors.vector([1, 0])).alias("s")).collect()}
    assert got[1] == 1.0 and got[2] == 0.0 and math.isclose(got[3], 2**-0.5)
    queries = spark.createDataFrame([(100, [1.0, 0.0]), (200, [0.0, 1.0]), (300, [-1.0, 0.0])], "q long, e array<float>")
    for blocks in ((1, 1), (1024, 8192)):
        top = vectors.batch_topk(queries, df.repartition(3), "q", "id", "e", 2, *blocks)
        best = sorted((r["q"], r["place"], r["id"]) for r in top.collect())
        assert best == [(100, 1, 1), (100, 2, 3), (200, 1, 3), (200, 2, 1), (300, 1, 2), (300, 2, 3)]
    assert vectors.batch_topk(queries.limit(0), df, "q", "id", "e", 2).collect() == vectors.batch_topk(queries, df.limit(0), "q", "id", "e", 2).collect() == []


def test_batch_topk_of_many_queries(spark):
    """10,000 queries (one of them twice, one without a vector), text keys, and equal vectors, in several blocks."""
    rng = np.random.default_rng(1)
    known = [(f"k{i:03d}", rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(300)]
    asked = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(9999)]
    asked += [asked[5], (10_000, None)]
    df = spark.createDataFrame(known, "key string, v array<double>")
    top = vectors.batch_topk(spark.createDataFrame(asked, "q long, v array<double>"), df, "q", "key", "v", 3, 700, 90)
    assert top.dtypes[:2] == [("q", "bigint"), ("key", "string")]

    def unit(vs):
        m = np.array(vs)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    scores = np.round(unit([v for _, v in asked if v]) @ unit([v for _, v in known]).T, 12) + 0.0
    want = sorted((q, known[i][0], p + 1) for (q, _), line in zip(asked, scores) for p, i in enumerate(np.argsort(-line, kind="stable")[:3]))
    assert sorted((r["q"], r["key"], r["place"]) for r in top.collect()) == want


def test_time_to_ms(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01T01:00:00+01:00",), ("x",), (None,)], "s string")
    got = [r["ms"] for r in df.select(timeconv.to_ms(F.col("s"), T.StringType()).alias("ms")).collect()]
    assert got == [1704067200000, 1704067200000, 0, 0]


def test_request_rate_lower_bound_is_open(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-01 00:00:30",), ("2024-01-01 00:01:00",), ("2024-01-01 00:01:00",)], "ts string")
    got = {str(r["ts"]): r["requests_per_second"] for r in telemetry.request_rate(df.withColumn("ts", F.to_timestamp("ts")), "ts").collect()}
    assert list(got.values()) == [1 / 60, 2 / 60, 3 / 60] or sorted(got.values()) == [1 / 60, 2 / 60, 3 / 60]


def test_history_pages_bound_a_hot_chat(spark):
    rows = spark.range(2500).selectExpr(
        "1L as chat_id", "1L as user_id", "id as position", "string(id) as message_id", "'user' as sender", "id as created_at", "'t' as text",
        "cast(null as string) as query", "false as has_attachment", "'' as attachment_path", "false as has_visualization", "'' as visualization_path", "false as error",
    )
    pages = chats.history(rows).orderBy("page").collect()
    assert [len(p["history"]) for p in pages] == [1000, 1000, 500]
    assert [m["position"] for p in pages for m in p["history"]] == list(range(2500))


def test_jdbc_options():
    opts = readers.jdbc_options("postgres", "h", "d", "u", "p", query="select 1;", partition_column="id", bounds=(0, 9), partitions=4)
    assert opts["url"] == "jdbc:postgresql://h:5432/d" and opts["dbtable"] == "(select 1) q" and opts["numPartitions"] == "4"
    assert readers.jdbc_options("mysql", "h", "d", "u", "p", table="t")["url"].endswith(":3306/d")
    assert "databaseName=d" in readers.jdbc_options("mssql", "h", "d", "u", "p", table="t")["url"]
    with pytest.raises(ValueError):
        readers.jdbc_options("mysql", "h", "d", "u", "p")


def test_csv_missing_values_and_columns(spark, tmp_path):
    path = tmp_path / "train.csv"
    path.write_text('sql_prompt,sql_context,sql,sql_complexity\n"a\n""b""",,SELECT 1,NA\n"","NULL",x,basic\n')
    got = [tuple(r) for r in readers.read_corpus_csv(spark, str(path)).collect()]
    assert got == [('a\n"b"', None, "SELECT 1", None), (None, None, "x", "basic")]
    path.write_text("sql_prompt,sql\na,b\n")
    with pytest.raises(ValueError, match="missing columns"):
        readers.read_corpus_csv(spark, str(path))


def test_gt_all_prior_equals_brute_force_within_hours(spark):
    import random
    from datetime import datetime, timedelta

    rnd = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = [
        (rnd.choice("ab"), start + timedelta(minutes=rnd.randrange(0, 4 * 24 * 60, 7)), None if rnd.random() < 0.02 else float(rnd.randrange(60)), i)
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "k string, d timestamp_ntz, m double, id long")
    got = sorted((r["k"], r["m"]) for r in subqueries.gt_all_prior(df, "k", "m", "d", "2024-01-01", days=1).collect() if r["m"] is not None)
    want = []
    for k, d, m, _ in rows:
        seen = [x[2] for x in rows if x[0] == k and d - timedelta(days=1) <= x[1] < d]
        if m is not None and (not seen or (None not in seen and m > max(seen))):
            want.append((k, m))
    assert got == sorted(want)


def test_category_list_has_pages(spark):
    fact = spark.range(2500).selectExpr("id as fk", "id % 2 = 0 as g1", "1.0D as m", "timestamp_ntz'2024-01-01 00:00:00' as d")
    dim = spark.range(2500).selectExpr("id as pk", "case when id < 2400 then concat('c', lpad(id, 4, '0')) end as g2")
    out = joins.category_list(fact, dim, "fk", "pk", "g1", "g2", "m", "d", "2024-01-01", page=500).collect()
    assert [(r["page"], len(r["category_list"].split(", ")), r["distinct_categories"]) for r in out if r["g1"]] == [(0, 500, 1200), (1, 500, 1200), (2, 200, 1200)]
    names = [n for r in out if not r["g1"] for n in r["category_list"].split(", ")]
    assert names == [f"c{i:04d}" for i in range(1, 2400, 2)]


def test_high_value_rate_counts_the_left_join(spark):
    """A group without facts at all counts a row; one with old facts only counts none; null dates count."""
    dim = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, None), (6, "c")], "pk long, g string")
    fact = spark.createDataFrame(
        [(1, 10, 9.0, "2024-02-01"), (1, 10, 1.0, "2024-02-01"), (3, 11, 9.0, "2020-01-01"), (4, 12, 9.0, None), (5, None, 9.0, "2024-02-01"), (5, 13, None, "2024-03-01"), (9, 14, 9.0, "2024-02-01")],
        "fk long, pk1 long, m double, d string",
    ).withColumn("d", F.col("d").cast("timestamp"))
    out = joins.high_value_rate(fact, dim, "fk", "pk", "pk1", "g", "m", "d", "2024-01-01", 5)
    assert {(r["g"], r["related_count"], r["high_value_count"], r["high_value_pct"]) for r in out.collect()} == {("a", 1, 1, 33.33), ("b", 1, 1, 100.0), (None, 1, 1, 50.0)}


def test_text_stats_of_one_value_and_none(spark):
    rows = spark.createDataFrame([("a", "xx"), ("a", "xx"), ("a", None), ("b", None), ("c", "x"), ("c", "xxxx")], "k string, t string")
    got = {r["k"]: r for r in corpus.text_stats(rows, ["t"], ["k"]).collect()}
    assert (got["a"]["n_values"], got["a"]["unique_count"], got["a"]["len_mean"], got["a"]["len_std"], got["a"]["len_median"]) == (2, 1, 2.0, 0.0, 2.0)
    assert (got["b"]["n_values"], got["b"]["null_rate"], got["b"]["len_mean"], got["b"]["len_std"], got["b"]["len_median"]) == (0, 1.0, None, None, None)
    assert (got["c"]["len_mean"], got["c"]["len_p25"]) == (2.5, 1.75) and math.isclose(got["c"]["len_std"], 3 / 2**0.5)


def test_confusion_matrix_is_wide(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "b"), ("b", "z")], "t string, p string")
    out = evaluation.confusion_matrix(rows, "t", "p", ["a", "b", "c"]).orderBy("true_class")
    assert [tuple(r) for r in out.collect()] == [("a", 1, 2, 0), ("b", 0, 0, 0)]
