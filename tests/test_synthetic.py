import re

import pytest
from pyspark.sql import functions as F

from bindings.registry import Tables
from bindings.synthetic import catalogue
from tidemark.plans import curation, synthetic
from tidemark.sources import readers

TARGETS = {"CTEs": 300, "set operations": 200, "multiple_joins": 250, "window functions": 150, "subqueries": 100, "basic": 9}


@pytest.fixture(scope="module")
def tables(spark):
    return catalogue(Tables(spark, "/root/testdata/sf0.001")).cache()


@pytest.fixture(scope="module")
def rows(spark, tables):
    return synthetic.generate(spark, TARGETS, tables, seed=7).cache()


def test_counts_follow_targets(rows):
    got = {r["sql_complexity"]: r["n"] for r in rows.groupBy("sql_complexity").agg(F.count("*").alias("n")).collect()}
    assert got == {k: n for k, n in TARGETS.items() if k != "basic"}


def test_no_placeholder_is_left(rows):
    for r in rows.collect():
        for text in (r["sql"], r["sql_prompt"], r["sql_explanation"]):
            assert text and not re.search(r"[{}]", text), text
        assert r["sql_context"].startswith("CREATE TABLE") and "INSERT INTO" in r["sql_context"]


def test_same_seed_same_rows_any_partitioning(spark, rows, tables):
    again = synthetic.generate(spark, TARGETS, tables, seed=7).repartition(3)
    assert rows.select("row_id", "sql_prompt", "sql").exceptAll(again.select("row_id", "sql_prompt", "sql")).count() == 0
    other = synthetic.generate(spark, TARGETS, tables, seed=8)
    assert rows.select("sql").exceptAll(other.select("sql")).count() > 100


def test_two_table_templates_use_two_tables(spark, rows):
    joins = rows.filter("sql_complexity = 'multiple_joins'").select("sql_context").collect()
    assert all(r["sql_context"].count("CREATE TABLE") == 2 for r in joins)


def test_eligible_respects_needed_columns(spark):
    domain = spark.createDataFrame(
        [("d", "x", "plain", [("id", "INT", ["1"])], "id", [], [], [], {}), ("d", "x", "full", [("id", "INT", ["1"])], "id", ["g"], ["m"], ["t"], {})],
        "domain string, description string, table_name string, columns array<struct<name:string,type:string,values:array<string>>>, "
        "primary_key string, grouping array<string>, metrics array<string>, dates array<string>, foreign_keys map<string,string>",
    )
    pairs = synthetic.eligible(synthetic.template_table(spark), domain)
    # only templates that need two tables with grouping columns alone can use both tables
    two = {r["template"] for r in pairs.filter("n_tables = 2").collect()}
    assert two == {"either_plain", "stacked_plain", "shared_plain", "missing_plain", "missing_rows_plain"}
    groups = pairs.filter("template = 'either_plain'").select(F.explode("tables").alias("t")).select("t.table_name", "t.g").collect()
    assert {r["table_name"]: r["g"] for r in groups} == {"plain": ["id"], "full": ["g"]}


def test_context_stops_at_shortest_column(spark):
    df = spark.createDataFrame([([("a", "INT", ["1", "2", "3"]), ("b", "DATE", ["x", "y"])],)], "c array<struct<name:string,type:string,values:array<string>>>")
    text = df.select(synthetic.context(F.lit("t"), F.col("c")).alias("x")).first()["x"]
    assert text == "CREATE TABLE t (a INT, b DATE); INSERT INTO t (a, b) VALUES (1, 'x'), (2, 'y');"


def raw_rows(spark):
    return spark.range(600).selectExpr(
        "id as row_id", "case when id % 10 = 0 then 'test' else 'train' end as split", "concat('q', id % 200) as sql_prompt",
        "case when id % 3 = 0 then null else 'CREATE TABLE t (a INT);' end as sql_context",
        "case when id % 50 = 1 then 'SELEC' else concat('SELECT ', id % 200, ' FROM t') end as sql",
        "case when id % 4 = 0 then 'CTEs' when id % 5 = 1 then null else 'basic' end as sql_complexity",
    )


def test_curation_stops(spark, tables):
    with pytest.raises(ValueError, match="both val and test"):
        again = raw_rows(spark).withColumn("row_id", F.col("row_id") + 1000).withColumn("split", F.lit("train"))
        curation.curate(raw_rows(spark).unionByName(again), tables, share=0.5)
    with pytest.raises(ValueError, match="missing_column sql_context"):
        curation.curate(raw_rows(spark).drop("sql_context"), tables)
    with pytest.raises(ValueError, match="null_value in sql_prompt"):
        curation.curate(raw_rows(spark).withColumn("sql_prompt", F.when(F.col("row_id") > 3, F.col("sql_prompt"))), tables)


def test_split_keeps_every_row(spark):
    from tidemark.operators.corpus import stratified_split

    df = spark.range(61).selectExpr("id", "case when id < 20 then null when id = 60 then 'alone' else 'x' end as c")
    out = stratified_split(df, "c", "id", 0.6).collect()
    assert sorted(r["id"] for r in out) == list(range(61))
    assert sum(r["c"] is None and r["split"] == "val" for r in out) == 12
    assert [r["split"] for r in out if r["c"] == "alone"] == ["train"]


def test_curation_invariants(spark, tables):
    out = curation.curate(raw_rows(spark), tables, on_overlap="drop").cache()
    assert out.filter("sql_complexity is null").count() > 0
    assert out.filter("split = 'train'").join(out.filter("split <> 'train'"), ["input_text", "sql"], "left_semi").count() == 0
    assert out.groupBy("split", "input_text", "sql").count().filter("count > 1").count() == 0
    assert out.filter(F.col("sql").rlike("(?i)insert\\s+into") | F.col("input_text").rlike("(?i)insert\\s+into")).count() == 0
    assert set(r["split"] for r in out.select("split").distinct().collect()) == {"train", "val", "test"}


def test_releases_are_compared(spark, tables, tmp_path):
    """The first release has nothing to compare with; the next ones see the train split of the one before."""
    root, day = str(tmp_path / "corpus"), iter(["d1", "d2", "d3"])

    def release(rows, **limits):
        out = curation.release(rows, tables, root, next(day), limits, on_overlap="drop")
        return {r["metric"]: r["value"] for r in out.collect()}

    assert release(raw_rows(spark)) == {"compared": 0.0}
    assert readers.published(spark, root).filter("split = 'train'").count() > 0
    same = release(raw_rows(spark))
    assert same["compared"] == 1 and same["drift_detected"] == 0 and same["size_change_pct"] == 0
    longer = raw_rows(spark).withColumn("sql", F.when(F.col("sql_complexity") == "basic", F.concat("sql", F.lit(" WHERE a = 1"))).otherwise(F.col("sql")))
    got = release(longer)
    assert got["drift_detected"] == 1 and got["basic_mean_pct_change"] > 5 and got["previous_rows"] == same["current_rows"]
    kept = readers.published(spark, root)
    assert kept.filter("split = 'train'").count() == got["current_rows"]
    assert spark.read.json(f"{root}/d3/drift").count() == len(got)


def test_an_empty_pointer_is_an_error(spark, tmp_path):
    assert readers.published(spark, str(tmp_path)) is None
    spark.createDataFrame([], "latest string, folder string").write.json(str(tmp_path / "_latest"))
    with pytest.raises(ValueError, match="empty"):
        readers.published(spark, str(tmp_path))
