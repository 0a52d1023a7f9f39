"""Synthetic text-to-SQL rows at any scale.

``spark.range`` gives the row ids; every choice (template, domain, tables, columns, verb,
numbers) is a seeded draw on the id, so rows repeat for a seed under any partitioning and
no Python runs per row.  The catalogue joined to the ids is the template-by-domain table,
written once so that Catalyst broadcasts it only if its size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.draws import pick
from tidemark.plans import templates
from tidemark.session import materialise

# Ranges and choices of the drawn parameters.
AGGREGATES = ["SUM", "AVG", "MAX", "MIN", "COUNT"]
OPERATORS = [">", ">=", "<", "<=", "!="]
MAX_THRESHOLD, THRESHOLD_STEP, THRESHOLD_CAP = 100_000, 50_000, 150_000
MAX_TOP_N, FIRST_YEAR, YEARS, DAYS_IN_MONTH = 50, 2015, 10, 28
MIN_INTERVAL, MAX_INTERVAL = 30, 365
TASK_TYPE = "analytics and reporting"


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        templates.template_rows(),
        "cls string, template string, n_tables int, needs array<string>, verbs array<string>, sql string, prompts array<string>, explanation string",
    )


def context(name: Column, columns: Column) -> Column:
    """``CREATE TABLE`` and ``INSERT`` text of a table; as many rows as its shortest column.

    ``columns`` is array<struct<name, type, values: array<string>>>.
    """
    names = F.array_join(F.transform(columns, lambda c: c["name"]), ", ")
    typed = F.array_join(F.transform(columns, lambda c: F.concat_ws(" ", c["name"], c["type"])), ", ")
    rows = F.array_min(F.transform(columns, lambda c: F.size(c["values"])))

    def cell(c, i):
        value = F.get(c["values"], i)
        quoted = F.concat(F.lit("'"), value, F.lit("'"))
        return F.coalesce(F.when(F.upper(c["type"]).rlike("^(VARCHAR|CHAR|TEXT|DATE|TIMESTAMP|STRING)"), quoted).otherwise(value), F.lit("NULL"))

    line = F.transform(
        F.when(rows > 0, F.sequence(F.lit(0), rows - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.lit("("), F.array_join(F.transform(columns, lambda c: cell(c, i)), ", "), F.lit(")")),
    )
    create = F.concat(F.lit("CREATE TABLE "), name, F.lit(" ("), typed, F.lit(");"))
    insert = F.concat(F.lit(" INSERT INTO "), name, F.lit(" ("), names, F.lit(") VALUES "), F.array_join(line, ", "), F.lit(";"))
    return F.when(rows > 0, F.concat(create, insert)).otherwise(create)


def fill(text: Column, values: dict[str, Column]) -> Column:
    """Every ``{name}`` of the text replaced by its value; null counts as empty."""
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return text


def eligible(template_df: DataFrame, domain_df: DataFrame) -> DataFrame:
    """Template-domain pairs whose domain has enough tables with the columns a template needs.

    A table without grouping columns groups by its primary key.
    """
    tables = domain_df.select(
        "domain",
        "description",
        F.struct(
            "table_name",
            "primary_key",
            F.when(F.size("grouping") > 0, F.col("grouping")).otherwise(F.array("primary_key")).alias("g"),
            F.col("metrics").alias("m"),
            F.col("dates").alias("d"),
            F.map_entries("foreign_keys").alias("fks"),
        ).alias("t"),
    )
    per_domain = tables.groupBy("domain", "description").agg(F.sort_array(F.collect_list(F.struct(F.col("t.table_name").alias("o"), "t"))).alias("ts"))
    all_domains = per_domain.agg(F.collect_list(F.struct("domain", "description", F.transform("ts", lambda x: x["t"]).alias("tables")))).scalar()

    def fits(t):
        def need(letter, have):
            return ~F.array_contains("needs", letter) | (F.size(have) > 0)

        return need("g", t["g"]) & need("m", t["m"]) & need("d", t["d"])

    pairs = template_df.withColumn("dom", F.explode(all_domains))
    pairs = pairs.withColumn("tables", F.filter("dom.tables", fits)).filter(F.size("tables") >= F.col("n_tables"))
    slot = Window.partitionBy("cls").orderBy("template", "dom.domain")  # catalogue-sized
    return pairs.select(
        "cls", "template", "n_tables", "verbs", "sql", "prompts", "explanation",
        F.col("dom.domain").alias("domain"), F.col("dom.description").alias("domain_description"), "tables",
        (F.row_number().over(slot) - 1).alias("slot"),
    )


def _relation(t1: Column, t2: Column) -> Column:
    """The foreign key between two tables, looked for in either direction; ``id`` when there is none."""

    def from_to(a, b):
        hits = F.filter(a["fks"], lambda e: e["value"] == b["table_name"])
        return F.get(hits, 0)["key"]

    return F.coalesce(from_to(t1, t2), from_to(t2, t1), F.lit("id"))


def generate(spark: SparkSession, targets: DataFrame | dict[str, int], catalogue: DataFrame, seed: int = 42) -> DataFrame:
    """As many rows per class as its target says, about the tables of ``catalogue`` (see ``domains``).

    ``targets`` is (class, needed); classes without templates are skipped.  Its at most
    five usable numbers are read to lay out the id ranges.
    """
    template_df = template_table(spark)
    if isinstance(targets, DataFrame):
        cls, needed = targets.columns[:2]
        known = targets.filter(F.col(cls).isin(*templates.CLASSES))
        targets = {r[cls]: int(r[needed]) for r in known.orderBy(cls).collect()}
    targets = {c: n for c, n in targets.items() if c in templates.CLASSES and n > 0}
    total = sum(targets.values())
    ids = spark.range(0, total, 1, max(spark.sparkContext.defaultParallelism, -(-total // 200_000)))
    bound, cls = 0, F.lit(None).cast("string")
    for name, n in targets.items():
        bound += n
        cls = F.coalesce(cls, F.when(F.col("id") < bound, F.lit(name)))
    pairs = materialise(eligible(template_df, catalogue))
    sizes = pairs.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.agg(F.map_from_entries(F.collect_list(F.struct("cls", "n")))).scalar()

    def at(n, slot):
        return pick(n, seed, slot, F.col("id"))

    def one_of(array, slot):
        return F.get(array, at(F.greatest(F.size(array), F.lit(1)), slot))  # null of an empty array

    def choice(values, slot):
        return F.get(F.array(*[F.lit(v) for v in values]), at(len(values), slot))

    rows = ids.withColumn("cls", cls).withColumn("slot", at(F.element_at(sizes, F.col("cls")), "pair"))
    rows = rows.join(pairs, ["cls", "slot"])
    n_tables = F.size("tables")
    rows = rows.withColumns({"i1": at(n_tables, "t1"), "i2": at(F.greatest(n_tables - 1, F.lit(1)), "t2")})
    # the second table is another one: skip over the first
    second = F.when(F.col("n_tables") > 1, F.col("i2") + (F.col("i2") >= F.col("i1")).cast("int")).otherwise(F.col("i1"))
    rows = rows.withColumns({"t1": F.get("tables", F.col("i1")), "t2": F.get("tables", second)})
    rows = rows.withColumns(
        {
            "threshold": at(MAX_THRESHOLD, "threshold") + 1,
            "year": F.lit(FIRST_YEAR) + at(YEARS, "year"),
            "month": F.lpad((at(12, "month") + 1).cast("string"), 2, "0"),
            "day": F.lpad((at(DAYS_IN_MONTH, "day") + 1).cast("string"), 2, "0"),
            "agg_func": choice(AGGREGATES, "agg"),
            "date_col": F.coalesce(one_of(F.col("t1.d"), "date"), F.lit("created_date")),
            "metric_col": F.coalesce(one_of(F.col("t1.m"), "metric"), F.lit("id")),
        }
    )
    date_string = F.concat_ws("-", F.col("year"), "month", "day")
    since = [
        F.concat(F.lit(">= '"), date_string, F.lit("'")),
        F.concat(F.lit("BETWEEN '"), F.col("year"), F.lit("-01-01' AND '"), F.col("year"), F.lit("-12-31'")),
        None,
        F.concat(F.lit(">= '"), F.col("year"), F.lit("-"), F.col("month"), F.lit("-01'")),
        F.concat(
            F.lit("> DATE_SUB(CURDATE(), INTERVAL "), (at(MAX_INTERVAL - MIN_INTERVAL + 1, "days") + MIN_INTERVAL).cast("string"), F.lit(" DAY)")
        ),
    ]
    styles = [
        F.concat(F.lit("WHERE {date_col} "), s) if s is not None else F.concat(F.lit("WHERE YEAR({date_col}) = "), F.col("year")) for s in since
    ]
    style = at(len(styles), "style")
    where = F.coalesce(*[F.when(style == i, s) for i, s in enumerate(styles)])
    span = F.least(F.lit(THRESHOLD_STEP), F.lit(THRESHOLD_CAP) - F.col("threshold"))
    values = {
        "table1": F.col("t1.table_name"),
        "table2": F.col("t2.table_name"),
        "group_col": one_of(F.col("t1.g"), "group"),
        "group_col1": one_of(F.col("t1.g"), "group1"),
        "group_col2": one_of(F.col("t2.g"), "group2"),
        "partition_col": one_of(F.col("t1.g"), "part"),
        "metric_col": F.col("metric_col"),
        "metric_col2": F.coalesce(one_of(F.col("t2.m"), "metric2"), F.col("metric_col")),
        "date_col": F.col("date_col"),
        "year": F.col("year"),
        "month": F.col("month"),
        "day": F.col("day"),
        "date_string": date_string,
        "threshold": F.col("threshold"),
        "threshold2": F.col("threshold") + at(span + 1, "threshold2"),
        "top_n": at(MAX_TOP_N, "top_n") + 1,
        "cte_name": F.concat(F.col("t1.table_name"), F.lit("_summary")),
        "pk1": F.col("t1.primary_key"),
        "pk2": F.col("t2.primary_key"),
        "fk1": _relation(F.col("t1"), F.col("t2")),
        "verb": one_of(F.col("verbs"), "verb"),
        "comparison_op": choice(OPERATORS, "op"),
    }
    # drawn once per row, then used in three texts
    rows = rows.withColumns({f"v_{k}": v.cast("string") for k, v in values.items()})
    values = {k: F.col(f"v_{k}") for k in values}
    sql = F.replace("sql", F.lit("SUM("), F.concat(F.col("agg_func"), F.lit("(")))
    sql = F.replace(sql, F.lit(templates.BASE_DATE), where)
    # the texts of tables are long: they meet the finished rows, not the drawing of them
    texts = materialise(catalogue.select("domain", "table_name", context(F.col("table_name"), F.col("columns")).alias("context")))
    for i in ("1", "2"):
        named = texts.select("domain", F.col("table_name").alias(f"n{i}"), F.col("context").alias(f"c{i}"))
        rows = rows.withColumn(f"n{i}", F.col(f"t{i}.table_name")).join(named, ["domain", f"n{i}"])
    both = F.when(F.col("n_tables") > 1, F.concat_ws(" ", "c1", "c2")).otherwise(F.col("c1"))
    return rows.select(
        F.col("id").alias("row_id"),
        fill(one_of(F.col("prompts"), "prompt"), values).alias("sql_prompt"),
        both.alias("sql_context"),
        fill(sql, values).alias("sql"),
        fill(F.col("explanation"), values).alias("sql_explanation"),
        "domain",
        "domain_description",
        F.col("cls").alias("sql_complexity"),
        F.lit(TASK_TYPE).alias("sql_task_type"),
    )


def actual_duplicates(df: DataFrame, keys=("sql_prompt", "sql")) -> DataFrame:
    """Generated rows, distinct ones on the keys, and the measured duplicate rate."""
    per = df.groupBy(F.md5(F.to_json(F.struct(*keys))).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct")).withColumns(
        {
            "n_duplicates": F.col("n_rows") - F.col("n_distinct"),
            "duplicate_pct": F.coalesce(F.try_divide((F.col("n_rows") - F.col("n_distinct")) * 100.0, F.col("n_rows")), F.lit(0.0)),
        }
    )
