"""Synthetic rows: how many are needed follows from the class counts of the raw corpus."""

from pyspark.sql import functions as F

from bindings.corpus import RAW, raw
from bindings.registry import ORACLES, register
from bindings.synthetic_sql import DOMAINS, catalogue_sql, columns_of, pairs_sql, synthetic_sql
from tidemark.operators import corpus
from tidemark.plans import domains, synthetic

def catalogue(t):
    out = None
    for name, (description, tables) in DOMAINS.items():
        rows = domains.domain(name, description, {k: getattr(t, k).select(*[c for c, _ in columns_of(v)]) for k, v in tables.items()})
        out = rows if out is None else out.unionByName(rows)
    return out


def targets(t):
    return corpus.balance_targets(raw(t), "sql_complexity")


_NEED = ORACLES["corpus_balance_targets"]


@register("synth_rows", synthetic_sql(_NEED))
def _(t):
    return synthetic.generate(t.spark, targets(t), catalogue(t))


@register(
    "synth_eligible",
    f"""WITH {catalogue_sql()}, {pairs_sql()},
    counted AS (SELECT cls, count(*) AS n_pairs, count(DISTINCT template) AS n_templates, count(DISTINCT domain) AS n_domains FROM pairs GROUP BY cls)
    SELECT sql_complexity, needed, n_pairs, n_templates, n_domains, round(needed / n_pairs, 4) AS rows_per_pair FROM ({_NEED}) n JOIN counted ON cls = sql_complexity""",
)
def _(t):
    """Usable template-domain pairs per class, against the rows that class needs."""
    pairs = synthetic.eligible(synthetic.template_table(t.spark), catalogue(t))
    counts = pairs.groupBy(F.col("cls").alias("sql_complexity")).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("template").alias("n_templates"), F.count_distinct("domain").alias("n_domains")
    )
    both = targets(t).join(counts, "sql_complexity")
    return both.withColumn("rows_per_pair", F.round(F.col("needed") / F.col("n_pairs"), 4))


@register(
    "corpus_merge_synthetic",
    f"""WITH k AS (SELECT sql_complexity, count(*) AS n FROM ({RAW}) r WHERE sql_complexity IS NOT NULL GROUP BY 1)
    SELECT sql_complexity, coalesce(n, 0) AS before, coalesce(n, 0) + coalesce(needed, 0) AS after, coalesce(needed, 0) AS added
    FROM k FULL JOIN ({_NEED}) t USING (sql_complexity)""",
)
def _(t):
    return corpus.merge_report(raw(t), synthetic.generate(t.spark, targets(t), catalogue(t)), "sql_complexity")


_TEMPLATE = "SELECT {group_col}, SUM({metric_col}) FROM {table1} WHERE {group_col} > {threshold} LIMIT {top_n}"


@register(
    "synth_fill",
    f"""SELECT event_id, replace(replace(replace(replace(replace('{_TEMPLATE}', '{{group_col}}', event_type), '{{metric_col}}', 'value'),
    '{{table1}}', 'events_' || user_id), '{{threshold}}', event_id::VARCHAR), '{{top_n}}', (user_id % 50 + 1)::VARCHAR) AS sql FROM events""",
)
def _(t):
    values = {
        "group_col": F.col("event_type"), "metric_col": F.lit("value"), "table1": F.concat(F.lit("events_"), F.col("user_id")),
        "threshold": F.col("event_id"), "top_n": F.col("user_id") % 50 + 1,
    }
    return t.events.select("event_id", synthetic.fill(F.lit(_TEMPLATE), values).alias("sql"))


_COLUMNS = """array(named_struct('name', 'c_custkey', 'type', 'INT', 'values', array(string(c_custkey), string(c_custkey + 1), '7')),
 named_struct('name', 'c_name', 'type', 'VARCHAR(50)', 'values', array(c_name, c_mktsegment)))"""


@register(
    "synth_context",
    """SELECT c_custkey, 'CREATE TABLE customer (c_custkey INT, c_name VARCHAR(50)); INSERT INTO customer (c_custkey, c_name) VALUES ('
    || c_custkey || ', ''' || c_name || '''), (' || (c_custkey + 1) || ', ''' || c_mktsegment || ''');' AS context FROM customer""",
)
def _(t):
    return t.customer.select("c_custkey", synthetic.context(F.lit("customer"), F.expr(_COLUMNS)).alias("context"))


@register(
    "synth_actual_duplicates",
    f"""SELECT n_rows, n_distinct, n_rows - n_distinct AS n_duplicates, coalesce((n_rows - n_distinct) * 100.0::DOUBLE / nullif(n_rows, 0), 0) AS duplicate_pct
    FROM (SELECT count(*) AS n_rows, count(DISTINCT (sql_prompt, sql)) AS n_distinct FROM ({synthetic_sql(_NEED)}) s) c""",
    {"duplicate_pct": 6},
)
def _(t):
    return synthetic.actual_duplicates(synthetic.generate(t.spark, targets(t), catalogue(t)))
