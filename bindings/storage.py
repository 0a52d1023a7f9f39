"""Sources, sinks and the schema catalogue.

Each query writes what it needs below the session's shared folder, reads it back through
the library and returns what was read.
"""

from pyspark.sql import functions as F

from bindings.corpus import ENG, RAW, engineered, raw
from bindings.registry import register
from tidemark.operators import corpus, leakage
from tidemark.session import shared_folder
from tidemark.sources import catalogue, readers, sinks

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
PRIMARY = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"],
    "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"],
}
FOREIGN = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("events", "user_id", "customer", "c_custkey"),
]


def _tables(t):
    return {name: getattr(t, name) for name in TABLES}


@register("src_csv_corpus", f"SELECT split, sql_prompt, sql_context, sql, sql_complexity FROM ({RAW}) r")
def _(t):
    folder = shared_folder(t.spark, "corpus")
    rows = raw(t)
    for split in ("train", "test"):
        part = rows.filter(F.col("split") == split).select(*readers.CORPUS_COLUMNS)
        part.write.options(**sinks.WRITE_CSV).csv(f"{folder}/{split}")
    return readers.read_corpus(t.spark, f"{folder}/train", f"{folder}/test")


def _three_snapshots(t):
    """Snapshots written in an order that is not the order of their names."""
    root = shared_folder(t.spark, "snapshots")
    rows = engineered(t)
    sinks.publish(rows, root, "20240103")
    sinks.publish(corpus.clean(rows), root, "20240101")
    sinks.publish(leakage.dedup_keep_first(rows, ["input_text", "sql"], "row_id"), root, "20240102")
    return root


_DEDUP = f"SELECT '20240102' AS folder, split, count(*) AS n_rows FROM (SELECT DISTINCT split, input_text, sql FROM ({ENG}) e) d GROUP BY split"
_WHOLE = f"SELECT '20240103' AS folder, split, count(*) AS n_rows FROM ({ENG}) e GROUP BY split"


def _read_snapshot(t, root, mode):
    folder = readers.latest_folder(t.spark, root, mode).first()["folder"]
    rows = t.spark.read.parquet(f"{root}/{folder}/data")
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(folder).alias("folder"), "split", "n_rows")


@register("src_latest_snapshot", _DEDUP)
def _(t):
    return _read_snapshot(t, _three_snapshots(t), "first_file")


@register("src_latest_folder_by_max", _DEDUP)
def _(t):
    return _read_snapshot(t, _three_snapshots(t), "last_file")


@register("src_latest_folder_by_name", _WHOLE)
def _(t):
    return _read_snapshot(t, _three_snapshots(t), "name")


@register(
    "sink_result_parquet",
    """SELECT 'u1' AS user_id, '20240101' AS "timestamp", count(*) AS "rows", 3 AS "columns", 'o_orderkey,o_custkey,o_totalprice' AS column_names, true AS result_saved,
    'SELECT 1' AS generated_sql, 'bi' AS visualization_intent FROM orders""",
)
def _(t):
    root = shared_folder(t.spark, "results")
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    folder = sinks.save_result(rows, root, "u1", "20240101", {"generated_sql": "SELECT 1", "visualization_intent": "bi"})
    meta = t.spark.read.json(f"{folder}/metadata")
    return meta.withColumn("column_names", F.array_join("column_names", ","))


@register("sink_csv_export", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(t):
    root = shared_folder(t.spark, "export")
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    folder = sinks.save_result(rows, root, "u2", "20240101", {})
    sinks.export_csv(t.spark, f"{folder}/data", f"{root}/csv")
    return t.spark.read.schema(rows.schema).options(**readers.CSV_OPTIONS).csv(f"{root}/csv")


@register(
    "sink_snapshot_manifest",
    f"""SELECT split, count(*) AS n_rows, '20240105' AS latest, true AS listed FROM ({ENG}) e GROUP BY split""",
)
def _(t):
    root = shared_folder(t.spark, "publish")
    manifest = sinks.publish(engineered(t), root, "20240105")
    listed = manifest.select(F.regexp_extract("file_name", "split=([a-z]+)", 1).alias("split")).distinct().withColumn("listed", F.lit(True))
    latest = t.spark.read.json(f"{root}/_latest").select("latest").scalar()
    rows = t.spark.read.parquet(f"{root}/20240105/data").groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.join(listed, "split", "left").withColumn("latest", latest)


@register("sink_split_csv", f"SELECT input_text, sql, sql_complexity, split FROM ({ENG}) e")
def _(t):
    folder = shared_folder(t.spark, "splits")
    sinks.write_splits(engineered(t), folder)
    return t.spark.read.options(**readers.CSV_OPTIONS).csv(folder)


@register(
    "sink_json_report",
    f"SELECT split, count(*) AS n_rows, count(sql_complexity) AS n_labelled FROM ({ENG}) e GROUP BY split",
)
def _(t):
    path = shared_folder(t.spark, "report") + "/stats"
    sizes = engineered(t).groupBy("split").agg(
        F.struct(F.count(F.lit(1)).alias("n_rows"), F.count("sql_complexity").alias("n_labelled")).alias("sizes")
    )
    sinks.write_report(sizes, path)
    return t.spark.read.json(path).select("split", "sizes.n_rows", "sizes.n_labelled")


def _literal_types():
    base = {
        "region": ["r_regionkey int", "r_name string"], "nation": ["n_nationkey int", "n_name string", "n_regionkey int"],
        "customer": ["c_custkey bigint", "c_name string", "c_nationkey int", "c_acctbal double", "c_mktsegment string"],
        "supplier": ["s_suppkey bigint", "s_name string", "s_nationkey int", "s_acctbal double"],
        "part": ["p_partkey bigint", "p_name string", "p_brand string", "p_type string", "p_size int", "p_retailprice double"],
        "orders": ["o_orderkey bigint", "o_custkey bigint", "o_orderstatus string", "o_totalprice double", "o_orderdate timestamp_ntz", "o_orderpriority string"],
        "lineitem": ["l_orderkey bigint", "l_partkey bigint", "l_suppkey bigint", "l_linenumber int", "l_quantity double", "l_extendedprice double",
                     "l_discount double", "l_tax double", "l_returnflag string", "l_linestatus string", "l_shipdate timestamp_ntz"],
        "events": ["event_id bigint", "ts timestamp_ntz", "user_id bigint", "event_type string", "value double", "props string"],
    }
    return base


_TYPES = _literal_types()
_CATALOGUE = " UNION ALL ".join(
    f"""SELECT '{name}' AS table_name, '{', '.join(cols)}' AS columns, '{','.join(PRIMARY[name])}' AS primary_key,
    '{'; '.join(f'{c}->{rt}.{rc}' for n, c, rt, rc in FOREIGN if n == name)}' AS foreign_keys, count(*) AS total_rows FROM {name}"""
    for name, cols in _TYPES.items()
)


def _flat(cat):
    return cat.select(
        "table_name",
        F.array_join(F.transform("columns", lambda c: F.concat_ws(" ", c["name"], c["type"])), ", ").alias("columns"),
        F.array_join("primary_key", ",").alias("primary_key"),
        F.array_join(
            F.transform("foreign_keys", lambda k: F.concat(k["columns"][0], F.lit("->"), k["referred_table"], F.lit("."), k["referred_columns"][0])), "; "
        ).alias("foreign_keys"),
        "total_rows",
    )


@register("catalog_schema", _CATALOGUE)
def _(t):
    return _flat(catalogue.catalogue(_tables(t), PRIMARY, FOREIGN))


_PK_SQL = [
    f"SELECT '{n}' AS table_name, 'primary' AS kind, '{','.join(k)}' AS key, count(*) - count(DISTINCT ({', '.join(k)},)) AS n_violations FROM {n}".replace(",)", ", 0)")
    for n, k in PRIMARY.items()
]
_FK_SQL = [
    f"SELECT '{n}', 'foreign', '{c}->{rt}.{rc}', count(*) FROM {n} WHERE {c} NOT IN (SELECT {rc} FROM {rt})" for n, c, rt, rc in FOREIGN
]


@register("catalog_key_check", " UNION ALL ".join(_PK_SQL + _FK_SQL))
def _(t):
    return catalogue.check_keys(_tables(t), PRIMARY, FOREIGN)


def _docs(t):
    cat = catalogue.catalogue(_tables(t), PRIMARY, FOREIGN)
    described = cat.select("table_name", F.format_string("Holds %d rows.\n\nSee keys.", "total_rows").alias("description"))
    return catalogue.to_docs(cat, described, "Orders and events.", "shop")


_DOCS = " UNION ALL ".join(
    f"""SELECT '{n}' AS doc_id, '{n}' || chr(10) || chr(10) || 'Holds ' || count(*) || ' rows.' || chr(10) || chr(10) || 'See keys.' AS text, 6 AS n_keys,
    '[{','.join(f'"{k}"' for k in PRIMARY[n])}]' AS primary_key, count(*)::VARCHAR AS total_rows FROM {n}"""
    for n in TABLES
)


@register(
    "catalog_docs",
    f"""{_DOCS} UNION ALL SELECT 'shop Summary', '**Dataset Details**:' || chr(10) || chr(10) || 'Orders and events.', 1, NULL, NULL""",
)
def _(t):
    m = F.col("metadata")
    return _docs(t).select(
        "doc_id", "text", F.size(m).alias("n_keys"), F.try_element_at(m, F.lit("primary_key")).alias("primary_key"),
        F.try_element_at(m, F.lit("total_rows")).alias("total_rows"),
    )


@register(
    "catalog_docs_parse",
    f"""SELECT *, 'Holds ' || total_rows || ' rows.' || chr(10) || chr(10) || 'See keys.' AS description FROM ({_CATALOGUE}) c""",
)
def _(t):
    tables, _ = catalogue.from_docs(_docs(t))
    return _flat(tables.drop("description")).join(tables.select("table_name", "description"), "table_name")
