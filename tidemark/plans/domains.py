"""Catalogue of the synthetic rows, derived from given tables.

A domain is a few tables with their first rows.  What a column is for follows from its type and
name: the first column is the primary key, text columns group, numbers are metrics, dates and
timestamps restrict; a column refers to another table of the domain if it ends like that
table's primary key (``o_custkey`` and ``c_custkey``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table that a context shows.
SAMPLE_ROWS = 10

SCHEMA = (
    "domain string, description string, table_name string, columns array<struct<name:string,type:string,values:array<string>>>, "
    "primary_key string, grouping array<string>, metrics array<string>, dates array<string>, foreign_keys map<string,string>"
)

_SQL_TYPES = {"int": "INT", "bigint": "BIGINT", "double": "DOUBLE", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def _ending(column: str) -> str:
    return column.split("_", 1)[-1]


def roles(tables: dict[str, list[tuple[str, str]]]) -> dict[str, dict]:
    """Per table its primary key, grouping, metric and date columns and foreign keys, from (column, type)."""
    primary = {name: columns[0][0] for name, columns in tables.items()}
    out = {}
    for name, columns in tables.items():
        refers = {
            c: other
            for c, _ in columns
            for other, key in primary.items()
            if other != name and c != primary[name] and _ending(c) == _ending(key)
        }
        free = [(c, kind) for c, kind in columns if c != primary[name] and c not in refers]
        out[name] = {
            "primary_key": primary[name],
            "grouping": [c for c, kind in free if kind == "string"],
            "metrics": [c for c, kind in free if kind in ("int", "bigint", "double") or kind.startswith("decimal")],
            "dates": [c for c, kind in free if kind == "date" or kind.startswith("timestamp")],
            "foreign_keys": refers,
        }
    return out


def domain(name: str, description: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Catalogue rows of one domain; each table adds one row with its smallest rows as samples."""
    known = roles({t: df.dtypes for t, df in tables.items()})
    out = None
    for table, df in tables.items():
        texts = [F.col(c).cast("string").alias(c) for c in df.columns]
        first = df.orderBy(*df.columns).limit(SAMPLE_ROWS).select(F.struct(*df.columns).alias("place"), *texts)
        listed = first.agg(F.sort_array(F.collect_list(F.struct("place", *df.columns))).alias("rows"))
        columns = F.array(
            *[
                F.struct(F.lit(c).alias("name"), F.lit(_SQL_TYPES.get(kind, "VARCHAR(255)")).alias("type"), F.col("rows")[c].alias("values"))
                for c, kind in df.dtypes
            ]
        )
        own = known[table]
        strings = {k: F.array(*map(F.lit, own[k])).cast("array<string>").alias(k) for k in ("grouping", "metrics", "dates")}
        pairs = [F.lit(x) for pair in own["foreign_keys"].items() for x in pair]
        row = listed.select(
            F.lit(name).alias("domain"), F.lit(description).alias("description"), F.lit(table).alias("table_name"), columns.alias("columns"),
            F.lit(own["primary_key"]).alias("primary_key"), *strings.values(), F.create_map(*pairs).cast("map<string,string>").alias("foreign_keys"),
        )
        out = row if out is None else out.unionByName(row)
    return out
