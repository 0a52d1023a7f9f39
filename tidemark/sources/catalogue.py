"""Schema catalogue of a set of tables, and its form as text documents.

Parquet declares no keys, so they come as arguments:
``primary = {table: [columns]}``, ``foreign = [(table, column, referred table, referred column)]``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMN = "struct<name:string,type:string,nullable:boolean,default:string,autoincrement:boolean>"
FOREIGN = "struct<columns:array<string>,referred_table:string,referred_columns:array<string>>"
INDEX = "struct<name:string,columns:array<string>,unique:boolean>"
SUMMARY_KEY = "Dataset Summary"


def _strings(values: Sequence[str]):
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def catalogue(
    tables: dict[str, DataFrame],
    primary: dict[str, list[str]] | None = None,
    foreign: Sequence[tuple[str, str, str, str]] = (),
) -> DataFrame:
    """One row per table: columns, keys, indexes (of the primary key) and the row count."""
    primary = primary or {}
    rows = []
    for name, df in tables.items():
        columns = F.array(
            *[
                F.struct(
                    F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(f.nullable).alias("nullable"),
                    F.lit(None).cast("string").alias("default"), F.lit(False).alias("autoincrement"),
                )
                for f in df.schema.fields
            ]
        )
        keys = primary.get(name, [])
        fks = [
            F.struct(_strings([c]).alias("columns"), F.lit(rt).alias("referred_table"), _strings([rc]).alias("referred_columns"))
            for t, c, rt, rc in foreign
            if t == name
        ]
        idx = [F.struct(F.lit(f"pk_{name}").alias("name"), _strings(keys).alias("columns"), F.lit(True).alias("unique"))] if keys else []
        rows.append(
            df.agg(F.count(F.lit(1)).alias("total_rows")).select(
                F.lit(name).alias("table_name"), columns.cast(f"array<{COLUMN}>").alias("columns"), _strings(keys).alias("primary_key"),
                F.array(*fks).cast(f"array<{FOREIGN}>").alias("foreign_keys"), F.array(*idx).cast(f"array<{INDEX}>").alias("indexes"),
                "total_rows",
            )
        )
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def check_keys(
    tables: dict[str, DataFrame], primary: dict[str, list[str]], foreign: Sequence[tuple[str, str, str, str]]
) -> DataFrame:
    """Violations per declared key: repeated or null primary keys, foreign keys without a partner.

    Keys are grouped (map-side combined) before they are compared.
    """
    parts = []
    for name, keys in primary.items():
        per_key = tables[name].groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        has_null = F.lit(False)
        for k in keys:
            has_null = has_null | F.col(k).isNull()
        bad = per_key.agg(
            F.coalesce(F.sum(F.when(has_null, F.col("n")).otherwise(F.col("n") - 1)), F.lit(0)).alias("n_violations")
        )
        parts.append(bad.select(F.lit(name).alias("table_name"), F.lit("primary").alias("kind"), F.lit(",".join(keys)).alias("key"), "n_violations"))
    for name, col, other, other_col in foreign:
        used = tables[name].filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        known = tables[other].select(F.col(other_col).alias("k")).distinct()
        orphans = used.join(known, "k", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_violations"))
        parts.append(
            orphans.select(F.lit(name).alias("table_name"), F.lit("foreign").alias("kind"), F.lit(f"{col}->{other}.{other_col}").alias("key"), "n_violations")
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def to_docs(cat: DataFrame, descriptions: DataFrame | None, summary: str, name: str) -> DataFrame:
    """A document per table, with JSON metadata, and one summary document with a single metadata key.

    ``descriptions`` has (table_name, description).
    """
    if descriptions is not None:
        cat = cat.join(descriptions, "table_name", "left")
    else:
        cat = cat.withColumn("description", F.lit(None).cast("string"))
    meta = F.create_map(
        F.lit("table_name"), F.col("table_name"),
        F.lit("columns"), F.to_json("columns"),
        F.lit("primary_key"), F.to_json("primary_key"),
        F.lit("foreign_keys"), F.to_json("foreign_keys"),
        F.lit("indexes"), F.to_json("indexes"),
        F.lit("total_rows"), F.col("total_rows").cast("string"),
    )
    text = F.concat(F.col("table_name"), F.lit("\n\n"), F.coalesce("description", F.lit("")))
    docs = cat.select(F.col("table_name").alias("doc_id"), text.alias("text"), meta.alias("metadata"))
    one = cat.sparkSession.range(1).select(
        F.lit(f"{name} Summary").alias("doc_id"), F.lit(f"**Dataset Details**:\n\n{summary}").alias("text"),
        F.create_map(F.lit(SUMMARY_KEY), F.lit(summary)).alias("metadata"),
    )
    return docs.unionByName(one)


def from_docs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tables, summary): metadata parsed back; the description is the text after the first blank line."""
    m = F.col("metadata")
    is_summary = F.map_contains_key(m, SUMMARY_KEY)

    def parsed(key: str, kind: str):
        return F.from_json(F.coalesce(F.try_element_at(m, F.lit(key)), F.lit("[]")), kind).alias(key)

    parts = F.split("text", "\n\n", 2)
    tables = docs.filter(~is_summary).select(
        F.coalesce(F.try_element_at(m, F.lit("table_name")), F.col("doc_id")).alias("table_name"),
        F.coalesce(F.get(parts, 1), F.lit("")).alias("description"),
        F.coalesce(F.try_element_at(m, F.lit("total_rows")).cast("long"), F.lit(0)).alias("total_rows"),
        parsed("primary_key", "array<string>"), parsed("foreign_keys", f"array<{FOREIGN}>"),
        parsed("indexes", f"array<{INDEX}>"), parsed("columns", f"array<{COLUMN}>"),
    )
    summary = docs.filter(is_summary).select(F.element_at(m, SUMMARY_KEY).alias("dataset_summary"))
    return tables, summary
