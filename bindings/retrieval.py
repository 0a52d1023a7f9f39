"""Vector retrieval on embeddings."""

from pyspark.sql import functions as F

from bindings.registry import register
from tidemark.operators import vectors
from tidemark.session import shared_folder
from tidemark.sources import sinks


def _first(t, place=0):
    """The vector with the (place + 1)-th smallest id: one row, used as the query."""
    return t.embeddings.orderBy("vec_id").limit(place + 1).collect()[place]["embedding"]


def _q(place):
    return f"(SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1 OFFSET {place})"


_E = "embedding::DOUBLE[]"
_COS = f"list_cosine_similarity({_E}, {_q(0)})"


def _l2(place):
    return f"list_sum(list_transform(list_zip({_E}, {_q(place)}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


@register("vec_cosine", f"SELECT vec_id, {_COS} AS similarity FROM embeddings", {"similarity": 6})
def _(t):
    q = vectors.vector(_first(t))
    return t.embeddings.select("vec_id", vectors.cosine(F.col("embedding"), q).alias("similarity"))


@register("vec_l2_topk", f"SELECT vec_id, {_l2(0)} AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 20", {"distance": 6})
def _(t):
    return vectors.l2_topk(t.embeddings, "vec_id", "embedding", _first(t), 20)


@register(
    "vec_rank_all",
    f"SELECT vec_id, similarity, row_number() OVER (ORDER BY similarity DESC, vec_id) AS place FROM (SELECT vec_id, {_COS} AS similarity FROM embeddings) s",
    {"similarity": 6},
)
def _(t):
    return vectors.rank_all(t.embeddings, "vec_id", "embedding", _first(t))


_REPS = "(SELECT label AS query_label, arg_min(embedding, vec_id)::DOUBLE[] AS q FROM embeddings GROUP BY label)"


def _representatives(t):
    """One vector per label, the one with the smallest id."""
    return t.embeddings.groupBy(F.col("label").cast("long").alias("query_label")).agg(F.min_by("embedding", "vec_id").alias("embedding"))


@register(
    "vec_batch_topk",
    f"""SELECT query_id, vec_id, similarity, place FROM (
    SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS similarity,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS place
    FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) x WHERE place <= 10""",
    {"similarity": 6},
)
def _(t):
    """Every row whose id is divisible by 20 asks all rows."""
    asked = t.embeddings.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.batch_topk(asked, t.embeddings, "query_id", "vec_id", "embedding", 10)


_META = "CASE WHEN label = 3 THEN map('Dataset Summary', 'x') ELSE map('table_name', 'x', 'total_rows', '1') END"


@register(
    "vec_topk_then_filter",
    f"SELECT vec_id, distance FROM (SELECT vec_id, label, {_l2(0)} AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 40) n WHERE label <> 3",
    {"distance": 6},
)
def _(t):
    rows = t.embeddings.withColumn("metadata", F.expr(_META))
    return vectors.topk_then_filter(rows, "vec_id", "embedding", "metadata", _first(t), 40)


def _stage(n, place, k):
    return f"""SELECT {n} AS stage, vec_id, distance, row_number() OVER (ORDER BY distance, vec_id) AS place FROM (
      SELECT vec_id, {_l2(place)} AS distance FROM embeddings ORDER BY distance, vec_id LIMIT {k}) s{n}"""


@register("vec_two_stage", f"{_stage(1, 0, 10)} UNION ALL {_stage(2, 1, 6)}", {"distance": 6})
def _(t):
    return vectors.two_stage(t.embeddings, "vec_id", "embedding", _first(t), _first(t, 1), 5)


_BEST = f"(SELECT vec_id, max(list_cosine_similarity({_E}, q)) AS s FROM embeddings, {_REPS} r GROUP BY vec_id)"


@register(
    "vec_similarity_histogram",
    " UNION ALL ".join(
        f"SELECT '{n}' AS le, count(*) AS n_rows FROM {_BEST} b WHERE round(s, 6) <= {v}"
        for n, v in [(f"{b:g}", b) for b in vectors.BUCKETS] + [("+Inf", "'Infinity'::DOUBLE")]
    ),
)
def _(t):
    # one vector per label: a handful of rows, as the list of databases to choose from is
    reps = [r["embedding"] for r in _representatives(t).orderBy("query_label").collect()]
    best = vectors.best_similarity(t.embeddings, "vec_id", "embedding", reps)
    return vectors.similarity_histogram(best.withColumn("similarity", F.round("similarity", 6)))


@register(
    "vec_upsert",
    """SELECT label::BIGINT AS db, vec_id % 3 AS user_id, CASE WHEN label IN (1, 4) THEN 'new' ELSE 'old' END AS version, count(*) AS n_docs, min(vec_id) AS first_id
    FROM embeddings GROUP BY ALL""",
)
def _(t):
    path = shared_folder(t.spark, "collections")
    docs = t.embeddings.select(
        F.col("label").cast("long").alias("db"), (F.col("vec_id") % 3).alias("user_id"), "vec_id", "embedding", F.lit("old").alias("version")
    )
    sinks.upsert_partitions(docs, path, ["db", "user_id"])
    rebuilt = docs.filter(F.col("db").isin(1, 4)).withColumn("version", F.lit("new"))
    sinks.upsert_partitions(rebuilt, path, ["db", "user_id"])
    # declared schema: partition values would otherwise come back as int
    stored = t.spark.read.schema(docs.schema).parquet(path)
    return stored.groupBy("db", "user_id", "version").agg(F.count(F.lit(1)).alias("n_docs"), F.min("vec_id").alias("first_id"))
