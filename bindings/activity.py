"""Conversations, telemetry and their streaming forms."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from bindings.registry import register
from bindings.sqltext import GUARD
from bindings.statements import LOG
from tidemark.functions import timeconv
from tidemark.operators import chats, telemetry
from tidemark.streaming import streams

_FIELDS = {
    "chat_id": "conv_id", "user_id": "conv_id % 7", "position": "turn", "message_id": "conv_id || '-' || turn",
    "sender": "CASE WHEN role = 'user' THEN 'user' ELSE 'bot' END", "created_at": "1704067200000 + conv_id * 3600000 + turn * 60000",
    "text": "text", "query": "CASE WHEN role = 'assistant' THEN 'SELECT ' || turn END",
    "has_attachment": "role = 'assistant' AND turn % 3 = 1", "attachment_path": "'results/' || conv_id || '/' || turn || '.csv'",
    "has_visualization": "role = 'assistant' AND turn % 2 = 1", "visualization_path": "'charts/' || conv_id || '/' || turn || '.html'",
    "error": "turn % 5 = 4",
}
MESSAGES = "(SELECT " + ", ".join(f"{v} AS {k}" for k, v in _FIELDS.items()) + " FROM conversations)"


def messages(t):
    return t.conversations.select(*[F.expr(v).alias(k) for k, v in _FIELDS.items()])


@register(
    "chat_list",
    f"""SELECT user_id, chat_id, arg_min(substr(text, 1, 30), position) AS chat_title, min(created_at) AS created_at, max(created_at) AS updated_at
    FROM {MESSAGES} m GROUP BY user_id, chat_id""",
)
def _(t):
    return chats.chat_list(messages(t), 30)


@register(
    "chat_history",
    f"""SELECT user_id, chat_id, floor(position / 1000)::BIGINT AS page, count(*) AS n_messages,
    string_agg(message_id || ':' || sender || ':' || created_at || ':' || coalesce(query, ''), '|' ORDER BY position) AS history FROM {MESSAGES} m GROUP BY ALL""",
)
def _(t):
    flat = F.transform(
        "history", lambda m: F.concat_ws(":", m["message_id"], m["sender"], m["created_at"].cast("string"), F.coalesce(m["content"]["query"], F.lit("")))
    )
    return chats.history(messages(t)).select(
        "user_id", "chat_id", "page", F.size("history").alias("n_messages"), F.array_join(flat, "|").alias("history")
    )


_NEW = f"SELECT chat_id, position + 1 AS position, created_at + 5000 AS created_at FROM {MESSAGES} m WHERE sender = 'bot'"


@register(
    "chat_append",
    f"""SELECT chat_id, count(*) AS n_messages, max(created_at) AS updated_at FROM (
    SELECT chat_id, created_at FROM {MESSAGES} a UNION ALL SELECT chat_id, created_at FROM ({_NEW}) n) u GROUP BY chat_id""",
)
def _(t):
    old = messages(t)
    new = old.filter("sender = 'bot'").withColumns({"position": F.col("position") + 1, "created_at": F.col("created_at") + 5000})
    return chats.append(chats.summary(old), new)


@register(
    "chat_find_path",
    f"""SELECT message_id, attachment_path AS path, 'attachment' AS kind FROM {MESSAGES} a WHERE has_attachment
    UNION ALL SELECT message_id, visualization_path, 'visualization' FROM {MESSAGES} b WHERE has_visualization""",
)
def _(t):
    pages = chats.history(messages(t))
    kinds = [chats.find_path(pages, k).withColumn("kind", F.lit(k)) for k in ("attachment", "visualization")]
    return kinds[0].unionByName(kinds[1])


@register(
    "chat_turn_stats",
    f"SELECT chat_id, sender, count(*) AS n_messages, avg(error::INT) AS error_share FROM {MESSAGES} m GROUP BY ALL",
    {"error_share": 6},
)
def _(t):
    return chats.turn_stats(messages(t))


_ISO = "CASE event_id % 4 WHEN 0 THEN '2024-01-0' || (event_id % 9 + 1) || 'T10:20:30Z' WHEN 1 THEN '2024-02-1' || (event_id % 9) || 'T01:02:03.250+02:00' WHEN 2 THEN '2024-03-01' ELSE 'not a time' END"


@register(
    "time_to_ms",
    f"""SELECT event_id, event_id AS from_int, epoch_us(ts) // 1000 AS from_ts,
    CASE event_id % 4 WHEN 0 THEN epoch_ms(('2024-01-0' || (event_id % 9 + 1) || ' 10:20:30')::TIMESTAMP)
      WHEN 1 THEN epoch_ms(('2024-02-1' || (event_id % 9) || ' 01:02:03.250')::TIMESTAMP) - 7200000 WHEN 2 THEN 1709251200000 ELSE 0 END AS from_text FROM events""",
)
def _(t):
    e = t.events
    return e.select(
        "event_id",
        timeconv.to_ms(F.col("event_id"), T.LongType()).alias("from_int"),
        timeconv.to_ms(F.col("ts"), e.schema["ts"].dataType).alias("from_ts"),
        timeconv.to_ms(F.expr(_ISO), T.StringType()).alias("from_text"),
    )


@register("tel_counter", "SELECT event_type, user_id, count(*) AS total FROM events GROUP BY ALL")
def _(t):
    return telemetry.counter(t.events, ["event_type", "user_id"])


def _bucket_sql(source, col, buckets, keys, also=""):
    k = f"{keys}, " if keys else ""
    extra = f"{also}, " if also else ""
    return " UNION ALL ".join(
        f"""SELECT {k}{extra}'{telemetry.le_name(b)}' AS le, count({col}){'' if b == telemetry.INF else f' FILTER ({col} <= {b})'} AS n_rows FROM {source} GROUP BY {keys}"""
        for b in buckets
    )


_SUMS = "sum(value) AS sum_value, count(value) AS count_value"


@register(
    "tel_histogram",
    _bucket_sql("events", "value", telemetry.DURATION_BUCKETS, "event_type", _SUMS),
    {"sum_value": 2},
)
def _(t):
    return telemetry.histogram(t.events, "value", telemetry.DURATION_BUCKETS, ["event_type"])


@register(
    "tel_result_size",
    _bucket_sql("documents", "n_chars", telemetry.ROW_BUCKETS, "lang", "sum(n_chars)::BIGINT AS sum_value, count(n_chars) AS count_value"),
)
def _(t):
    """Sizes in the buckets of result sizes."""
    return telemetry.histogram(t.documents, "n_chars", telemetry.ROW_BUCKETS, ["lang"])


@register(
    "tel_gauge_last",
    "SELECT event_type, arg_max(value, (ts, event_id)) AS last_value, max(ts) AS at FROM events GROUP BY event_type",
)
def _(t):
    return telemetry.gauge_last(t.events, "value", ["ts", "event_id"], ["event_type"])


@register(
    "tel_request_rate",
    """SELECT DISTINCT ts, count(*) OVER (PARTITION BY ts) AS n_events,
    count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 59999999 MICROSECONDS PRECEDING AND CURRENT ROW) / 60 AS requests_per_second FROM events""",
    {"requests_per_second": 9},
)
def _(t):
    return telemetry.request_rate(t.events, "ts")


@register(
    "tel_token_rates",
    """SELECT event_id, CASE WHEN value > 0 THEN user_id / value END AS tokens_per_second,
    CASE WHEN value > 0 THEN coalesce(value / nullif(user_id, 0), 0) END AS time_per_token FROM events""",
    {"tokens_per_second": 9, "time_per_token": 9},
)
def _(t):
    return telemetry.token_rates(t.events, "user_id", "value").select("event_id", "tokens_per_second", "time_per_token")


_TRIES = """(SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'error') AS retry_count,
  CASE WHEN bool_or(event_type = 'purchase') THEN 'success' WHEN count(*) FILTER (event_type = 'error') < 2 THEN 'retry' ELSE 'end' END AS outcome
  FROM events GROUP BY 1, 2)"""


@register("tel_retry_distribution", _bucket_sql(f"{_TRIES} q", "retry_count", telemetry.RETRY_BUCKETS, "outcome"))
def _(t):
    tries = t.events.withColumn("day", F.to_date("ts"))
    per = telemetry.retries(
        tries, ["user_id", "day"], F.col("event_type") == "error", F.col("event_type") == "purchase", max_retries=2
    )
    return telemetry.retry_distribution(per)


@register(
    "tel_status_rate",
    """SELECT user_id, count(*) FILTER (event_type <> 'error') AS n_success, count(*) FILTER (event_type = 'error') AS n_failure,
    count(*) FILTER (event_type <> 'error') / count(*) AS success_share FROM events GROUP BY user_id""",
    {"success_share": 9},
)
def _(t):
    return telemetry.status_rate(t.events, ["user_id"], F.col("event_type") != "error")


@register(
    "tel_charts_per_query",
    _bucket_sql("(SELECT event_type AS intent, user_id % 22 AS charts FROM events) e", "charts", telemetry.CHART_BUCKETS, "intent",
                "count(*) AS n_queries, sum(charts)::BIGINT AS n_charts"),
)
def _(t):
    rows = t.events.select(F.col("event_type").alias("intent"), (F.col("user_id") % 22).alias("charts"))
    return telemetry.charts_per_query(rows, "charts", "intent")


# ---- streams -------------------------------------------------------------------------

#: The table spans a month and its files come in no order: nothing in it counts as late.
LATE = "40 days"

def _stream(t):
    """The events file as a stream source."""
    schema = t.events.schema
    raw = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _plain_time(df, name="window_start"):
    """Back to the zone-less type that batch results and DuckDB have."""
    return df.withColumn(name, F.col(name).cast("timestamp_ntz"))


@register(
    "stream_request_rate",
    """SELECT window_start, count(*) AS n_events, count(*) / 60 AS requests_per_second FROM (
    SELECT time_bucket(INTERVAL 10 SECONDS, ts) - CAST(unnest(range(6)) AS INT) * INTERVAL 10 SECONDS AS window_start FROM events) w GROUP BY window_start""",
    {"requests_per_second": 9},
)
def _(t):
    return _plain_time(streams.run_available(streams.request_rate(_stream(t), "ts", LATE), ["window_start"]))


@register("stream_counters", "SELECT event_type, user_id, count(*) AS total FROM events GROUP BY ALL")
def _(t):
    labels = ["event_type", "user_id"]
    return streams.running_totals(streams.run_available(streams.counters(_stream(t), "ts", labels, LATE), ["window_start", *labels]), labels)


@register(
    "stream_histogram",
    _bucket_sql("(SELECT *, date_trunc('minute', ts) AS window_start FROM events) e", "value", telemetry.DURATION_BUCKETS, "window_start, event_type", _SUMS),
    {"sum_value": 2},
)
def _(t):
    out = streams.histogram(_stream(t), "ts", "value", telemetry.DURATION_BUCKETS, ["event_type"], LATE)
    return _plain_time(streams.run_available(out, ["window_start", "event_type", "le"]))


@register(
    "stream_gauge_last",
    "SELECT event_type, arg_max(value, (ts, event_id)) AS last_value, max(ts) AS at FROM events GROUP BY event_type",
)
def _(t):
    windows = streams.run_available(streams.gauge_last(_stream(t), "ts", "value", ["ts", "event_id"], ["event_type"], LATE), ["window_start", "event_type"])
    return _plain_time(streams.last_values(windows, ["event_type"]), "at")


@register(
    "stream_error_report",
    f"""SELECT date_trunc('hour', ts) AS window_start, CASE WHEN contains(lower(message), 'syntax') THEN 'syntax_error' ELSE 'execution_error' END AS error_type,
    count(*) AS n_errors FROM ({LOG}) l GROUP BY ALL""",
)
def _(t):
    from bindings.statements import MESSAGE

    log = _stream(t).withColumn("message", F.expr(MESSAGE))
    return _plain_time(streams.run_available(streams.error_report(log, "ts", "message", LATE), ["window_start", "error_type"]))


@register(
    "stream_guard_filter",
    f"SELECT event_id, sql FROM (SELECT event_id, sql, {GUARD} AS f FROM ({LOG}) l) g WHERE f IS NULL",
)
def _(t):
    from bindings.statements import SQL

    log = _stream(t).select("event_id", F.expr(SQL).alias("sql"))
    return streams.run_available(streams.guard_filter(log, "sql"), [], mode="append")
