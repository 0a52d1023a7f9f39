"""Conversations.

The working form has one row per message:
``chat_id, user_id, position, message_id, sender, created_at, text, query,
attachment_path, visualization_path, has_attachment, has_visualization, error``.
The nested form groups messages into pages of bounded length, so a chat that holds a
third of all messages is many rows, not one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = 1000


def chat_list(messages: DataFrame, title_chars: int, user_id=None) -> DataFrame:
    """Chats of a user (or of all users), newest first; titled by the first ``title_chars`` characters of the first message."""
    rows = messages if user_id is None else messages.filter(F.col("user_id") == user_id)
    return (
        rows.groupBy("user_id", "chat_id")
        .agg(
            F.min_by(F.substring("text", 1, title_chars), "position").alias("chat_title"),
            F.min("created_at").alias("created_at"),
            F.max("created_at").alias("updated_at"),
        )
        .orderBy("user_id", F.desc("updated_at"), "chat_id")
    )


def history(messages: DataFrame, page: int = PAGE) -> DataFrame:
    """Ordered message arrays, ``page`` positions per row."""
    content = F.struct(
        F.col("text"), F.col("query"),
        F.struct(F.col("has_attachment"), F.col("attachment_path").alias("storage_path")).alias("attachment"),
        F.struct(F.col("has_visualization"), F.col("visualization_path").alias("storage_path")).alias("visualization"),
    ).alias("content")
    message = F.struct("position", "message_id", "sender", "created_at", content, "error")
    return (
        messages.groupBy("user_id", "chat_id", F.floor(F.col("position") / page).alias("page"))
        .agg(F.sort_array(F.collect_list(message)).alias("history"))
    )


def summary(messages: DataFrame) -> DataFrame:
    return messages.groupBy("chat_id").agg(F.count(F.lit(1)).alias("n_messages"), F.max("created_at").alias("updated_at"))


def append(chats: DataFrame, new: DataFrame) -> DataFrame:
    """Chat summaries after new messages: only the new messages are aggregated."""
    more = summary(new).withColumnsRenamed({"n_messages": "n_new", "updated_at": "at_new"})
    return chats.join(more, "chat_id", "full").select(
        "chat_id",
        (F.coalesce("n_messages", F.lit(0)) + F.coalesce("n_new", F.lit(0))).alias("n_messages"),
        F.greatest("updated_at", "at_new").alias("updated_at"),
    )


def find_path(pages: DataFrame, kind: str, message_id=None, user_id=None) -> DataFrame:
    """Storage path of a message's attachment or visualization, where its flag is set."""
    rows = pages if user_id is None else pages.filter(F.col("user_id") == user_id)
    m = rows.select(F.explode("history").alias("m"))
    if message_id is not None:
        m = m.filter(F.col("m.message_id") == message_id)
    part = F.col(f"m.content.{kind}")
    flag = part.getField("has_attachment" if kind == "attachment" else "has_visualization")
    return m.filter(flag).select(F.col("m.message_id").alias("message_id"), part.getField("storage_path").alias("path"))


def turn_stats(messages: DataFrame) -> DataFrame:
    return messages.groupBy("chat_id", "sender").agg(
        F.count(F.lit(1)).alias("n_messages"), F.avg(F.col("error").cast("double")).alias("error_share")
    )
