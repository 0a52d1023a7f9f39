"""A log of SQL statements derived from the events table, one per event.

The expressions are plain SQL that Spark and DuckDB both read, so the oracle starts from
the same log.
"""

_Q = [
    "'SELECT user_id, value FROM events WHERE user_id = ' || user_id",
    "'SELECT * FROM ' || event_type",
    "'SELECT a.id FROM a JOIN b ON a.id = b.id WHERE a.k = ' || user_id",
    "'SELECT a.id FROM a INNER JOIN b ON a.id = b.id'",
    "'SELECT a.id FROM a LEFT OUTER JOIN b ON a.id = b.id RIGHT JOIN c ON b.k = c.k'",
    "'SELECT id FROM ' || event_type || ' UNION SELECT id FROM old_' || event_type",
    "'SELECT ROW_NUMBER() OVER (PARTITION BY k ORDER BY v) FROM t' || user_id",
    "'SELECT RANK()OVER(ORDER BY v) FROM t'",
    "'SELECT event_type, COUNT(*), SUM(value) FROM events GROUP BY event_type HAVING COUNT(*) > ' || user_id",
    "'SELECT id FROM t WHERE id IN (SELECT id FROM u WHERE v > ' || user_id || ')'",
    "'SELECT id, (SELECT MAX(v) FROM u) FROM t'",
    "'SELECT id FROM (SELECT id FROM t) x WHERE EXISTS (SELECT 1 FROM u)'",
    "'select avg(value) from events where event_type = ''' || event_type || ''''",
    "'DELETE FROM ' || event_type || ' WHERE id = ' || user_id",
    "'insert into logs values (' || user_id || ')'",
    "'SELECT benchmark(' || user_id || ', now())'",
    "'SELECT comment FROM ' || event_type || chr(10) || 'WHERE id > 3'",
    "'SELECT id FROM a' || chr(10) || 'EXCEPT' || chr(10) || 'SELECT id FROM b'",
    "'SELECT FROM ' || event_type || ' WHERE'",
    "'SELECT (id FROM t WHERE name = ''' || event_type",
    "'   '",
    "'SELECTT id FROM t'",
    "'SELECT LAG(v, 1) OVER (PARTITION BY k ORDER BY d) , MIN(v) FROM t CROSS JOIN u'",
]
N = len(_Q)
SQL = f"CASE event_id % {N} " + " ".join(f"WHEN {i} THEN {q}" for i, q in enumerate(_Q)) + " END"
DB_TYPE = "CASE user_id % 3 WHEN 0 THEN 'postgres' WHEN 1 THEN 'mysql' ELSE 'mssql' END"
PREDICTED = (
    f"CASE event_id % 7 WHEN 0 THEN {SQL} WHEN 1 THEN lower({SQL}) || ' ' WHEN 2 THEN replace({SQL}, 'id', 'key') "
    f"WHEN 3 THEN replace({SQL}, 'SELECT', 'SELECT DISTINCT') WHEN 4 THEN 'SELECT COUNT(*) FROM events' "
    f"WHEN 5 THEN {SQL} || ';' ELSE '' END"
)
MESSAGE = (
    "CASE event_id % 4 WHEN 0 THEN 'ERROR: Syntax error at or near ' || event_type WHEN 1 THEN 'relation does not exist' "
    "WHEN 2 THEN 'You have an error in your SQL syntax' ELSE 'timeout after ' || user_id || ' s' END"
)
QUESTION = (
    "CASE event_id % 5 WHEN 0 THEN 'Show me everything about ' || event_type WHEN 1 THEN 'Total value by category' "
    "WHEN 2 THEN 'top ' || user_id || ' users' WHEN 3 THEN 'List all rows' ELSE 'What happened' END"
)
LOG = (
    f"SELECT event_id, ts, user_id, event_type, value, {SQL} AS sql, {DB_TYPE} AS db_type, {PREDICTED} AS predicted, "
    f"{MESSAGE} AS message, {QUESTION} AS question, event_id % 6 AS n_rows, user_id % 13 + 1 AS n_cols, "
    "event_id % 11 AS n_unique FROM events"
)


def statement_log(t):
    """The log as a DataFrame."""
    from pyspark.sql import functions as F

    return t.events.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.expr(SQL).alias("sql"), F.expr(DB_TYPE).alias("db_type"), F.expr(PREDICTED).alias("predicted"),
        F.expr(MESSAGE).alias("message"), F.expr(QUESTION).alias("question"),
        F.expr("event_id % 6").alias("n_rows"), F.expr("user_id % 13 + 1").alias("n_cols"),
        F.expr("event_id % 11").alias("n_unique"),
    )
