"""Time values of mixed form as epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_ms(col: Column, kind: T.DataType) -> Column:
    """Integers pass, timestamps and ISO strings are converted, what cannot be read is 0."""
    if isinstance(kind, T.IntegralType):
        value = col.cast("long")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        value = F.unix_millis(col.cast("timestamp"))
    elif isinstance(kind, T.StringType):
        value = F.unix_millis(col.try_cast("timestamp"))
    else:
        value = F.lit(None).cast("long")
    return F.coalesce(value, F.lit(0).cast("long"))
