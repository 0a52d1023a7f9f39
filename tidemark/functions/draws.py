"""Seeded draws that depend on a row's key only: same rows for any partitioning or retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 1 << 60


def draw(key: Column, seed: int) -> Column:
    """Uniform integer in [0, 2**60)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def pick(n: Column | int, seed: int, slot: str, key: Column) -> Column:
    """Integer in [0, n), one independent draw per slot name, from the first 48 bits of an MD5.

    Any engine that has MD5 can repeat it; for n below a million the shares of the values
    differ by less than one in a hundred million.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}/{slot}:"), key.cast("string")))
    size = F.lit(n) if isinstance(n, int) else n
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), size.cast("long")).cast("int")
