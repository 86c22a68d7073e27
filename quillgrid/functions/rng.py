"""Random draws that depend on the row alone.

A draw is a hash of the row's key, so a task that is run again after an executor
was lost draws the same numbers, and so does any other SQL engine with md5.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def uniform(key: Column, salt: str) -> Column:
    """A number in [0, 1) from the first 32 bits of md5(salt || key)."""
    digest = F.md5(F.concat(F.lit(salt), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(TWO_32)


def draw_below(bound: int, key: Column, salt: str) -> Column:
    """An integer in 0..bound-1, reproducible in SQL."""
    return F.floor(uniform(key, salt) * F.lit(bound))


def spread_key(bound: int, seed: int, *keys: str | Column) -> Column:
    """An integer in 0..bound-1 for spreading rows; cheaper, Spark's own hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(bound))
