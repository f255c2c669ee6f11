"""Portable pseudo-random numbers: the same value in any SQL engine that has MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 2**32


def hash_int(key: Column, seed: int) -> Column:
    """An integer in 0 .. 2**32 - 1 from a key and a seed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A double in [0, 1)."""
    return hash_int(key, seed) / F.lit(float(SPAN))


def gaussian(key: Column, seed: int) -> Column:
    """A standard normal variable, by the Box-Muller transform."""
    u = (hash_int(key, seed) + 1) / F.lit(float(SPAN))
    return F.sqrt(-2 * F.log(u)) * F.cos(F.lit(2 * 3.141592653589793) * uniform(key, seed + 1))
