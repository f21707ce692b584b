"""Reproducible draws: a counter hash of integer keys, so a draw depends on its keys and never on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The two halves of a state are numbers below these primes; a fifth power permutes each (5 divides neither prime less one).
PRIME, SECOND = 2_147_483_647, 2_147_483_629
#: A state is first half * HALF + second half, so that it has 62 bits; the upper BITS of them make a number.
HALF, BITS = 1 << 31, 52


def hashed(df: DataFrame, name: str, keys: list[Column | str | int], start: str | int = 0) -> DataFrame:
    """df with a column name in [0, 2^62): start and the keys, mixed one after another.

    A step mixes the key and both halves into the first, then the key and the new first into the second: from one start, two
    keys in [0, 2^61) never give one state. Keys may be negative. Each step is a column of its own, so that no expression is
    computed twice. start: a number or a column that is hashed already, whose mixing is then
    shared by several draws.
    """
    x, y, power = f"_{name}_x", f"_{name}_y", f"_{name}_4"
    first = F.col(start) if isinstance(start, str) else F.lit(start).cast("long")
    df = df.withColumns({x: F.shiftright(first, 31), y: first.bitwiseAND(F.lit(HALF - 1))})
    for key in keys:
        k = F.lit(key).cast("long") if isinstance(key, int) else (F.col(key) if isinstance(key, str) else key).cast("long")
        for own, other, p in ((x, y, PRIME), (y, x, SECOND)):
            df = df.withColumn(own, (F.col(own) * 48271 + F.col(other) * 40692 + F.pmod(k, F.lit(p)) * 69621 + 12345) % p)
            df = df.withColumn(power, F.col(own) * F.col(own) % p).withColumn(power, F.col(power) * F.col(power) % p)
            df = df.withColumn(own, F.col(power) * F.col(own) % p).drop(power)
    return df.withColumn(x, F.col(x) * HALF + F.col(y)).drop(y).withColumnRenamed(x, name)


def uniform(column: str) -> Column:
    """A hashed column as a number in (0, 1)."""
    return (F.shiftright(column, 62 - BITS) + 0.5) / float(1 << BITS)


def with_uniform(df: DataFrame, name: str, keys: list[Column | str | int], start: str | int = 0) -> DataFrame:
    return hashed(df, f"_{name}", keys, start).withColumn(name, uniform(f"_{name}")).drop(f"_{name}")


def with_normal(df: DataFrame, name: str, start: str, stream: int) -> DataFrame:
    """A standard normal from a hashed column and a stream number, by Box and Muller."""
    df = hashed(hashed(df, "_u", [2 * stream], start), "_v", [2 * stream + 1], start)
    return df.withColumn(name, F.sqrt(-2 * F.log(uniform("_u"))) * F.cos(2 * math.pi * uniform("_v"))).drop("_u", "_v")
