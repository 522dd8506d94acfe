"""A counter-based random generator in BIGINT arithmetic, the same in every SQL engine.

x -> x ** 5 is a bijection modulo the prime 2 ** 31 - 1; two of them with a linear step between mix the counters.
Draws depend on the seed and the counters alone, not on partitions or order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The modulus and the multipliers of the counters.
PRIME = 2147483647
UNIT, WINDOW, REPLICATE, POSITION = 7919, 104729, 1299709, 15485863


def _fifth_sql(x: str) -> str:
    """x ** 5 mod PRIME; all products stay below 2 ** 62."""
    square = f"(({x}) * ({x}) % {PRIME})"
    return f"(({square} * {square} % {PRIME}) * ({x}) % {PRIME})"


def draw_sql(unit: str, window: str, replicate: str, position: str, seed: int = 42) -> str:
    """SQL for a number in [0, PRIME) from four BIGINT expressions; reads alike in Spark and DuckDB."""
    x0 = f"(({seed} + ({unit}) * {UNIT} + ({window}) * {WINDOW} + ({replicate}) * {REPLICATE} + ({position}) * {POSITION}) % {PRIME})"
    x2 = f"(({_fifth_sql(x0)} * 48271 + ({position}) * 69621 + ({replicate}) * 16807) % {PRIME})"
    return _fifth_sql(x2)


def _fifth(x: Column) -> Column:
    square = x * x % PRIME
    return (square * square % PRIME) * x % PRIME


def draw(unit: Column, window: Column, replicate: Column, position: Column, seed: int = 42) -> Column:
    u, w, b, i = (c.cast("bigint") for c in (unit, window, replicate, position))
    x0 = (F.lit(seed).cast("bigint") + u * UNIT + w * WINDOW + b * REPLICATE + i * POSITION) % PRIME
    return _fifth((_fifth(x0) * 48271 + i * 69621 + b * 16807) % PRIME)


def uniform(unit: Column, window: Column, replicate: Column, position: Column, seed: int = 42) -> Column:
    """In [0, 1)."""
    return draw(unit, window, replicate, position, seed) / F.lit(float(PRIME))
