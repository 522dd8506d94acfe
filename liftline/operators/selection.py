"""Exact percentiles of groups of any size by counting digits.

A double becomes a 64-bit number of the same order. A round counts values by their leading digit of 16 bits, a group's
running counts say in which digit a wanted rank lies, and the next round counts the next digit of the values that
begin so. Counts are summed before the shuffle, so a task sees at most 65 536 numbers of a group, however large it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftline.scratch import settle

_DIGIT, _KEY = 16, 64


def ordered_key(x: Column) -> Column:
    """A BIGINT in the order of the doubles; both zeros are one."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x + F.lit(0.0)).cast("bigint")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(2**63 - 1)))


def key_value(key: Column) -> Column:
    bits = F.when(key >= 0, key).otherwise(key.bitwiseXOR(F.lit(2**63 - 1)))
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def _same(by: list[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in by), F.lit(True))


def ranked_values(rows: DataFrame, by: list[str], value: str, wanted: DataFrame) -> DataFrame:
    """by, place, x: of each wanted (by, place) the value at that place, from 0, in the group's order. Rows are (by, value), without nulls."""
    keyed = settle(rows.select(*by, ordered_key(F.col(value).cast("double")).alias("key")))
    left = wanted.select(*by, "place", F.col("place").alias("inner"), F.lit(None).cast("bigint").alias("head"))
    for shift in range(_KEY - _DIGIT, -1, -_DIGIT):
        cell = F.shiftright(F.col("r.key"), shift) if shift else F.col("r.key")
        if shift == _KEY - _DIGIT:
            head = F.lit(None).cast("bigint")
            live = keyed.alias("r")
        else:  # only what begins like a wanted place
            head = F.shiftright(F.col("r.key"), shift + _DIGIT)
            heads = left.select(*by, "head").distinct().alias("h")
            live = keyed.alias("r").join(heads, _same(by, "r", "h") & (head == F.col("h.head")), "left_semi")
        counts = live.groupBy(*(F.col(f"r.{k}") for k in by), head.alias("head"), cell.alias("cell")).agg(F.count(F.lit(1)).alias("c"))
        upto = F.sum("c").over(Window.partitionBy(*by, "head").orderBy("cell"))
        counts = counts.withColumn("upto", upto).alias("c")
        met = left.alias("w").join(counts, _same(by, "w", "c") & F.col("w.head").eqNullSafe(F.col("c.head")) & (F.col("w.inner") >= F.col("c.upto") - F.col("c.c")) & (F.col("w.inner") < F.col("c.upto")))
        left = settle(met.select(*(F.col(f"w.{k}") for k in by), F.col("w.place"), (F.col("w.inner") - F.col("c.upto") + F.col("c.c")).alias("inner"), F.col("c.cell").alias("head")))
    return left.select(*by, "place", key_value(F.col("head")).alias("x"))


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by, and for each name the group's percentile at its share, between neighbours in proportion; groups without values are left out."""
    known = rows.where(F.col(value).isNotNull()).select(*by, value)
    sizes = settle(known.groupBy(*by).agg(F.count(F.lit(1)).alias("n")))
    spots = F.array(*(F.struct(F.lit(name).alias("name"), (F.lit(share) * (F.col("n") - 1)).alias("spot")) for name, share in shares.items()))
    spots = sizes.select(*by, F.inline(spots)).withColumns({"low": F.floor("spot"), "high": F.ceil("spot")})
    wanted = spots.select(*by, F.explode(F.array("low", "high")).alias("place")).distinct()
    found = ranked_values(known, by, value, wanted)
    ends = {end: found.select(*by, F.col("place").alias(end), F.col("x").alias(f"{end}_x")).alias(end) for end in ("low", "high")}
    met = spots.alias("s").join(ends["low"], _same(by, "s", "low") & (F.col("s.low") == F.col("low.low"))).join(ends["high"], _same(by, "s", "high") & (F.col("s.high") == F.col("high.high")))
    part = F.col("s.spot") - F.col("s.low")
    x = F.when(F.col("s.low") == F.col("s.high"), F.col("low_x")).otherwise(F.col("low_x") * (1 - part) + F.col("high_x") * part)
    rows = met.select(*(F.col(f"s.{k}") for k in by), "name", x.alias("x"))
    return rows.groupBy(*by).agg(*(F.max(F.when(F.col("name") == name, F.col("x"))).alias(name) for name in shares))
