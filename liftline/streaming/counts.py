"""The algebraic aggregates on unbounded input: rates and tallies by event-time window, late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_lift(rows: DataFrame, time: str, outcome: str, passed: str, by: list[str], width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """start, by, n, hits, n_pass, pass_hits, lift_pp for each tumbling window; the same plan serves a batch and a stream."""
    ok = F.coalesce(F.expr(passed), F.lit(False))
    known = rows.where(F.col(outcome).isNotNull())
    known = known.withWatermark(time, late) if known.isStreaming else known
    out = known.groupBy(F.window(time, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(outcome).alias("hits"), F.count_if(ok).alias("n_pass"), F.sum(F.when(ok, F.col(outcome)).otherwise(0)).alias("pass_hits"))
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return out.select(F.col("w.start").alias("start"), *by, "n", "hits", "n_pass", "pass_hits", ((rate("pass_hits", "n_pass") - rate("hits", "n")) * 100).alias("lift_pp"))


def running_stats(rows: DataFrame, time: str, value: str, by: list[str], width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """start, by, n, mean, sd_pop, above_50: from count, sum and sum of squares, which merge."""
    rows = rows.withWatermark(time, late) if rows.isStreaming else rows
    out = rows.groupBy(F.window(time, width).alias("w"), *by).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"), F.count_if(F.col(value) > 50).alias("above"))
    mean = F.try_divide("s", "n")
    return out.select(F.col("w.start").alias("start"), *by, "n", mean.alias("mean"), F.sqrt(F.greatest(F.try_divide("q", "n") - mean * mean, F.lit(0.0))).alias("sd_pop"), F.try_divide("above", "n").alias("above_50"))
