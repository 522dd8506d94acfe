"""Out-of-sample periods of walk-forward windows and the calendar quarters of their midpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Asset, start, minutes of a bar (null: the same span in days of 24 bars), windows.
ASSETS = (
    ("btc", "2019-12-31", 30, 27), ("doge", "2020-07-10", 30, 21), ("bnb", "2020-02-10", 15, 30), ("sol", "2020-09-14", 60, 7),
    ("eurusd", "2017-07-03", None, 15), ("usdjpy", "2016-03-24", None, 15), ("eurgbp", "2016-03-24", None, 15), ("xauusd", "2016-03-28", None, 15), ("wti", "2016-03-28", None, 15),
)
IN_SAMPLE, ADVANCE = 10_000, 5_000


def oos_periods(spark: SparkSession, assets: tuple = ASSETS, in_sample: int = IN_SAMPLE, advance: int = ADVANCE) -> DataFrame:
    """asset, window_i, start, end, year, quarter: window k trains on in_sample bars and is judged on the next ``advance``."""
    rows = spark.createDataFrame([(a, s, float(60 * m) if m else 3600.0, n) for a, s, m, n in assets], "asset string, begun string, bar double, windows int")
    rows = rows.select("asset", "bar", F.unix_seconds(F.col("begun").cast("timestamp")).cast("double").alias("begun"), F.explode(F.sequence(F.lit(1), F.col("windows"))).alias("window_i"))
    first = F.col("begun") + (F.lit(in_sample) + (F.col("window_i") - 1) * advance) * F.col("bar")
    rows = rows.withColumns({"s": first, "e": first + F.lit(advance) * F.col("bar")})
    middle = F.timestamp_seconds((F.col("s") + F.col("e")) / 2)
    return rows.select("asset", "window_i", F.timestamp_seconds("s").alias("start"), F.timestamp_seconds("e").alias("end"), F.year(middle).alias("year"), F.quarter(middle).alias("quarter"))


def by_quarter(tallies: DataFrame, periods: DataFrame) -> DataFrame:
    """Tallies by (asset, window_i) summed by (year, quarter); windows without a period vanish. The map of periods has a row for each window and asset."""
    met = tallies.join(F.broadcast(periods.select("asset", "window_i", "year", "quarter")), ["asset", "window_i"])
    return met.groupBy("year", "quarter").agg(*(F.sum(c).alias(c) for c in ("n", "hits", "n_pass", "pass_hits"))).where("n > 0")
