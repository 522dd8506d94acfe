"""Series operators: resampling, averages, signals, trades, rolling correlation. Recurrences are in ``scan``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftline.functions.expressions import safe_corr
from liftline.operators.scan import numbered


def hourly_last(bars: DataFrame, series: str, ts: str, close: str, tie: str) -> DataFrame:
    """series, hour (epoch hours), close: the last bar of each hour."""
    hour = (F.unix_date(F.to_date(ts)) * 24 + F.hour(ts)).cast("bigint")
    return bars.groupBy(F.col(series).alias("series"), hour.alias("hour")).agg(F.max_by(close, F.struct(ts, tie)).alias("close"))


def common_hours(hourly: DataFrame) -> DataFrame:
    """Only hours that every series has, numbered from 0 in each."""
    k = hourly.select("series").distinct().count()  # one number
    shared = hourly.groupBy("hour").agg(F.countDistinct("series").alias("k")).where(F.col("k") == k).select("hour")
    return hourly.join(numbered(shared, "hour"), "hour")


def sma(x: Column | str, period: int, order: Window) -> Column:
    """Null before there are ``period`` bars."""
    frame = order.rowsBetween(-(period - 1), 0)
    return F.when(F.count(x).over(frame) == period, F.avg(x).over(frame))


def crossover(fast: Column, slow: Column, t: Column, warm: int, short: bool = False) -> Column:
    """1 where fast is above slow, else 0 (or -1 when shorts are taken); 0 while warming up."""
    return F.when((t < warm) | fast.isNull() | slow.isNull(), 0).when(fast > slow, 1).otherwise(-1 if short else 0)


def trade_runs(bars: DataFrame, keys: list[str], position: str = "position", ret: str = "ret", cost: float = 0.0) -> DataFrame:
    """keys, run, position, first_t, last_t, pnl: runs of one non-zero position; its results summed, less a cost."""
    order = Window.partitionBy(*keys).orderBy("t")
    flagged = bars.withColumn("turn", (F.col(position) != F.coalesce(F.lag(position).over(order), F.lit(0))).cast("int"))
    runs = flagged.withColumn("run", F.sum("turn").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.where(F.col(position) != 0).groupBy(*keys, "run", F.col(position).alias("position"))
    return out.agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), (F.sum(F.col(position) * F.coalesce(F.col(ret), F.lit(0.0))) - cost).alias("pnl"))


def walk_forward(t: Column, in_sample: int, out_sample: int) -> tuple[Column, Column]:
    """The window's number, and whether the bar is in-sample."""
    span = in_sample + out_sample
    return F.floor(t / span).cast("int"), (t % span) < in_sample


def rolling_corr(returns: DataFrame, width: int, step: int) -> DataFrame:
    """w, a, b, n, r: correlations of all pairs of series over windows of ``width`` returns every ``step``; 0 where a side is constant.

    Each return is sent to the windows that hold it; pairs meet on (window, t), so no window is gathered whole.
    """
    last = F.floor((F.col("t") - 1) / step).cast("int")
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - width) / step).cast("int"))
    n = returns.agg(F.max("t")).first()[0] or 0
    windows = max(0, (n - width) // step + 1)
    kept = returns.where("ret IS NOT NULL").withColumn("last", F.least(last, F.lit(windows - 1))).withColumn("first", first).where("first <= last")
    spread = kept.select("series", "t", "ret", F.explode(F.sequence("first", "last")).alias("w"))
    a = spread.select("w", "t", F.col("series").alias("a"), F.col("ret").alias("x"))
    b = spread.select("w", "t", F.col("series").alias("b"), F.col("ret").alias("y"))
    return a.join(b, ["w", "t"]).where("a < b").groupBy("w", "a", "b").agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col("x"), F.col("y"), 0.0).alias("r"))


def eigenvalues(pairs: DataFrame) -> DataFrame:
    """w, rank, eigenvalue (falling) of each window's correlation matrix; a group is one small matrix."""

    def apply(g: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(g["a"]) | set(g["b"]))
        at = {x: i for i, x in enumerate(names)}
        m = np.eye(len(names))
        for a, b, r in zip(g["a"], g["b"], g["r"], strict=True):
            m[at[a], at[b]] = m[at[b], at[a]] = r
        values = np.linalg.eigvalsh(m)[::-1]
        return pd.DataFrame({"w": g["w"].iloc[0], "rank": range(1, len(values) + 1), "eigenvalue": values})

    return pairs.groupBy("w").applyInPandas(apply, "w int, rank int, eigenvalue double")


#: Bars that are shuffled as one interval.
SPAN = 64


def expand_intervals(trades: DataFrame, keys: list[str], first: str, last: str, order: list[str], value: str) -> DataFrame:
    """keys, bar, value: every bar from first to last; where trades overlap the last in order holds.

    Trades are cut at multiples of SPAN bars, shuffled by span, and spelled out bar by bar where they have arrived.
    """
    span = F.explode(F.sequence(F.floor(F.col(first) / SPAN), F.floor(F.col(last) / SPAN))).alias("span")
    cut = trades.select(*keys, F.col(first).alias("first"), F.col(last).alias("last"), F.struct(*order, value).alias("held"), span).repartition(*keys, "span")
    bar = F.sequence(F.greatest(F.col("first"), F.col("span") * SPAN), F.least(F.col("last"), F.col("span") * SPAN + SPAN - 1))
    rows = cut.select(*keys, "span", "held", F.explode(bar).alias("bar"))
    return rows.groupBy(*keys, "span", "bar").agg(F.max("held").alias("held")).select(*keys, "bar", F.col(f"held.{value}").alias(value))


def turnover_returns(bars: DataFrame, keys: list[str], fee: float) -> DataFrame:
    """keys, pnl, exposure: each bar's position earns the next return, less a fee on its change; keys without exposure are left out."""
    order = Window.partitionBy(*keys).orderBy("t")
    earned = F.col("position") * F.coalesce(F.lead("ret").over(order), F.lit(0.0)) - F.abs(F.col("position") - F.coalesce(F.lag("position").over(order), F.lit(0))) * fee
    out = bars.withColumn("earned", earned).groupBy(*keys).agg(F.sum("earned").alias("pnl"), F.sum(F.abs("position")).cast("double").alias("exposure"))
    return out.where(F.col("exposure") >= 1e-10)
