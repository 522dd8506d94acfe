"""The panel: one row per (asset, strategy, window) with in-sample, out-of-sample and next out-of-sample metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftline.functions.expressions import profit_factor, ratio, sharpe

#: Extra cost per trade, in cents, of the robustness variants.
SHOCKS = {"ent": 2000, "fee": 5000, "sli": 8000, "entind": 12000}
CAPITAL_CENTS = 100_000


def trade_metrics(trades: DataFrame, by: list[str], pnl: Column | str = "pnl", shocks: dict[str, int] | None = None) -> DataFrame:
    """n_trades, total, roi, pf, sharpe of whole-cent results by group, and the profit factor under each cost shock; one partial and one final aggregation."""
    p = F.col(pnl) if isinstance(pnl, str) else pnl
    won = lambda x: F.sum(F.greatest(x, F.lit(0)))
    lost = lambda x: F.sum(F.greatest(-x, F.lit(0)))
    sums = [F.count(F.lit(1)).alias("n_trades"), F.sum(p).alias("total"), F.sum(p * p).alias("squares"), won(p).alias("won"), lost(p).alias("lost")]
    for name, cost in (shocks or {}).items():
        sums += [won(p - F.lit(cost)).alias(f"{name}_won"), lost(p - F.lit(cost)).alias(f"{name}_lost")]
    grouped = trades.groupBy(*by).agg(*sums)
    return grouped.select(
        *by,
        "n_trades",
        "total",
        (F.col("total") / F.lit(CAPITAL_CENTS / 100.0)).alias("roi"),
        profit_factor(F.col("won"), F.col("lost")).alias("pf"),
        sharpe(F.col("n_trades"), F.col("total"), F.col("squares")).alias("sharpe"),
        *(profit_factor(F.col(f"{s}_won"), F.col(f"{s}_lost")).alias(f"{s}_pf") for s in (shocks or {})),
    )


def with_outcomes(metrics: DataFrame, keys: list[str], window: str = "window_i") -> DataFrame:
    """Adds oos_* and next_* columns: the same metrics one and two windows on."""
    order = Window.partitionBy(*keys).orderBy(window)
    for k, prefix in ((1, "oos"), (2, "next")):
        metrics = metrics.withColumns({f"{prefix}_{c}": F.lead(c, k).over(order) for c in ("n_trades", "roi", "pf", "sharpe")})
    return metrics


def with_ranks(panel: DataFrame, by: list[str], metrics: tuple[str, ...] = ("roi", "sharpe", "pf"), unique: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Adds {metric}_rank, 0 to 100: the share of a window's other strategies of the group that are strictly below."""
    for m in metrics:
        panel = panel.withColumn(f"{m}_rank", F.percent_rank().over(Window.partitionBy(*by).orderBy(m)) * 100.0)
    return panel


def join_ranks(pairs: DataFrame, ranks: DataFrame, keys: list[str], dedupe: str = "multiply", order: str | None = None) -> DataFrame:
    """Ranks joined to outcomes. On repeated keys of the ranks: multiply rows, or keep the last, the first (by order) or the mean."""
    value = [c for c in ranks.columns if c not in keys and c != order]
    if dedupe == "mean":
        ranks = ranks.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in value))
    elif dedupe in ("last", "first"):
        pick = F.max_by if dedupe == "last" else F.min_by
        ranks = ranks.groupBy(*keys).agg(*(pick(c, order).alias(c) for c in value))
    elif dedupe != "multiply":
        raise ValueError(f"no such way to dedupe: {dedupe}")
    return pairs.join(ranks.select(*keys, *value), keys, "inner")


def hit(pf: Column, null_policy: str = "drop") -> Column:
    """1 where a profit factor is above 1. Missing ones: drop (null), zero (0), finite (null for infinite ones too)."""
    seen = F.when(~F.isnan(pf), pf)
    if null_policy == "zero":
        return F.when(seen > 1, F.lit(1.0)).otherwise(F.lit(0.0))
    if null_policy == "finite":
        seen = F.when(F.abs(seen) != float("inf"), seen)
    elif null_policy != "drop":
        raise ValueError(f"no such null policy: {null_policy}")
    return F.when(seen.isNotNull(), F.when(seen > 1, F.lit(1.0)).otherwise(F.lit(0.0)))


__all__ = ["CAPITAL_CENTS", "SHOCKS", "hit", "join_ranks", "ratio", "trade_metrics", "with_outcomes", "with_ranks"]
