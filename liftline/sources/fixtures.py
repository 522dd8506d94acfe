"""Random tables in the schemas of the result files, for trying things out: (strategy, window) pairs are drawn with replacement, so keys repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftline.functions import rng

FAMILIES = ("EMA", "SMA", "RSI", "RSI_LEVEL", "MACD", "PPO", "ROC", "STOCHK")


def _uniform(k: int, low: float, high: float, seed: int) -> Column:
    return F.lit(low) + rng.uniform(F.col("id"), F.lit(k), F.lit(0), F.lit(0), seed) * (high - low)


def _keys(spark: SparkSession, rows: int, strategies: int, windows: int, seed: int) -> DataFrame:
    s = F.floor(_uniform(0, 0, strategies, seed)).cast("int")
    family = F.element_at(F.array(*map(F.lit, FAMILIES)), (s % len(FAMILIES) + 1).cast("int"))
    return spark.range(rows).withColumns({"strategy": F.concat(family, F.lit("_x_IND_pct"), s.cast("string")), "w": (F.floor(_uniform(1, 0, windows, seed)) + 1).cast("int")})


def mc_perwindow(spark: SparkSession, rows: int = 200, strategies: int = 30, windows: int = 24, seed: int = 42) -> DataFrame:
    k = _keys(spark, rows, strategies, windows, seed)
    ranks = {f"{m}_pct_rank": _uniform(10 + i, 0, 100, seed) for i, m in enumerate(("roi", "sharpe", "pf"))}
    actual = {"actual_roi": _uniform(20, -100, 200, seed), "actual_sharpe": _uniform(21, -2, 2, seed), "actual_pf": _uniform(22, 0.3, 3, seed)}
    return k.select("strategy", F.format_string("W%02d", F.col("w")).alias("window"), F.floor(_uniform(2, 20, 201, seed)).cast("int").alias("n_trades"), *(c.alias(n) for n, c in (actual | ranks).items()))


def window_pairs(spark: SparkSession, rows: int = 200, strategies: int = 30, windows: int = 24, seed: int = 42) -> DataFrame:
    """The same keys; the last window has no next outcome, and some next profit factors are infinite."""
    k = _keys(spark, rows, strategies, windows, seed)
    out = {"baseline_is_pf": _uniform(30, 0.3, 3, seed), "baseline_is_roi": _uniform(31, -50, 150, seed)}
    out |= {f"{v}_is_pf": _uniform(32 + i, 0.3, 3, seed) for i, v in enumerate(("ent", "fee", "sli", "entind"))}
    out |= {"baseline_oos_pf": _uniform(40, 0.2, 2.5, seed), "baseline_oos_roi": _uniform(41, -80, 120, seed)}
    out["next_baseline_oos_pf"] = F.when(F.col("w") < windows, F.when(_uniform(43, 0, 1, seed) < 0.02, F.lit(float("inf"))).otherwise(_uniform(42, 0.2, 2.5, seed)))
    return k.select("strategy", F.col("w").alias("window_i"), *(c.alias(n) for n, c in out.items()))


def block_perm(spark: SparkSession, rows: int = 200, strategies: int = 30, windows: int = 24, seed: int = 42) -> DataFrame:
    k = _keys(spark, rows, strategies, windows, seed)
    names = ("iid_rank", *(f"block{b}_rank" for b in (2, 3, 5, 10, 20)))
    return k.select("strategy", F.col("w").cast("string").alias("window"), F.floor(_uniform(2, 20, 201, seed)).cast("int").alias("n_trades"), *(_uniform(50 + i, 0, 100, seed).alias(n) for i, n in enumerate(names)))


def portfolio_mc(spark: SparkSession, rows: int = 500, windows: int = 24, seed: int = 42) -> DataFrame:
    """All six filters; a mark of 999 stands for a profit factor without losses."""
    filters = ("baseline", "rob_ent", "rob_fee", "rob_sli", "rob_entind", "rob_all4")
    name = F.element_at(F.array(*map(F.lit, filters)), (F.col("id") % len(filters) + 1).cast("int"))
    pf = F.when(_uniform(60, 0, 1, seed) < 0.05, F.lit(999.0)).otherwise(_uniform(61, 0.3, 3, seed))
    return spark.range(rows).select(name.alias("filter"), (F.floor(_uniform(1, 0, windows, seed)) + 1).cast("int").alias("window_i"), F.col("id").cast("int").alias("portfolio_id"), pf.alias("actual_pf"), *(_uniform(62 + i, 0, 100, seed).alias(f"{m}_pct_rank") for i, m in enumerate(("roi", "sharpe", "pf"))))
