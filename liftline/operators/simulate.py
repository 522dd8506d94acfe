"""Simulated evaluations: price paths, a strategy grid, trades, ranks, filter tables. Sizes are parameters; a path is the unit of parallel work."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liftline.functions import rng
from liftline.operators import resample, scan, sequence
from liftline.operators.lift import FilterSet, lift
from liftline.session import ship

#: GARCH(1,1) weights, degrees of freedom, regimes' volatility and the chance to change regime, of a bar.
DEFAULT = {"alpha": 0.10, "beta": 0.85, "df": 5.0, "calm": 0.008, "wild": 0.02, "switch": 0.01}


def path_values(n: int, momentum: float, drift: float, seed: int, p: dict | None = None) -> np.ndarray:
    """Closes of one path: returns with clustering volatility, heavy tails, regimes and momentum."""
    p = p or DEFAULT
    g = np.random.default_rng(seed)
    shock = g.standard_t(p["df"], n) * np.sqrt((p["df"] - 2) / p["df"])
    turns = (g.random(n) < p["switch"]).cumsum() % 2
    level = np.where(turns == 0, p["calm"], p["wild"]) ** 2
    out, var, last = np.empty(n), level[0], 0.0
    for t in range(n):
        last = drift + momentum * last + np.sqrt(var) * shock[t]
        out[t] = last
        var = level[t] * (1 - p["alpha"] - p["beta"]) + p["alpha"] * (np.sqrt(var) * shock[t]) ** 2 + p["beta"] * var
    return 100 * np.exp(np.cumsum(np.clip(out, -0.5, 0.5)))


def price_paths(spark: SparkSession, paths: int, bars: int, momentum: float = 0.0, drift: float = 0.0, seed: int = 0, params: dict | None = None) -> DataFrame:
    """series, t, close; one group for each path."""
    ship(spark)

    def apply(g: pd.DataFrame) -> pd.DataFrame:
        k = int(g["id"].iloc[0])
        return pd.DataFrame({"series": f"p{k}", "t": np.arange(bars, dtype=np.int32), "close": path_values(bars, momentum, drift, seed * 1_000_003 + k, params)})

    return spark.range(paths).groupBy("id").applyInPandas(apply, "series string, t int, close double")


def strategy_grid(spark: SparkSession, fast: range, slow: range, ratio: float = 1.3) -> DataFrame:
    """strategy, fast, slow: all pairs with slow at least ratio times fast, in a fixed order."""
    f = spark.range(fast.start, fast.stop, fast.step).withColumnRenamed("id", "fast")
    s = spark.range(slow.start, slow.stop, slow.step).withColumnRenamed("id", "slow")
    pairs = f.crossJoin(s).where(F.col("slow") >= F.col("fast") * ratio)
    return pairs.withColumn("strategy", F.row_number().over(Window.orderBy("fast", "slow"))).select("strategy", F.col("fast").cast("int").alias("fast"), F.col("slow").cast("int").alias("slow"))


def grid_positions(series: DataFrame, pairs: list[tuple[int, int]], short: bool = False) -> DataFrame:
    """series, t, ret, strategy, position: every average is computed once, however many strategies use it."""
    order = Window.partitionBy("series").orderBy("t")
    r = scan.log_returns(series)
    r = r.withColumns({f"s{p}": sequence.sma("close", p, order) for p in sorted({x for pair in pairs for x in pair})})
    cells = F.array(*(F.struct(F.lit(k + 1).alias("strategy"), sequence.crossover(F.col(f"s{f}"), F.col(f"s{s}"), F.col("t"), s + 5, short).alias("position")) for k, (f, s) in enumerate(pairs)))
    return r.select("series", "t", "ret", F.inline(cells))


def edge_tag(strategy: Column, window: Column, prevalence: float, dropout: float = 0.3, seed: int = 1) -> Column:
    """Whether a (strategy, window) has an edge: tagged with a chance, some tags dropped."""
    zero = F.lit(0)
    return (rng.uniform(strategy, window, zero, zero, seed) < prevalence) & (rng.uniform(strategy, window, F.lit(1), zero, seed) >= dropout)


def evaluate(series: DataFrame, pairs: list[tuple[int, int]], in_sample: int, out_sample: int, reps: int = 100, cost: float = 0.001, bootstrap: bool = False) -> DataFrame:
    """series, strategy, window_i, n_trades, pf, roi_rank, mdd_rank, calmar_rank, oos_pf, oos_hit: positions, trades in parts per million, ranks of the in-sample sequence, outcome of the out-of-sample bars. Under three trades a profit factor is 0."""
    window, inside = sequence.walk_forward(F.col("t"), in_sample, out_sample)
    rows = grid_positions(series, pairs).withColumns({"window_i": window, "inside": inside})
    runs = sequence.trade_runs(rows, ["series", "strategy", "window_i", "inside"], cost=cost).withColumn("pnl", F.round(F.col("pnl") * 1e6).cast("bigint"))
    sums = runs.groupBy("series", "strategy", "window_i", "inside").agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest("pnl", F.lit(0))).alias("won"), F.sum(F.greatest(-F.col("pnl"), F.lit(0))).alias("lost"), F.array_sort(F.collect_list(F.struct("run", "pnl"))).alias("seq"))
    pf = F.when(F.col("n") < 3, 0.0).when(F.col("lost") == 0, 999.0).otherwise(F.try_divide("won", "lost"))
    sums = sums.withColumn("pf", pf)
    left = sums.where("inside").select("series", "strategy", "window_i", F.col("n").alias("n_trades"), "pf", F.transform("seq", lambda x: x["pnl"]).alias("pnls"))
    right = sums.where("NOT inside").select("series", "strategy", "window_i", F.col("pf").alias("oos_pf"))
    ranked = resample._by_group(left, ["series", "strategy", "window_i", "n_trades", "pf"], ["roi_rank", "mdd_rank", "calmar_rank"], lambda p, s, w: resample.path_kernel(p, s, w, reps, bootstrap=bootstrap))
    return ranked.join(right, ["series", "strategy", "window_i"]).withColumn("oos_hit", (F.col("oos_pf") > 1).cast("double"))


def filter_table(rows: DataFrame, filters: dict[str, str], by: tuple[str, ...] = (), least: int = 10, keep_small: bool = False, edge: str | None = None) -> DataFrame:
    """by, filter, pool, oos_prof_pct, lift_pp, pool_pct (and edge_pct). Pools under ``least`` are left out, or kept with nulls."""
    out = lift(rows, "oos_hit", FilterSet(filters), by)
    if edge:
        tagged = lift(rows.withColumn("tag", F.expr(edge).cast("double")), "tag", FilterSet(filters), by).select(*by, "filter", F.col("pass_pct").alias("edge_pct"))
        out = out.join(tagged, [*by, "filter"])
    big = F.col("n_pass") >= least
    total = F.col("n_pass") + F.col("n_fail")
    values = {"oos_prof_pct": F.col("pass_pct"), "lift_pp": F.col("lift_pp"), "pool_pct": F.try_divide(F.col("n_pass") * 100.0, total)}
    if edge:
        values["edge_pct"] = F.col("edge_pct")
    shown = out.select(*by, "ord", "filter", F.col("n_pass").alias("pool"), *(F.round(F.when(big, c), 2).alias(n) for n, c in values.items()))
    return shown if keep_small else shown.where(F.col("pool") >= least)


def average_filters(tables: DataFrame) -> DataFrame:
    """Means over simulations of the rounded figures; pools rounded down."""
    return tables.groupBy("filter").agg(F.floor(F.avg("pool")).alias("pool"), *(F.avg(c).alias(c) for c in ("oos_prof_pct", "lift_pp", "pool_pct")))


def prevalence_sweep(table: DataFrame, shown: dict[str, str]) -> DataFrame:
    """A wide row for each prevalence: the lifts of the shown filters."""
    return table.where(F.col("filter").isin(*shown)).groupBy("prevalence").pivot("filter", list(shown)).agg(F.first("lift_pp")).withColumnsRenamed(shown)


def tier_summary(rows: DataFrame) -> DataFrame:
    """tier, n, baseline, corr of rank and outcome with at least three trades; a tier named null is a name."""
    from liftline.functions.expressions import safe_corr

    enough = F.col("n_trades") >= 3
    return rows.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), (F.avg("oos_hit") * 100).alias("baseline"), safe_corr(F.when(enough, F.col("roi_rank")), F.when(enough, F.col("oos_pf")), 0.0).alias("corr_mc_roi_oos"))


def factor_portfolios(spark: SparkSession, count: int, members: int = 10, loading: float = 0.5, seed: int = 3) -> DataFrame:
    """portfolio, value: means of members that share a factor, normal draws from sums of twelve uniforms."""
    zero = F.lit(0)
    normal = lambda a, b, s: sum((rng.uniform(a, b, F.lit(k), zero, s) for k in range(12)), F.lit(0.0)) - 6.0
    rows = spark.range(count).select(F.col("id").alias("portfolio"), F.explode(F.sequence(F.lit(1), F.lit(members))).alias("m"))
    value = F.lit(loading) * normal(F.col("portfolio"), zero, seed) + F.lit((1 - loading**2) ** 0.5) * normal(F.col("portfolio"), F.col("m"), seed + 1)
    return rows.groupBy("portfolio").agg(F.avg(value).alias("value"))


def pick_path(bars: DataFrame, edge: Column) -> DataFrame:
    """Of bars on an edge path and on a null path (``path`` edge or null), for each strategy and window those of the path that its tag names."""
    return bars.where(F.col("path") == F.when(edge, F.lit("edge")).otherwise(F.lit("null")))


def signal_sweep(spark: SparkSession, strengths: tuple[float, ...], paths: int, bars: int, pairs: list[tuple[int, int]], in_sample: int, out_sample: int, reps: int = 50) -> DataFrame:
    """tier, phi and the evaluation's rows for each strength of momentum."""
    out = None
    for phi in strengths:  # a short list of parameters; each adds a branch to one plan
        rows = evaluate(price_paths(spark, paths, bars, momentum=phi), pairs, in_sample, out_sample, reps).select(F.lit(f"sweep_phi_{phi}").alias("tier"), F.lit(phi).alias("phi"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def portfolio_null(members: DataFrame, reps: int = 100, seed: int = 5) -> DataFrame:
    """portfolio, actual, null_mean, rank: drawdown of the members' summed sequences (portfolio, member, pnls of one length) against sums of independently permuted ones. A portfolio is one group of a few sequences."""

    def apply(g: pd.DataFrame) -> pd.DataFrame:
        x = np.array(g.sort_values("member")["pnls"].tolist(), np.int64)
        own = resample.max_drawdown(x.sum(axis=0)[None, :], True)[0]
        r = np.random.default_rng(seed + int(g["portfolio"].iloc[0]))
        null = np.array([resample.max_drawdown(r.permuted(x, axis=1).sum(axis=0)[None, :], True)[0] for _ in range(reps)])
        return pd.DataFrame({"portfolio": [int(g["portfolio"].iloc[0])], "actual": [float(own)], "null_mean": [float(null.mean())], "rank": [float((own < null).mean() * 100)]})

    return members.groupBy("portfolio").applyInPandas(apply, "portfolio bigint, actual double, null_mean double, rank double")
