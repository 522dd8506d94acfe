"""The given tables read as a walk-forward evaluation, in DataFrames and in SQL.

Supplier = strategy, ship year = window, line item = trade with a result in whole cents, region = asset, nation =
family. In-sample is a window, out-of-sample the next, next out-of-sample the one after. Ranks are a strategy's
percentile among the strategies of its asset and window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftline.operators.panel import SHOCKS, trade_metrics, with_outcomes, with_ranks

ASSET_CLASS = {"AFRICA": "Forex", "AMERICA": "Crypto", "ASIA": "Crypto", "EUROPE": "Crypto", "MIDDLE EAST": "Commodity"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pnl_cents() -> Column:
    return F.floor(F.col("l_extendedprice") * (F.col("l_discount") - 0.05) * 100.0 + 0.5).cast("bigint")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """strategy, window_i, pnl, with the columns that put trades in order."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_suppkey").alias("strategy"), (F.year("l_shipdate") - 1994).alias("window_i"), pnl_cents().alias("pnl"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_quantity", "l_tax")


#: A total order of trades; rows that still tie are equal.
TRADE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_quantity", "l_tax")


def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """strategy, asset, family: suppliers with their region and nation."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.col("n_name").alias("family"), F.col("r_name").alias("asset"))
    return table(spark, sf_dir, "supplier").join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("strategy"), "asset", "family")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items are first summed by strategy and window, so only those sums meet the dimension."""
    metrics = with_outcomes(trade_metrics(trades(spark, sf_dir), ["strategy", "window_i"], shocks=SHOCKS), ["strategy"])
    named = metrics.join(strategies(spark, sf_dir), "strategy")
    ranked = with_ranks(named, ["asset", "window_i"])
    return ranked.withColumns({"next_hit": F.when(F.col("next_pf").isNotNull(), (F.col("next_pf") > 1).cast("double")), "oos_hit": F.when(F.col("oos_pf").isNotNull(), (F.col("oos_pf") > 1).cast("double"))})


def _pf_sql(shock: int) -> str:
    p = f"(pnl - {shock})"
    won, lost = f"sum(greatest({p}, 0))::BIGINT", f"sum(greatest(-{p}, 0))::BIGINT"
    return f"CASE WHEN {lost} = 0 THEN CASE WHEN {won} = 0 THEN 1.0::DOUBLE ELSE 100.0::DOUBLE END ELSE least({won}::DOUBLE / {lost}::DOUBLE, 100.0::DOUBLE) END"


TRADES_SQL = "SELECT l_suppkey AS strategy, (year(l_shipdate) - 1994)::INTEGER AS window_i, floor(l_extendedprice * (l_discount - 0.05::DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS pnl, lineitem.* FROM lineitem"
_LEADS = ", ".join(f"lead({c}, {k}) OVER o AS {p}_{c}" for k, p in ((1, "oos"), (2, "next")) for c in ("n_trades", "roi", "pf", "sharpe"))

#: Common table expressions trades, metrics, strategies and panel; put a SELECT after it.
PANEL_SQL = f"""
WITH trades AS ({TRADES_SQL}),
sums AS (
    SELECT strategy, window_i, count(*) AS n_trades, sum(pnl)::BIGINT AS total, sum(pnl * pnl)::BIGINT AS squares, {_pf_sql(0)} AS pf,
           {", ".join(f"{_pf_sql(c)} AS {s}_pf" for s, c in SHOCKS.items())}
    FROM trades GROUP BY strategy, window_i
), metrics AS (
    SELECT *, total::DOUBLE / 1000.0::DOUBLE AS roi,
           CASE WHEN squares::DOUBLE / n_trades::DOUBLE - (total::DOUBLE / n_trades::DOUBLE) * (total::DOUBLE / n_trades::DOUBLE) > 1e-24
                THEN total::DOUBLE / n_trades::DOUBLE / sqrt(squares::DOUBLE / n_trades::DOUBLE - (total::DOUBLE / n_trades::DOUBLE) * (total::DOUBLE / n_trades::DOUBLE))
                ELSE 0.0::DOUBLE END AS sharpe
    FROM sums
), outcomes AS (
    SELECT *, {_LEADS} FROM metrics WINDOW o AS (PARTITION BY strategy ORDER BY window_i)
), strategies AS (
    SELECT s_suppkey AS strategy, r_name AS asset, n_name AS family FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), panel AS (
    SELECT outcomes.*, asset, family,
           {", ".join(f"percent_rank() OVER (PARTITION BY asset, window_i ORDER BY {m}) * 100.0::DOUBLE AS {m}_rank" for m in ("roi", "sharpe", "pf"))},
           CASE WHEN next_pf IS NOT NULL THEN (next_pf > 1)::INT::DOUBLE END AS next_hit, CASE WHEN oos_pf IS NOT NULL THEN (oos_pf > 1)::INT::DOUBLE END AS oos_hit
    FROM outcomes JOIN strategies USING (strategy)
)
"""


def lift_sql(filters: dict[str, str], outcome: str, by: tuple[str, ...], against: dict[str, str] | None = None, source: str = "panel", min_pass: int = 0, complement: str = "not", min_rows: int = 0) -> str:
    """One SELECT for each filter, put together: plain text against which the one-pass plan is held."""
    keys = "".join(f"{b}, " for b in by)
    group = (f" GROUP BY {', '.join(by)}" if by else "") + (f" HAVING count(*) >= {min_rows}" if min_rows else "")
    parts = []
    for i, (name, p) in enumerate(filters.items()):
        ok = f"coalesce({p}, false)"
        no = f"NOT ({p})" if complement == "below" else f"NOT {ok}"
        rate = lambda c: f"100.0::DOUBLE * sum({outcome}) FILTER (WHERE {c}) / nullif(count(*) FILTER (WHERE {c}), 0)::DOUBLE"
        base = rate(f"coalesce({filters[against[name]]}, false)") if name in (against or {}) else f"100.0::DOUBLE * sum({outcome}) / nullif(count(*), 0)::DOUBLE"
        quoted = name.replace("'", "''")
        parts.append(f"SELECT {keys}{i}::INTEGER AS ord, '{quoted}' AS filter, count(*) FILTER (WHERE {ok}) AS n_pass, count(*) FILTER (WHERE {no}) AS n_fail, {rate(ok)} AS pass_pct, {rate(no)} AS fail_pct, {base} AS base_pct, {rate(ok)} - {base} AS lift_pp FROM {source} WHERE {outcome} IS NOT NULL{group}")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ")" + (f" WHERE n_pass >= {min_pass}" if min_pass else "")
