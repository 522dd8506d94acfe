"""Series queries: events as hourly closes of five instruments, line items as positions held over days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liftline.operators import scan, sequence
from liftline.plans.given import pnl_cents, table
from liftline.session import ship

QUERIES: dict = {}
ORACLES: dict = {}
WIDTH, STEP = 120, 24


def _register(name: str, sql: str | None):  # noqa: ANN202
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", (F.col("value") + 100.0).alias("close"))
    return sequence.hourly_last(bars, "event_type", "ts", "close", "event_id")


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.common_hours(_hourly(spark, sf_dir))


_HOURLY = "hourly AS (SELECT event_type AS series, floor(epoch(ts) / 3600)::BIGINT AS hour, arg_max(value + 100.0::DOUBLE, (ts, event_id)) AS close FROM events GROUP BY 1, 2)"
_SERIES = f"WITH RECURSIVE {_HOURLY}, shared AS (SELECT hour FROM hourly GROUP BY hour HAVING count(DISTINCT series) = (SELECT count(DISTINCT series) FROM hourly)), s AS (SELECT series, hour, close, (row_number() OVER (PARTITION BY series ORDER BY hour) - 1)::INTEGER AS t FROM hourly WHERE hour IN (SELECT hour FROM shared)), r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY series ORDER BY t)) AS ret FROM s)"


def _by_series():  # noqa: ANN202
    return Window.partitionBy("series").orderBy("t")


@_register("hourly_last", f"WITH {_HOURLY} SELECT series, hour, close FROM hourly")
def hourly_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hourly(spark, sf_dir)


@_register("common_hours", f"{_SERIES} SELECT series, hour, close, t FROM s")
def common_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir).select("series", "hour", "close", "t")


def _sma_sql(p: int) -> str:
    o = f"OVER (PARTITION BY series ORDER BY t ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(close) {o} = {p} THEN avg(close) {o} END"


_SIGNAL = f"sig AS (SELECT *, CASE WHEN t < 25 OR slow IS NULL THEN 0 WHEN fast > slow THEN 1 ELSE -1 END AS position FROM (SELECT *, {_sma_sql(5)} AS fast, {_sma_sql(20)} AS slow FROM r))"


def _signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scan.log_returns(_series(spark, sf_dir))
    r = r.withColumns({"fast": sequence.sma("close", 5, _by_series()), "slow": sequence.sma("close", 20, _by_series())})
    return r.withColumn("position", sequence.crossover(F.col("fast"), F.col("slow"), F.col("t"), 25, short=True))


@_register("sma_cross_signal", f"{_SERIES}, {_SIGNAL} SELECT series, t, round(fast, 6) AS fast, round(slow, 6) AS slow, position FROM sig")
def sma_cross_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signal(spark, sf_dir).select("series", "t", F.round("fast", 6).alias("fast"), F.round("slow", 6).alias("slow"), "position")


@_register("hysteresis", f"{_SERIES} SELECT series, t, coalesce(last_value(CASE WHEN ret < -0.2 THEN 1 WHEN ret > 0.2 THEN 0 END IGNORE NULLS) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS position FROM r")
def hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scan.log_returns(_series(spark, sf_dir))
    return scan.hysteresis(r, ["series"], "ret", -0.2, 0.2).select("series", "t", "position")


_RUNS = "runs AS (SELECT *, sum(turn) OVER (PARTITION BY series ORDER BY t) AS run FROM (SELECT *, (position <> coalesce(lag(position) OVER (PARTITION BY series ORDER BY t), 0))::INT AS turn FROM sig))"
_TRADES = "SELECT series, run, position, min(t) AS first_t, max(t) AS last_t, sum(position * coalesce(ret, 0)) - 0.001 AS pnl FROM runs WHERE position <> 0 GROUP BY series, run, position"


@_register("trade_runs", f"{_SERIES}, {_SIGNAL}, {_RUNS} SELECT series, run::BIGINT AS run, position, first_t, last_t, round(pnl, 9) AS pnl FROM ({_TRADES})")
def trade_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = sequence.trade_runs(_signal(spark, sf_dir), ["series"], cost=0.001)
    return runs.withColumn("pnl", F.round("pnl", 9))


@_register("turnover_returns", f"{_SERIES}, {_SIGNAL} SELECT series, round(sum(position * coalesce(nxt, 0) - abs(position - coalesce(prev, 0)) * 0.0005), 9) AS pnl, sum(abs(position))::DOUBLE AS exposure FROM (SELECT *, lead(ret) OVER (PARTITION BY series ORDER BY t) AS nxt, lag(position) OVER (PARTITION BY series ORDER BY t) AS prev FROM sig) GROUP BY series HAVING sum(abs(position)) >= 1e-10")
def turnover_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.turnover_returns(_signal(spark, sf_dir), ["series"], 0.0005).withColumn("pnl", F.round("pnl", 9))


_GRID = ((3, 12), (5, 20), (8, 24), (10, 40))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scan.log_returns(_series(spark, sf_dir))
    r = r.withColumns({f"s{p}": sequence.sma("close", p, _by_series()) for p in sorted({x for pair in _GRID for x in pair})})
    cells = F.array(*(F.struct(F.lit(f).alias("fast"), F.lit(s).alias("slow"), sequence.crossover(F.col(f"s{f}"), F.col(f"s{s}"), F.col("t"), s + 5).alias("position")) for f, s in _GRID))
    return r.select("series", "t", "ret", F.inline(cells))


_GRID_SQL = "grid AS (" + " UNION ALL ".join(f"SELECT series, t, ret, {f} AS fast, {s} AS slow, CASE WHEN t < {s + 5} OR b IS NULL THEN 0 WHEN a > b THEN 1 ELSE 0 END AS position FROM (SELECT *, {_sma_sql(f)} AS a, {_sma_sql(s)} AS b FROM r)" for f, s in _GRID) + ")"


@_register("walk_forward", f"{_SERIES}, {_GRID_SQL}, w AS (SELECT *, (t // 60)::INTEGER AS window_i, t % 60 < 40 AS in_sample FROM grid) SELECT series, fast, slow, window_i, in_sample, count(*) AS n, round(sum(position * coalesce(nxt, 0)), 9) AS pnl FROM (SELECT *, lead(ret) OVER (PARTITION BY series, fast, slow ORDER BY t) AS nxt FROM w) GROUP BY ALL")
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of crossover strategies evaluated in walk-forward windows."""
    window, in_sample = sequence.walk_forward(F.col("t"), 40, 20)
    rows = _grid(spark, sf_dir).withColumn("nxt", F.lead("ret").over(Window.partitionBy("series", "fast", "slow").orderBy("t")))
    rows = rows.withColumns({"window_i": window, "in_sample": in_sample})
    return rows.groupBy("series", "fast", "slow", "window_i", "in_sample").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("position") * F.coalesce("nxt", F.lit(0.0))), 9).alias("pnl"))


@_register("grid_trade_metrics", f"{_SERIES}, {_GRID_SQL}, runs AS (SELECT *, sum(turn) OVER (PARTITION BY series, fast, slow ORDER BY t) AS run FROM (SELECT *, (position <> coalesce(lag(position) OVER (PARTITION BY series, fast, slow ORDER BY t), 0))::INT AS turn FROM grid)), tr AS (SELECT series, fast, slow, run, sum(coalesce(ret, 0)) - 0.001 AS pnl FROM runs WHERE position <> 0 GROUP BY ALL) SELECT series, fast, slow, count(*) AS trades, round(sum(pnl), 9) AS total, round(avg((pnl > 0)::INT::DOUBLE), 9) AS win_share FROM tr GROUP BY ALL")
def grid_trade_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = sequence.trade_runs(_grid(spark, sf_dir), ["series", "fast", "slow"], cost=0.001)
    return runs.groupBy("series", "fast", "slow").agg(F.count(F.lit(1)).alias("trades"), F.round(F.sum("pnl"), 9).alias("total"), F.round(F.avg((F.col("pnl") > 0).cast("double")), 9).alias("win_share"))


_NW = f"(SELECT greatest(0, (max(t) - {WIDTH}) // {STEP} + 1) FROM r)"
_ROLL = f"wn AS (SELECT unnest(range({_NW}))::INTEGER AS w), sp AS (SELECT w, t, series, ret FROM r JOIN wn ON t > w * {STEP} AND t <= w * {STEP} + {WIDTH}), roll AS (SELECT a.w, a.series AS a, b.series AS b, count(*) AS n, coalesce(corr(a.ret, b.ret), 0) AS r FROM sp a JOIN sp b ON a.w = b.w AND a.t = b.t AND a.series < b.series GROUP BY ALL)"


def _rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.rolling_corr(scan.log_returns(_series(spark, sf_dir)), WIDTH, STEP)


@_register("rolling_corr", f"{_SERIES}, {_ROLL} SELECT w, (w * {STEP} + {WIDTH})::INTEGER AS last_t, a, b, n, round(r, 6) AS r FROM roll")
def rolling_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolling(spark, sf_dir).select("w", (F.col("w") * STEP + WIDTH).cast("int").alias("last_t"), "a", "b", "n", F.round("r", 6).alias("r"))


@_register("mean_corr", f"{_SERIES}, {_ROLL} SELECT a, b, count(*) AS windows, round(avg(r), 6) AS r FROM roll GROUP BY a, b")
def mean_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolling(spark, sf_dir).groupBy("a", "b").agg(F.count(F.lit(1)).alias("windows"), F.round(F.avg("r"), 6).alias("r"))


@_register("corr_eigen", None)
def corr_eigen(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return sequence.eigenvalues(_rolling(spark, sf_dir))


@_register("corr_eigen_moments", f"{_SERIES}, {_ROLL} SELECT w, round(count(DISTINCT x), 6)::DOUBLE AS trace, round(count(DISTINCT x) + 2 * max(squares), 6)::DOUBLE AS squares FROM (SELECT w, unnest([a, b]) AS x, sum(r * r) OVER (PARTITION BY w) AS squares FROM roll) GROUP BY w")
def corr_eigen_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the eigenvalues and of their squares, which the matrix itself tells."""
    return corr_eigen(spark, sf_dir).groupBy("w").agg(F.round(F.sum("eigenvalue"), 6).alias("trace"), F.round(F.sum(F.col("eigenvalue") * F.col("eigenvalue")), 6).alias("squares"))


_RUNS_SQL = "runs AS (SELECT *, sum(turn) OVER (PARTITION BY series, fast, slow ORDER BY t) AS run FROM (SELECT *, (position <> coalesce(lag(position) OVER (PARTITION BY series, fast, slow ORDER BY t), 0))::INT AS turn FROM grid)), tr AS (SELECT series, fast, slow, run, sum(coalesce(ret, 0)) - 0.001 AS pnl FROM runs WHERE position <> 0 GROUP BY ALL)"


@_register("grid_run_metrics", f"""{_SERIES}, {_GRID_SQL}, {_RUNS_SQL}, eq AS (SELECT *, sum(pnl) OVER (PARTITION BY series, fast, slow ORDER BY run) AS equity FROM tr), pk AS (SELECT *, greatest(max(equity) OVER (PARTITION BY series, fast, slow ORDER BY run), 0) AS peak FROM eq),
m AS (SELECT series, fast, slow, count(*) AS trades, sum(pnl) AS roi, sum(greatest(pnl, 0)) AS won, sum(greatest(-pnl, 0)) AS lost, max(peak - equity) AS mdd, avg(pnl) AS mean, stddev_pop(pnl) AS sd FROM pk GROUP BY ALL)
SELECT series, fast, slow, trades, round(roi, 6) AS roi, round(CASE WHEN lost > 1e-12 THEN least(won / lost, 100.0::DOUBLE) WHEN won > 0 THEN 100.0::DOUBLE ELSE 1.0::DOUBLE END, 6) AS pf, round(mdd, 6) AS mdd, round(CASE WHEN mdd > 1e-9 THEN roi / mdd END, 6) AS calmar, round(CASE WHEN sd > 1e-9 THEN mean / sd ELSE 0.0::DOUBLE END, 6) AS sharpe FROM m""")
def grid_run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROI, profit factor, drawdown, Calmar and Sharpe of each grid cell's trades."""
    keys = ["series", "fast", "slow"]
    order = Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    runs = sequence.trade_runs(_grid(spark, sf_dir), keys, cost=0.001).withColumn("equity", F.sum("pnl").over(order))
    runs = runs.withColumn("peak", F.greatest(F.max("equity").over(order), F.lit(0.0)))
    m = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("trades"), F.sum("pnl").alias("roi"), F.sum(F.greatest("pnl", F.lit(0.0))).alias("won"), F.sum(F.greatest(-F.col("pnl"), F.lit(0.0))).alias("lost"), F.max(F.col("peak") - F.col("equity")).alias("mdd"), F.avg("pnl").alias("mean"), F.stddev_pop("pnl").alias("sd"))
    pf = F.when(F.col("lost") > 1e-12, F.least(F.try_divide("won", "lost"), F.lit(100.0))).when(F.col("won") > 0, F.lit(100.0)).otherwise(F.lit(1.0))
    calmar = F.when(F.col("mdd") > 1e-9, F.try_divide("roi", "mdd"))
    sharpe = F.when(F.col("sd") > 1e-9, F.try_divide("mean", "sd")).otherwise(F.lit(0.0))
    return m.select(*keys, "trades", *(F.round(c, 6).alias(n) for n, c in (("roi", F.col("roi")), ("pf", pf), ("mdd", F.col("mdd")), ("calmar", calmar), ("sharpe", sharpe))))


def _ema_sql(name: str, source: str, column: str, period: int) -> str:
    a = f"{2 / (period + 1)!r}::DOUBLE"
    return f"{name} AS (SELECT series, t, {column} AS e FROM {source} WHERE t = 0 UNION ALL SELECT x.series, x.t, {a} * x.{column} + (1 - {a}) * y.e FROM {name} y JOIN {source} x ON x.series = y.series AND x.t = y.t + 1)"


@_register("macd", f"{_SERIES}, {_ema_sql('ef', 's', 'close', 12)}, {_ema_sql('es', 's', 'close', 26)}, m AS (SELECT ef.series, ef.t, ef.e AS f, es.e AS sl, ef.e - es.e AS d FROM ef JOIN es USING (series, t)), {_ema_sql('sg', 'm', 'd', 9)} SELECT series, t, round(f, 6) AS ema_fast, round(sl, 6) AS ema_slow, round(d, 6) AS macd, round(sg.e, 6) AS macd_signal FROM m JOIN sg USING (series, t)")
def macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return scan.indicators(_series(spark, sf_dir)).select("series", F.col("t").cast("int").alias("t"), *(F.round(c, 6).alias(c) for c in ("ema_fast", "ema_slow", "macd", "macd_signal")))


@_register("rsi", f"{_SERIES}, d AS (SELECT series, t, greatest(close - lag(close) OVER o, 0) AS g, greatest(lag(close) OVER o - close, 0) AS l FROM s WINDOW o AS (PARTITION BY series ORDER BY t)), wil AS (SELECT series, 14 AS t, avg(g) AS g, avg(l) AS l FROM d WHERE t BETWEEN 1 AND 14 GROUP BY series UNION ALL SELECT d.series, d.t, (y.g * 13 + d.g) / 14, (y.l * 13 + d.l) / 14 FROM wil y JOIN d ON d.series = y.series AND d.t = y.t + 1) SELECT s.series, s.t, round(CASE WHEN s.t <= 14 THEN 50.0::DOUBLE ELSE 100 - 100 / (1 + CASE WHEN l <= 1e-10 THEN 100.0::DOUBLE ELSE g / l END) END, 6) AS rsi FROM s LEFT JOIN wil USING (series, t)")
def rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return scan.indicators(_series(spark, sf_dir)).select("series", F.col("t").cast("int").alias("t"), F.round("rsi", 6).alias("rsi"))


#: Days a position is held.
HELD = 3
_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_quantity", "l_tax")
_BARS = f"bars AS (SELECT strategy, bar, arg_max(dir, ({', '.join(_ORDER)})) AS dir FROM (SELECT *, unnest(range(day, day + {HELD})) AS bar FROM (SELECT l_suppkey AS strategy, floor(epoch(l_shipdate) / 86400)::BIGINT AS day, CASE WHEN floor(l_extendedprice * (l_discount - 0.05::DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE) > 0 THEN 1 ELSE -1 END AS dir, lineitem.* FROM lineitem)) GROUP BY strategy, bar)"


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    day = F.unix_date(F.to_date("l_shipdate")).cast("bigint")
    rows = lines.select(F.col("l_suppkey").alias("strategy"), day.alias("first"), (day + (HELD - 1)).alias("last"), F.when(pnl_cents() > 0, 1).otherwise(-1).alias("dir"), *_ORDER)
    return sequence.expand_intervals(rows, ["strategy"], "first", "last", list(_ORDER), "dir")


@_register("interval_expand", f"WITH {_BARS} SELECT strategy, count(*) AS bars, sum(dir)::BIGINT AS net FROM bars GROUP BY strategy")
def interval_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spark, sf_dir).groupBy("strategy").agg(F.count(F.lit(1)).alias("bars"), F.sum("dir").alias("net"))


@_register("event_window_stats", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd_pop, round(avg((value > 50)::INT::DOUBLE), 6) AS above_50 FROM events GROUP BY 1, 2")
def event_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of a plan that serves streams too."""
    from liftline.streaming.counts import running_stats

    out = running_stats(table(spark, sf_dir, "events"), "ts", "value", ["event_type"])
    return out.select("start", "event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "sd_pop", "above_50")))


@_register("walk_forward_filters", None)
def walk_forward_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole evaluation over the instruments' hourly closes: positions, trades, permutation ranks, outcomes, filters."""
    from liftline.operators import simulate

    ship(spark)
    rows = simulate.evaluate(_series(spark, sf_dir).select("series", "t", "close"), [(2, 4), (2, 6), (3, 8), (4, 10), (5, 12)], 60, 30, reps=50)
    return simulate.filter_table(rows, {"None": "true", "IS PF > 1": "pf > 1.0", "MC MDD >= 50": "mdd_rank >= 50", "MC Calmar >= 50 + gate": "calmar_rank >= 50 AND pf > 1.0"}, ("series",), least=5)
