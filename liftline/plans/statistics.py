"""Summaries, correlations and per-window tables of the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftline.functions.expressions import ratio, safe_corr
from liftline.functions.student import r_p_value, t_critical, t_p_value
from liftline.operators.selection import percentiles
from liftline.plans.given import PANEL_SQL, panel
from liftline.scratch import settle
from liftline.session import ship

QUERIES: dict = {}
ORACLES: dict = {}
PLACES = 6
_RANKS = ("roi_rank", "sharpe_rank", "pf_rank")


def _r(c, name: str):  # noqa: ANN001, ANN202
    return F.round(c, PLACES).alias(name)


def _register(name: str, sql: str | None):  # noqa: ANN202
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = PANEL_SQL + sql
        return f

    return add


_SUMMARY_SQL = " UNION ALL ".join(f"SELECT asset, '{m}' AS metric, {m} AS x FROM panel WHERE oos_hit IS NOT NULL" for m in _RANKS)


@_register("rank_summary", f"SELECT asset, metric, count(*) AS n, round(avg(x), {PLACES}) AS mean, round(avg((x < 50)::INT::DOUBLE) * 100, {PLACES}) AS below_50_pct, round(median(x), {PLACES}) AS median, round(stddev_samp(x), {PLACES}) AS sd FROM ({_SUMMARY_SQL}) GROUP BY asset, metric")
def rank_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = settle(panel(spark, sf_dir).where("oos_hit IS NOT NULL").unpivot(["asset"], list(_RANKS), "metric", "x"))
    moments = long.groupBy("asset", "metric").agg(F.count(F.lit(1)).alias("n"), _r(F.avg("x"), "mean"), _r(F.avg((F.col("x") < 50).cast("double")) * 100, "below_50_pct"), _r(F.stddev_samp("x"), "sd"))
    middle = percentiles(long, ["asset", "metric"], "x", {"median": 0.5})
    return moments.join(middle, ["asset", "metric"]).select("asset", "metric", "n", "mean", "below_50_pct", _r(F.col("median"), "median"), "sd")


def rank_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of the ranks against 50, from rows before any join; the parts of the t-test that SQL has."""
    long = panel(spark, sf_dir).unpivot(["asset"], list(_RANKS), "metric", "x")
    out = long.groupBy("asset", "metric").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    return out.withColumn("t", F.try_divide(F.col("mean") - 50.0, F.col("sd") / F.sqrt("n")))


_LONG_ALL = " UNION ALL ".join(f"SELECT asset, '{m}' AS metric, {m} AS x FROM panel" for m in _RANKS)


@_register("rank_ttest_moments", f"SELECT asset, metric, count(x) AS n, round(avg(x), {PLACES}) AS mean, round(stddev_samp(x), {PLACES}) AS sd, round((avg(x) - 50) / nullif(stddev_samp(x) / sqrt(count(x)), 0), {PLACES}) AS t FROM ({_LONG_ALL}) GROUP BY asset, metric")
def rank_ttest_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_moments(spark, sf_dir).select("asset", "metric", "n", *(_r(F.col(c), c) for c in ("mean", "sd", "t")))


#: Nodes of the Simpson rule that the SQL twins integrate Student's density by, with t = sqrt(df) tan(angle).
_NODES = 2000
_NORM = "exp(lgamma((df + 1) / 2) - lgamma(df / 2))"


def _p_sql(source: str, keys: str) -> str:
    """keys, p (two-sided) of the source's keys, t, df."""
    angle = "atan(abs(t) / sqrt(df))"
    weight = f"CASE WHEN k = 0 OR k = {_NODES} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    return f"SELECT {keys}, 1 - 2 * max({_NORM}) / sqrt(pi()) * max({angle}) / {3 * _NODES} * sum({weight} * pow(cos({angle} * k / {_NODES}), df - 1)) AS p FROM {source}, (SELECT unnest(range({_NODES + 1}))::DOUBLE AS k) GROUP BY {keys}"


#: The 0.975 quantile of the normal distribution, and Student's expanded about it in powers of 1 / df.
_Z = 1.959963984540054
_EXPANDED = " + ".join([f"{_Z!r}::DOUBLE", *(f"({g!r}::DOUBLE) / pow(df, {k})" for k, g in enumerate(((_Z**3 + _Z) / 4, (5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96, (3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384, (79 * _Z**9 + 776 * _Z**7 + 1482 * _Z**5 - 1920 * _Z**3 - 945 * _Z) / 92160), 1))])
_DENSITY = f"({_NORM} / sqrt(pi() * df) * pow(1 + t * t / df, -(df + 1) / 2))"


@_register("rank_ttest", f""", m AS (SELECT asset, metric, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS sd, (avg(x) - 50) / nullif(stddev_samp(x) / sqrt(count(x)), 0) AS t, count(x)::DOUBLE - 1 AS df FROM ({_LONG_ALL}) GROUP BY asset, metric),
near AS (SELECT asset, metric, df, {_EXPANDED} AS t FROM m WHERE df > 0), pn AS ({_p_sql("near", "asset, metric")}), c AS (SELECT asset, metric, t + (p - 0.05::DOUBLE) / (2 * {_DENSITY}) AS t975 FROM near JOIN pn USING (asset, metric)), pt AS ({_p_sql("(SELECT * FROM m WHERE df > 0 AND t IS NOT NULL)", "asset, metric")})
SELECT asset, metric, n, round(mean, {PLACES}) AS mean, round(sd, {PLACES}) AS sd, round(t, {PLACES}) AS t, round(p, {PLACES}) AS p, round(mean - t975 * sd / sqrt(n), {PLACES}) AS low, round(mean + t975 * sd / sqrt(n), {PLACES}) AS high FROM m LEFT JOIN c USING (asset, metric) LEFT JOIN pt USING (asset, metric)""")
def rank_ttest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With p-value and 95 % interval; Python sees one row per group."""
    ship(spark)
    m = rank_moments(spark, sf_dir)
    half = t_critical((F.col("n") - 1).cast("double")) * F.col("sd") / F.sqrt("n")
    m = m.select("*", t_p_value("t", (F.col("n") - 1).cast("double")).alias("p"), half.alias("half"))
    return m.select("asset", "metric", "n", *(_r(F.col(c), c) for c in ("mean", "sd", "t", "p")), _r(F.col("mean") - F.col("half"), "low"), _r(F.col("mean") + F.col("half"), "high"))


_CORR_SQL = " UNION ALL ".join(f"SELECT asset, '{m}' AS metric, {m} AS x, oos_roi AS y FROM panel WHERE oos_roi IS NOT NULL" for m in _RANKS)


def rank_corr(spark: SparkSession, sf_dir: str, least: int = 100) -> DataFrame:
    long = panel(spark, sf_dir).where("oos_roi IS NOT NULL").unpivot(["asset", "oos_roi"], list(_RANKS), "metric", "x")
    return long.groupBy("asset", "metric").agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col("x"), F.col("oos_roi")).alias("r")).where(F.col("n") >= least)


@_register("rank_outcome_corr", f"SELECT asset, metric, count(*) AS n, round(corr(x, y), {PLACES}) AS r, round(corr(x, y) * corr(x, y) * 100, {PLACES}) AS r2_pct FROM ({_CORR_SQL}) GROUP BY asset, metric HAVING count(*) >= 100")
def rank_outcome_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_corr(spark, sf_dir).select("asset", "metric", "n", _r(F.col("r"), "r"), _r(F.col("r") * F.col("r") * 100, "r2_pct"))


@_register("rank_outcome_corr_p", f""", r AS (SELECT asset, metric, count(*) AS n, corr(x, y) AS r FROM ({_CORR_SQL}) GROUP BY asset, metric HAVING count(*) >= 100),
pt AS ({_p_sql("(SELECT asset, metric, r * sqrt((n - 2) / (1 - r * r)) AS t, n::DOUBLE - 2 AS df FROM r WHERE abs(r) < 1)", "asset, metric")}) SELECT asset, metric, n, round(r, {PLACES}) AS r, round(CASE WHEN abs(r) >= 1 THEN 0.0::DOUBLE ELSE p END, {PLACES}) AS p FROM r LEFT JOIN pt USING (asset, metric)""")
def rank_outcome_corr_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return rank_corr(spark, sf_dir).withColumn("p", r_p_value("r", "n")).select("asset", "metric", "n", _r(F.col("r"), "r"), _r(F.col("p"), "p"))


_IS_OOS = {"ROI": ("roi", "oos_roi", "true"), "Sharpe": ("sharpe", "oos_sharpe", "true"), "PF": ("pf", "oos_pf", "true"), "PF, gate": ("pf", "oos_pf", "pf > 1.0"), "PF, fee": ("pf", "oos_pf", "pf > 1.0 AND fee_pf > 1.0"), "PF, MC ROI >= 50": ("pf", "oos_pf", "roi_rank >= 50"), "PF, MC PF >= 50": ("pf", "oos_pf", "pf_rank >= 50"), "PF, gate + MC": ("pf", "oos_pf", "pf > 1.0 AND roi_rank >= 50")}


@_register("is_oos_corr", " UNION ALL ".join(f"SELECT asset, '{n}' AS filter, count(*) AS n, round(corr({x}, {y}), {PLACES}) AS r FROM panel WHERE oos_pf IS NOT NULL AND {p} GROUP BY asset HAVING count(*) >= 10" for n, (x, y, p) in _IS_OOS.items()))
def is_oos_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-sample against out-of-sample, all filters in one pass."""
    sums = []
    for i, (x, y, p) in enumerate(_IS_OOS.values()):
        sums += [F.count_if(F.expr(p)).alias(f"n{i}"), safe_corr(F.when(F.expr(p), F.col(x)), F.when(F.expr(p), F.col(y))).alias(f"r{i}")]
    one = panel(spark, sf_dir).where("oos_pf IS NOT NULL").groupBy("asset").agg(*sums)
    rows = F.array(*(F.struct(F.lit(n).alias("filter"), F.col(f"n{i}").alias("n"), F.round(f"r{i}", PLACES).alias("r")) for i, n in enumerate(_IS_OOS)))
    return one.select("asset", F.inline(rows)).where("n >= 10")


_MEDIANS = {"none": "true", "gate": "pf > 1.0", "rob_all": "pf > 1.0 AND ent_pf > 1.0 AND fee_pf > 1.0 AND sli_pf > 1.0 AND entind_pf > 1.0", "mc_roi": "roi_rank >= 50", "mc_sharpe": "sharpe_rank >= 50", "mc_roi_gate": "pf > 1.0 AND roi_rank >= 50"}


def _medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset, and the median out-of-sample Sharpe of the rows that pass each filter."""
    names = F.array_compact(F.array(*(F.when(F.expr(p), F.lit(n)) for n, p in _MEDIANS.items())))
    rows = panel(spark, sf_dir).where("oos_sharpe IS NOT NULL").select("asset", F.explode(names).alias("filter"), "oos_sharpe")
    found = percentiles(rows, ["asset", "filter"], "oos_sharpe", {"x": 0.5})
    return found.groupBy("asset").pivot("filter", list(_MEDIANS)).agg(F.max("x"))


@_register("median_sharpe_matrix", "SELECT asset, " + ", ".join(f"round(median(oos_sharpe) FILTER (WHERE {p}), {PLACES}) AS {n}" for n, p in _MEDIANS.items()) + " FROM panel WHERE oos_sharpe IS NOT NULL GROUP BY asset")
def median_sharpe_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _medians(spark, sf_dir).select("asset", *(_r(F.col(n), n) for n in _MEDIANS))


@_register("sharpe_delta", "SELECT filter, round(avg(m - b), 6) AS avg_delta FROM (" + " UNION ALL ".join(f"SELECT asset, '{n}' AS filter, median(oos_sharpe) FILTER (WHERE {p}) AS m, median(oos_sharpe) FILTER (WHERE {'pf > 1.0' if n == 'mc_roi_gate' else 'true'}) AS b FROM panel WHERE oos_sharpe IS NOT NULL GROUP BY asset" for n, p in _MEDIANS.items() if n != "none") + ") GROUP BY filter")
def sharpe_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over assets of the median's change: against all rows, the last against the gate."""
    m = settle(_medians(spark, sf_dir))
    rows = F.array(*(F.struct(F.lit(n).alias("filter"), (F.col(n) - F.col("gate" if n == "mc_roi_gate" else "none")).alias("d")) for n in _MEDIANS if n != "none"))
    return m.select(F.inline(rows)).groupBy("filter").agg(_r(F.avg("d"), "avg_delta"))


_UNIT = {"baseline": "true", "rob_fee": "fee_pf > 1.0", "rob_all4": _MEDIANS["rob_all"]}


@_register("unit_rank_stats", " UNION ALL ".join(f"SELECT asset, '{n}' AS filter, count(*) AS n, round(avg(roi_rank), {PLACES}) AS mean, round(stddev_pop(roi_rank), {PLACES}) AS sd, round(stddev_samp(roi_rank), {PLACES}) AS sd_samp, round(avg((roi_rank > 50)::INT::DOUBLE) * 100, {PLACES}) AS above_50_pct, round(median(roi_rank), {PLACES}) AS median, round(avg((pf > 1)::INT::DOUBLE) FILTER (WHERE pf < 100), {PLACES}) AS valid_profit_share FROM panel WHERE {p} GROUP BY asset" for n, p in _UNIT.items()))
def unit_rank_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of the units that each filter lets through; the share above 50 is strict; capped profit factors do not count as valid."""
    rows = panel(spark, sf_dir).withColumn("filter", F.explode(F.filter(F.array(*(F.when(F.coalesce(F.expr(p), F.lit(False)), F.lit(n)) for n, p in _UNIT.items())), lambda x: x.isNotNull())))
    return rows.groupBy("asset", "filter").agg(F.count(F.lit(1)).alias("n"), _r(F.avg("roi_rank"), "mean"), _r(F.stddev_pop("roi_rank"), "sd"), _r(F.stddev_samp("roi_rank"), "sd_samp"), _r(F.avg((F.col("roi_rank") > 50).cast("double")) * 100, "above_50_pct"), _r(F.median("roi_rank"), "median"), _r(F.avg(F.when(F.col("pf") < 100, (F.col("pf") > 1).cast("double"))), "valid_profit_share"))


@_register("strategy_vs_unit", f", u AS (SELECT asset, avg(roi_rank) AS unit_mean FROM panel WHERE {_UNIT['rob_all4']} GROUP BY asset) SELECT p.asset, count(*) AS n, round(avg(roi_rank), {PLACES}) AS strategy_mean, round(max(unit_mean), {PLACES}) AS unit_mean, coalesce(round(max(unit_mean), 1)::VARCHAR, 'N/A') AS unit_shown FROM panel p LEFT JOIN u ON u.asset = p.asset GROUP BY p.asset")
def strategy_vs_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir)
    unit = rows.where(_UNIT["rob_all4"]).groupBy("asset").agg(_r(F.avg("roi_rank"), "unit_mean"), F.round(F.avg("roi_rank"), 1).cast("string").alias("unit_shown"))
    out = rows.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), _r(F.avg("roi_rank"), "strategy_mean")).join(unit, "asset", "left")
    return out.withColumn("unit_shown", F.coalesce("unit_shown", F.lit("N/A")))


_RATES_SQL = "SELECT asset, window_i, count(*) AS n, avg((pf > 1)::INT::DOUBLE) AS gate_rate, avg(roi_rank) AS rank_mean, stddev_samp(roi_rank) AS rank_sd, avg(next_hit) AS next_rate, avg(oos_roi) AS oos_mean FROM panel GROUP BY asset, window_i"


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).groupBy("asset", "window_i").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("pf") > 1).cast("double")).alias("gate_rate"), F.avg("roi_rank").alias("rank_mean"), F.stddev_samp("roi_rank").alias("rank_sd"), F.avg("next_hit").alias("next_rate"), F.avg("oos_roi").alias("oos_mean"))


@_register("window_rates", f"SELECT asset, window_i, n, round(gate_rate, {PLACES}) AS gate_rate, round(rank_mean, {PLACES}) AS rank_mean, round(next_rate, {PLACES}) AS next_rate FROM ({_RATES_SQL})")
def window_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(spark, sf_dir).select("asset", "window_i", "n", *(_r(F.col(c), c) for c in ("gate_rate", "rank_mean", "next_rate")))


@_register("window_rank_band", f"SELECT asset, window_i, round(rank_mean, {PLACES}) AS mean, round(greatest(0.0::DOUBLE, rank_mean - rank_sd), {PLACES}) AS low, round(least(100.0::DOUBLE, rank_mean + rank_sd), {PLACES}) AS high FROM ({_RATES_SQL}) WHERE n > 1")
def window_rank_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, s = F.col("rank_mean"), F.col("rank_sd")
    return _rates(spark, sf_dir).where("n > 1").select("asset", "window_i", _r(m, "mean"), _r(F.greatest(F.lit(0.0), m - s), "low"), _r(F.least(F.lit(100.0), m + s), "high"))


@_register("binned_rate", "SELECT ceil(roi_rank / 5)::INTEGER AS bin, count(*) AS n, round(avg(next_hit), 6) AS rate FROM panel WHERE next_hit IS NOT NULL AND roi_rank > 0 GROUP BY 1")
def binned_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty right-closed bins over (0, 100]; a rank of exactly 0 is in none."""
    rows = panel(spark, sf_dir).where("next_hit IS NOT NULL AND roi_rank > 0")
    return rows.groupBy(F.ceil(F.col("roi_rank") / 5).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), _r(F.avg("next_hit"), "rate"))


@_register("ols_line", f"SELECT asset, count(*) AS n, round(regr_slope(oos_mean, gate_rate), {PLACES}) AS slope, round(regr_intercept(oos_mean, gate_rate), {PLACES}) AS intercept, round(corr(oos_mean, gate_rate), {PLACES}) AS r FROM ({_RATES_SQL}) WHERE oos_mean IS NOT NULL GROUP BY asset HAVING count(*) >= 3")
def ols_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rates(spark, sf_dir).where("oos_mean IS NOT NULL")
    out = rows.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), _r(F.regr_slope("oos_mean", "gate_rate"), "slope"), _r(F.regr_intercept("oos_mean", "gate_rate"), "intercept"), _r(safe_corr(F.col("oos_mean"), F.col("gate_rate")), "r"))
    return out.where("n >= 3")


@_register("rank_histogram", ", r AS (SELECT asset, roi_rank AS x FROM panel), e AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS n FROM r) SELECT least(floor((x - lo) / ((hi - lo) / 50)), 49)::INTEGER AS bin, count(*) AS n, round(count(*) / (max(e.n) * max((hi - lo) / 50)), 9) AS density FROM r, e GROUP BY 1")
def rank_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty bins over the range of the ranks, the last closed, normalised to a density."""
    rows = panel(spark, sf_dir).select(F.col("roi_rank").alias("x"))
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("all"))
    width = (F.col("hi") - F.col("lo")) / 50
    binned = rows.join(F.broadcast(ends)).select(F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(49)).cast("int").alias("bin"), "all", width.alias("width"))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.max("all").alias("all"), F.max("width").alias("width")).select("bin", "n", F.round(F.col("n") / (F.col("all") * F.col("width")), 9).alias("density"))


#: Factors of the sample deviation.
_BANDWIDTHS = (0.1, 0.15, 0.3)


@_register("rank_kde", f", r AS (SELECT roi_rank AS x FROM panel), s AS (SELECT stddev_samp(x) AS sd, count(*) AS n FROM r), g AS (SELECT unnest(range(0, 101, 5)) AS point), b AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in _BANDWIDTHS)}]) AS bandwidth) SELECT bandwidth, point, round(sum(exp(-0.5 * ((point - x) / (sd * bandwidth)) * ((point - x) / (sd * bandwidth)))) / (max(n) * max(sd * bandwidth) * sqrt(2 * pi())), 9) AS density FROM g, r, s, b GROUP BY bandwidth, point")
def rank_kde(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Gaussian kernel estimate on a grid, with three bandwidths. A row adds to each point where it is read; only sums are shuffled."""
    rows = panel(spark, sf_dir).select(F.col("roi_rank").alias("x"))
    scale = rows.agg(F.stddev_samp("x").alias("sd"), F.count("x").alias("n"))  # one row
    met = rows.crossJoin(F.broadcast(scale)).withColumn("bandwidth", F.explode(F.array(*map(F.lit, _BANDWIDTHS)))).withColumn("point", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(100).cast("bigint"), F.lit(5).cast("bigint"))))
    width = F.col("sd") * F.col("bandwidth")
    z = (F.col("point") - F.col("x")) / width
    out = met.groupBy("bandwidth", "point").agg(F.sum(F.exp(-0.5 * z * z)).alias("total"), F.max("n").alias("n"), F.max(width).alias("width"))
    return out.select("bandwidth", "point", F.round(F.try_divide("total", F.col("n") * F.col("width") * F.sqrt(F.lit(2.0) * F.pi())), 9).alias("density"))


@_register("tier_quantiles", "SELECT asset, round(avg(roi), 6) AS mean, round(quantile_cont(roi, 0.025), 6) AS low, round(quantile_cont(roi, 0.975), 6) AS high FROM panel GROUP BY asset")
def tier_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settle(panel(spark, sf_dir).select("asset", "roi"))
    ends = percentiles(rows, ["asset"], "roi", {"low": 0.025, "high": 0.975})
    return rows.groupBy("asset").agg(_r(F.avg("roi"), "mean")).join(ends, "asset").select("asset", "mean", _r(F.col("low"), "low"), _r(F.col("high"), "high"))


@_register("next_outcome_consistency", "SELECT p.asset, count(*) AS n, sum((p.next_roi = q.oos_roi)::INT)::BIGINT AS equal FROM panel p JOIN panel q ON q.strategy = p.strategy AND q.window_i = p.window_i + 1 WHERE p.next_roi IS NOT NULL GROUP BY p.asset")
def next_outcome_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next outcome of a window is the outcome of the next window."""
    rows = panel(spark, sf_dir)
    later = rows.select("strategy", (F.col("window_i") - 1).alias("window_i"), F.col("oos_roi").alias("later"))
    met = rows.where("next_roi IS NOT NULL").join(later, ["strategy", "window_i"])
    return met.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("next_roi") == F.col("later")).cast("bigint")).alias("equal"))


__all__ = ["ORACLES", "QUERIES", "ratio"]
