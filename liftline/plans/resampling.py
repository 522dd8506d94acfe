"""Monte Carlo ranks, bootstraps, placebos and samples over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftline.functions.calendar import by_quarter
from liftline.functions.rng import draw_sql
from liftline.operators import resample, scan
from liftline.plans.given import PANEL_SQL, TRADE_ORDER, TRADES_SQL, panel, strategies, trades
from liftline.scratch import settle
from liftline.session import ship

QUERIES: dict = {}
ORACLES: dict = {}
REPS, BLOCKS, BOOT = 1000, (1, 2, 3, 5, 10, 20), 10_000
_KEYS = ["strategy", "window_i"]


def _register(name: str, sql: str | None):  # noqa: ANN202
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return resample.sequences(trades(spark, sf_dir), _KEYS, TRADE_ORDER)


_NUMBERED = f"WITH trades AS ({TRADES_SQL}), seq AS (SELECT strategy, window_i, pnl, row_number() OVER (PARTITION BY strategy, window_i ORDER BY {', '.join(TRADE_ORDER)}) AS i, count(*) OVER (PARTITION BY strategy, window_i) AS n FROM trades), fit AS (SELECT * FROM seq WHERE n >= 10)"
_S = "CASE WHEN {s2}::DOUBLE / n::DOUBLE - ({s1}::DOUBLE / n::DOUBLE) * ({s1}::DOUBLE / n::DOUBLE) > 1e-24 THEN {s1}::DOUBLE / n::DOUBLE / sqrt({s2}::DOUBLE / n::DOUBLE - ({s1}::DOUBLE / n::DOUBLE) * ({s1}::DOUBLE / n::DOUBLE)) ELSE 0.0::DOUBLE END"
_P = "CASE WHEN lost = 0 THEN CASE WHEN won = 0 THEN 1.0::DOUBLE ELSE 100.0::DOUBLE END ELSE least(won::DOUBLE / lost::DOUBLE, 100.0::DOUBLE) END"
_STATS = "sum(pnl)::BIGINT AS s1, sum(pnl * pnl)::BIGINT AS s2, sum(greatest(pnl, 0))::BIGINT AS won, sum(greatest(-pnl, 0))::BIGINT AS lost"


@_register(
    "mc_bootstrap_rank",
    f"""{_NUMBERED}, actual AS (SELECT strategy, window_i, n, {_STATS} FROM fit GROUP BY ALL),
draws AS (SELECT strategy, window_i, n, b, 1 + {draw_sql('strategy::BIGINT', 'window_i::BIGINT', 'b::BIGINT', 'i::BIGINT')} % n AS i FROM fit, (SELECT unnest(range({REPS})) AS b)),
reps AS (SELECT d.strategy, d.window_i, d.n, d.b, {_STATS} FROM draws d JOIN fit f ON f.strategy = d.strategy AND f.window_i = d.window_i AND f.i = d.i GROUP BY ALL),
r AS (SELECT strategy, window_i, b, s1, {_S.format(s1='s1', s2='s2')} AS sh, {_P} AS pf FROM reps), a AS (SELECT strategy, window_i, s1, {_S.format(s1='s1', s2='s2')} AS sh, {_P} AS pf FROM actual)
SELECT a.strategy, a.window_i, avg((r.s1 < a.s1)::INT::DOUBLE) * 100 AS roi_rank, avg((r.sh < a.sh)::INT::DOUBLE) * 100 AS sharpe_rank, avg((r.pf < a.pf)::INT::DOUBLE) * 100 AS pf_rank
FROM r JOIN a USING (strategy, window_i) GROUP BY a.strategy, a.window_i""",
)
def mc_bootstrap_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return resample.bootstrap_ranks_of(trades(spark, sf_dir), _KEYS, TRADE_ORDER, reps=REPS)


_PART = "{'t': s.t + x.t, 'hi': greatest(s.hi, s.t + x.hi), 'lo': least(s.lo, s.t + x.lo), 'f': greatest(s.f, x.f, s.hi - (s.t + x.lo))}"


def _fall_sql(parts: str) -> str:
    """The drawdown of a list of blocks, one after the other."""
    return f"list_reduce({parts}, lambda s, x: {_PART}).f"


def _block_sql(block: int) -> str:
    """strategy, window_i, rank: the blocks of a group are made lists of their sums, highest and lowest running sums and falls, and lists are permuted."""
    key = draw_sql("strategy", "window_i", "(b * 101 + size)", "j")
    return f"""z{block} AS (SELECT strategy::BIGINT AS strategy, window_i::BIGINT AS window_i, n::BIGINT AS n, i, pnl, CASE WHEN n >= {2 * block} THEN {block} ELSE 1 END::BIGINT AS size, (i - 1) // CASE WHEN n >= {2 * block} THEN {block} ELSE 1 END AS j FROM fit),
e{block} AS (SELECT *, max(e) OVER (PARTITION BY strategy, window_i, j ORDER BY i) AS pk FROM (SELECT *, sum(pnl) OVER (PARTITION BY strategy, window_i, j ORDER BY i)::BIGINT AS e FROM z{block})),
p{block} AS (SELECT strategy, window_i, size, n // size AS whole, list({{'t': t, 'hi': hi, 'lo': lo, 'f': f}} ORDER BY j) AS parts FROM (SELECT strategy, window_i, n, size, j, sum(pnl)::BIGINT AS t, max(e) AS hi, min(e) AS lo, max(pk - e) AS f FROM e{block} GROUP BY ALL) GROUP BY ALL),
r{block} AS (SELECT strategy, window_i, avg((mdd > own)::INT::DOUBLE) * 100 AS block{block}_rank FROM (
    SELECT strategy, window_i, {_fall_sql("parts")} AS own, {_fall_sql("list_transform(keys, lambda k: parts[k % 1048576 + 1]) || parts[whole + 1 :]")} AS mdd
    FROM (SELECT *, list_sort(list_transform(range(whole), lambda j: {key} * 1048576 + j)) AS keys FROM p{block}, (SELECT unnest(range({REPS}))::BIGINT AS b))) GROUP BY ALL)"""


@_register(
    "mc_block_rank",
    f"""{_NUMBERED}, {", ".join(_block_sql(b) for b in BLOCKS)}
SELECT strategy, window_i::INTEGER AS window_i, {", ".join(f"block{b}_rank" for b in BLOCKS)} FROM r{BLOCKS[0]} {" ".join(f"JOIN r{b} USING (strategy, window_i)" for b in BLOCKS[1:])}""",
)
def mc_block_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.block_ranks(_sequences(spark, sf_dir), _KEYS, BLOCKS, REPS)


#: As many as the SQL twin can permute in seconds.
PATHS = 500
_PATH = f"""sum(pnl)::BIGINT AS total, max(greatest(peak, 0) - eq)::BIGINT AS mdd FROM (SELECT *, max(eq) OVER (PARTITION BY strategy, window_i, b ORDER BY pos) AS peak FROM (SELECT *, sum(pnl) OVER (PARTITION BY strategy, window_i, b ORDER BY pos) AS eq FROM"""
_CALMAR = "CASE WHEN {0}.mdd > 0 THEN {0}.total::DOUBLE / {0}.mdd::DOUBLE ELSE 999.0::DOUBLE END"


def _path_sql(kind: str) -> str:
    return f"""{kind} AS (SELECT strategy, window_i, b, {_PATH} {kind}_rows)) GROUP BY ALL),
{kind}_r AS (SELECT strategy, window_i, avg(({kind}.total < own.total)::INT::DOUBLE) * 100 AS {kind}_roi_rank, avg((own.mdd < {kind}.mdd)::INT::DOUBLE) * 100 AS {kind}_mdd_rank, avg(({_CALMAR.format(kind)} < {_CALMAR.format("own")})::INT::DOUBLE) * 100 AS {kind}_calmar_rank FROM {kind} JOIN own USING (strategy, window_i) GROUP BY ALL)"""


@_register("mc_path_rank", f"""{_NUMBERED}, own AS (SELECT strategy, window_i, {_PATH} (SELECT *, 0 AS b, i AS pos FROM seq))) GROUP BY ALL),
drawn AS (SELECT *, {draw_sql("strategy::BIGINT", "window_i::BIGINT", "b::BIGINT", "i::BIGINT")} AS draw FROM seq, (SELECT unnest(range({PATHS})) AS b) WHERE n >= 3),
perm_rows AS (SELECT strategy, window_i, b, pnl, row_number() OVER (PARTITION BY strategy, window_i, b ORDER BY draw, i) AS pos FROM drawn),
boot_rows AS (SELECT d.strategy, d.window_i, d.b, s.pnl, d.i AS pos FROM drawn d JOIN seq s ON s.strategy = d.strategy AND s.window_i = d.window_i AND s.i = 1 + d.draw % d.n),
{_path_sql("perm")}, {_path_sql("boot")}
SELECT strategy, window_i, {", ".join(f"coalesce({k}_{m}_rank, 50.0::DOUBLE) AS {k}_{m}_rank" for k in ("perm", "boot") for m in ("roi", "mdd", "calmar"))} FROM own LEFT JOIN perm_r USING (strategy, window_i) LEFT JOIN boot_r USING (strategy, window_i)""")
def mc_path_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROI, drawdown and Calmar ranks against permutations and samples with replacement."""
    return resample.path_ranks(_sequences(spark, sf_dir), _KEYS, PATHS)


@_register("mc_path_rank_full", None)
def mc_path_rank_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With 1000 of each."""
    return resample.path_ranks(_sequences(spark, sf_dir), _KEYS, 1000)


@_register("drawdown", f"{_NUMBERED} SELECT strategy, window_i, max(peak - eq)::BIGINT AS mdd_cents, max(greatest(peak, 0) - eq)::BIGINT AS mdd_from_origin_cents FROM (SELECT *, max(eq) OVER (PARTITION BY strategy, window_i ORDER BY i) AS peak FROM (SELECT *, sum(pnl) OVER (PARTITION BY strategy, window_i ORDER BY i) AS eq FROM seq)) GROUP BY strategy, window_i")
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximum drawdown of each sequence, with both starts of the peak."""
    ship(spark)
    found = scan.drawdowns(trades(spark, sf_dir), _KEYS, list(TRADE_ORDER), "pnl")
    return found.select(*_KEYS, F.col("mdd").alias("mdd_cents"), F.col("mdd_from_origin").alias("mdd_from_origin_cents"))


def _tally(spark: SparkSession, sf_dir: str, clusters: list[str]) -> DataFrame:
    return resample.tallies(panel(spark, sf_dir), clusters, F.col("roi_rank") >= 50)


def _tally_sql(clusters: str) -> str:
    return f"SELECT {clusters}, count(*) AS n, sum(next_hit)::BIGINT AS hits, count(*) FILTER (WHERE roi_rank >= 50) AS n_pass, coalesce(sum(next_hit) FILTER (WHERE roi_rank >= 50), 0)::BIGINT AS pass_hits FROM panel WHERE next_hit IS NOT NULL GROUP BY {clusters}"


@_register("cluster_tallies", f"{PANEL_SQL} {_tally_sql('asset, window_i')}")
def cluster_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tally(spark, sf_dir, ["asset", "window_i"])


_LIFT = "(sum(pass_hits)::DOUBLE / nullif(sum(n_pass), 0)::DOUBLE - sum(hits)::DOUBLE / nullif(sum(n), 0)::DOUBLE) * 100"


def _boot_sql(tally: str, order: str, by: str = "") -> str:
    keys, part, group = (f"{by}, ", f"PARTITION BY {by} ", f"GROUP BY {by}") if by else ("", "", "")
    on = f"AND t.{by} = d.{by}" if by else ""
    d_by = f"d.{by}, " if by else ""
    return f"""{PANEL_SQL}, tally AS ({tally}), t AS (SELECT *, row_number() OVER ({part}ORDER BY {order}) AS k FROM tally),
sizes AS (SELECT {keys}count(*) AS clusters, {_LIFT} AS point FROM tally {group}),
d AS (SELECT {keys}rep, {draw_sql('0::BIGINT', '0::BIGINT', 'rep::BIGINT', 'i::BIGINT')} % clusters + 1 AS k FROM (SELECT *, unnest(range(1, clusters + 1)) AS i FROM sizes), (SELECT unnest(range({BOOT})) AS rep)),
x AS (SELECT {d_by}d.rep, {_LIFT} AS x FROM d JOIN t ON t.k = d.k {on} GROUP BY ALL)
SELECT {'x.' + by + ', ' if by else ''}max(clusters) AS clusters, round(max(point), 6) AS point, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS se_pop, round(stddev_samp(x), 6) AS se_samp, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high, round(max(point) / stddev_pop(x), 6) AS z, round(avg((x >= 0)::INT::DOUBLE), 6) AS share_positive
FROM x {f'JOIN sizes USING ({by})' if by else ', sizes'} {'GROUP BY x.' + by if by else ''}"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@_register("cluster_bootstrap_ci", _boot_sql(_tally_sql("asset, window_i"), "asset, window_i"))
def cluster_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(resample.cluster_bootstrap(_tally(spark, sf_dir, ["asset", "window_i"]), ["asset", "window_i"], reps=BOOT))


@_register("cluster_bootstrap_by_asset", _boot_sql(_tally_sql("asset, window_i"), "window_i", "asset"))
def cluster_bootstrap_by_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(resample.cluster_bootstrap(_tally(spark, sf_dir, ["asset", "window_i"]), ["window_i"], ["asset"], BOOT))


_METHODS = [f"block{b}_rank" for b in BLOCKS]


@_register("block_rank_sweep", f"""{PANEL_SQL}, ranks AS MATERIALIZED ({ORACLES["mc_block_rank"]}), long AS ({" UNION ALL ".join(f"SELECT asset, strategy, next_hit, '{m}' AS method, {m} AS rank FROM panel JOIN ranks USING (strategy, window_i) WHERE next_hit IS NOT NULL" for m in _METHODS)})
SELECT asset, method, count(*) AS n, count(DISTINCT strategy) AS strategies, round(avg(rank), 6) AS mean_rank, round(CASE WHEN stddev_samp(rank) > 0 THEN (avg(rank) - 50) / (stddev_samp(rank) / sqrt(count(*))) END, 6) AS t50,
       round(avg((rank >= 50)::INT::DOUBLE), 6) AS pass_share, round(avg(next_hit) FILTER (WHERE rank >= 50), 6) AS pass_hit, round(avg(next_hit) FILTER (WHERE NOT rank >= 50), 6) AS fail_hit, round(avg(next_hit), 6) AS base_hit,
       round(avg(next_hit) FILTER (WHERE rank >= 50) - avg(next_hit), 6) AS lift, round(CASE WHEN stddev_pop(rank) > 1e-9 AND stddev_pop(next_hit) > 1e-9 THEN covar_pop(rank, next_hit) / (stddev_pop(rank) * stddev_pop(next_hit)) END, 6) AS corr
FROM long GROUP BY asset, method""")
def block_rank_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block-permutation ranks of six block sizes: mean rank and its t against 50, pass rate, outcomes, lift and correlation with the outcome, by asset."""
    rows = panel(spark, sf_dir).where("next_hit IS NOT NULL").select("asset", *_KEYS, "next_hit").join(mc_block_rank(spark, sf_dir), _KEYS)
    long = rows.unpivot(["asset", "strategy", "next_hit"], _METHODS, "method", "rank")
    passed, hit = F.col("rank") >= 50, F.col("next_hit")
    out = long.groupBy("asset", "method").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("strategy").alias("strategies"), F.avg("rank").alias("mean_rank"), F.stddev_samp("rank").alias("sd"), F.avg(passed.cast("double")).alias("pass_share"), F.avg(F.when(passed, hit)).alias("pass_hit"),
        F.avg(F.when(~passed, hit)).alias("fail_hit"), F.avg(hit).alias("base_hit"), F.covar_pop("rank", "next_hit").alias("covariance"), F.stddev_pop("rank").alias("sd_rank"), F.stddev_pop("next_hit").alias("sd_hit"),
    )
    t50 = F.when(F.col("sd") > 0, (F.col("mean_rank") - 50) / (F.when(F.col("sd") > 0, F.col("sd")) / F.sqrt("n")))
    corr = F.when((F.col("sd_rank") > 1e-9) & (F.col("sd_hit") > 1e-9), F.try_divide(F.col("covariance"), F.col("sd_rank") * F.col("sd_hit")))
    return _rounded(out.select("asset", "method", "n", "strategies", "mean_rank", t50.alias("t50"), "pass_share", "pass_hit", "fail_hit", "base_hit", (F.col("pass_hit") - F.col("base_hit")).alias("lift"), corr.alias("corr")))


_RANKS = ("roi_rank", "sharpe_rank", "pf_rank")


@_register("cluster_bootstrap_methods", _boot_sql(" UNION ALL ".join(f"SELECT '{m}' AS method, * FROM ({_tally_sql('asset, window_i').replace('roi_rank', m)})" for m in _RANKS), "asset, window_i", "method"))
def cluster_bootstrap_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One resampling of the clusters, and the lift of every rank column over it."""
    rows = panel(spark, sf_dir)
    counts = [resample.tallies(rows, ["asset", "window_i"], F.col(m) >= 50).select(F.lit(m).alias("method"), "*") for m in _RANKS]
    return _rounded(resample.cluster_bootstrap(counts[0].unionByName(counts[1]).unionByName(counts[2]), ["asset", "window_i"], ["method"], BOOT))


_BLOCK_TALLIES = " UNION ALL ".join(f"SELECT '{m}' AS method, * FROM ({_tally_sql('asset, window_i').replace('FROM panel', 'FROM panel JOIN ranks USING (strategy, window_i)').replace('roi_rank', m)})" for m in _METHODS)


@_register("cluster_bootstrap_blocks", _boot_sql(_BLOCK_TALLIES, "asset, window_i", "method").replace(", tally AS (", f", ranks AS MATERIALIZED ({ORACLES['mc_block_rank']}), tally AS (", 1))
def cluster_bootstrap_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One resampling of the clusters, and the lift of the permutation ranks of all six block sizes over it."""
    rows = settle(panel(spark, sf_dir).join(mc_block_rank(spark, sf_dir), _KEYS))
    counts = [resample.tallies(rows, ["asset", "window_i"], F.col(m) >= 50).select(F.lit(m).alias("method"), "*") for m in _METHODS]
    return _rounded(resample.cluster_bootstrap(reduce(DataFrame.unionByName, counts), ["asset", "window_i"], ["method"], BOOT))


_QUARTER = "(year(m) * 4 + quarter(m) - 1)::INTEGER"
_QUARTERS_SQL = f"""SELECT period, sum(n) AS n, sum(hits) AS hits, sum(n_pass) AS n_pass, sum(pass_hits) AS pass_hits FROM ({_tally_sql('asset, window_i')}) JOIN (
    SELECT asset, (w - 2)::INTEGER AS window_i, {_QUARTER} AS period FROM (SELECT asset, year(l_shipdate) - 1994 AS w, (min(l_shipdate)::DATE + ((max(l_shipdate)::DATE - min(l_shipdate)::DATE) // 2)::INTEGER)::DATE AS m FROM trades JOIN strategies USING (strategy) GROUP BY ALL)
) USING (asset, window_i) GROUP BY period"""


@_register("calendar_bootstrap_ci", _boot_sql(_QUARTERS_SQL, "period"))
def calendar_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window tallies rolled up over assets to the quarters of their outcome periods' midpoints, then resampled. A window's outcome is judged two windows on; the period is that window's first to last trade of the asset."""
    days = trades(spark, sf_dir).join(strategies(spark, sf_dir), "strategy").groupBy("asset", (F.col("window_i") - 2).alias("window_i")).agg(F.min(F.to_date("l_shipdate")).alias("start"), F.max(F.to_date("l_shipdate")).alias("end"))
    middle = F.date_add("start", F.floor(F.datediff("end", "start") / 2).cast("int"))
    periods = days.select("asset", "window_i", F.year(middle).alias("year"), F.quarter(middle).alias("quarter"))
    rolled = by_quarter(_tally(spark, sf_dir, ["asset", "window_i"]), periods).withColumn("period", F.col("year") * 4 + F.col("quarter") - 1)
    return _rounded(resample.cluster_bootstrap(rolled.drop("year", "quarter"), ["period"], reps=BOOT))


_W_LIFT = f"SELECT asset, window_i, (pass_hits::DOUBLE / n_pass::DOUBLE - hits::DOUBLE / n::DOUBLE) * 100 AS x FROM ({_tally_sql('asset, window_i')}) WHERE n >= 10 AND n_pass > 5"


@_register("lift_bootstrap_ci", f"""{PANEL_SQL}, l AS ({_W_LIFT}), a AS (SELECT asset, asset AS own, window_i, x FROM l UNION ALL SELECT 'All', asset, window_i, x FROM l),
w AS (SELECT asset, x, row_number() OVER (PARTITION BY asset ORDER BY window_i, own) AS k, count(*) OVER (PARTITION BY asset) AS n FROM a),
d AS (SELECT asset, rep, {draw_sql('0::BIGINT', '0::BIGINT', 'rep::BIGINT', 'k::BIGINT', 7)} % n + 1 AS k FROM w, (SELECT unnest(range({BOOT})) AS rep)),
m AS (SELECT d.asset, rep, avg(x) AS x FROM d JOIN w ON w.asset = d.asset AND w.k = d.k GROUP BY ALL)
SELECT asset, round(quantile_cont(x, 0.025), 6) AS low, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.975), 6) AS high FROM m GROUP BY asset""")
def lift_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap of the mean of the windows' lifts, by asset and pooled. Windows need 10 rows and more than 5 passing ones."""
    share = lambda h, n: F.col(h).cast("double") / F.col(n)
    lifts = _tally(spark, sf_dir, ["asset", "window_i"]).where("n >= 10 AND n_pass > 5").select("asset", F.col("asset").alias("own"), "window_i", ((share("pass_hits", "n_pass") - share("hits", "n")) * 100).alias("x"))
    return _mean_bootstrap(lifts.unionByName(lifts.withColumn("asset", F.lit("All"))), ["window_i", "own"])


def _mean_bootstrap(values: DataFrame, order: list[str]) -> DataFrame:
    """asset, low, mean, high of the means of resampled values; values are one for each window."""
    from pyspark.sql import Window

    from liftline.functions.rng import draw

    w = values.withColumns({"k": F.row_number().over(Window.partitionBy("asset").orderBy(*order)), "n": F.count(F.lit(1)).over(Window.partitionBy("asset"))})
    drawn = w.select("asset", "k", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(BOOT - 1).cast("bigint"))).alias("rep"))
    drawn = drawn.select("asset", "rep", (draw(F.lit(0), F.lit(0), F.col("rep"), F.col("k"), 7) % F.col("n") + 1).cast("int").alias("k"))
    means = drawn.join(w.select("asset", "k", "x"), ["asset", "k"]).groupBy("asset", "rep").agg(F.avg("x").alias("x"))
    return means.groupBy("asset").agg(F.round(F.percentile("x", 0.025), 6).alias("low"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.percentile("x", 0.975), 6).alias("high"))


@_register("mean_bootstrap_ci", f"""{PANEL_SQL}, w AS (SELECT asset, window_i, avg(next_roi) AS x, row_number() OVER (PARTITION BY asset ORDER BY window_i) AS k, count(*) OVER (PARTITION BY asset) AS n FROM panel WHERE next_roi IS NOT NULL GROUP BY asset, window_i),
d AS (SELECT asset, rep, {draw_sql('0::BIGINT', '0::BIGINT', 'rep::BIGINT', 'k::BIGINT', 7)} % n + 1 AS k FROM w, (SELECT unnest(range({BOOT})) AS rep)),
m AS (SELECT d.asset, rep, avg(x) AS x FROM d JOIN w ON w.asset = d.asset AND w.k = d.k GROUP BY ALL)
SELECT asset, round(quantile_cont(x, 0.025), 6) AS low, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.975), 6) AS high FROM m GROUP BY asset""")
def mean_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap of the mean over windows."""
    return _mean_bootstrap(panel(spark, sf_dir).where("next_roi IS NOT NULL").groupBy("asset", "window_i").agg(F.avg("next_roi").alias("x")), ["window_i"])


_LOG_STEP = "CASE WHEN row_number() OVER (PARTITION BY unit ORDER BY x) > 1 THEN ln((k - x + 1) * (m - x + 1) / (x * (n - k - m + x))) ELSE 0 END"


@_register("placebo_ci", f"""{PANEL_SQL}, pool AS (SELECT asset, next_hit, roi_rank >= 50 AS chosen FROM panel WHERE next_hit IS NOT NULL AND pf > 1.0),
c AS (SELECT asset, count(*) AS n_pool, count(*) FILTER (WHERE next_hit > 0) AS n_hits, count(*) FILTER (WHERE chosen) AS n_chosen, count(*) FILTER (WHERE chosen AND next_hit > 0) AS chosen_hits FROM pool GROUP BY asset HAVING count(*) FILTER (WHERE chosen) > 0),
u AS (SELECT *, row_number() OVER (ORDER BY asset) AS unit, n_pool::DOUBLE AS n, n_hits::DOUBLE AS k, n_chosen::DOUBLE AS m FROM c),
v AS (SELECT unit, n, k, m, unnest(range(greatest(0, n_chosen + n_hits - n_pool), least(n_chosen, n_hits) + 1))::DOUBLE AS x FROM u),
l AS (SELECT unit, x, sum(step) OVER (PARTITION BY unit ORDER BY x) AS log FROM (SELECT unit, x, {_LOG_STEP} AS step FROM v)),
w AS (SELECT unit, x, exp(log - max(log) OVER (PARTITION BY unit)) AS w FROM l),
d AS (SELECT unit, x, sum(w) OVER (PARTITION BY unit ORDER BY x) / sum(w) OVER (PARTITION BY unit) AS share FROM w),
r AS (SELECT unit, rep, {draw_sql('unit::BIGINT', '0::BIGINT', 'rep::BIGINT', '3::BIGINT')} / 2147483647.0::DOUBLE AS spot FROM u, (SELECT unnest(range(1000)) AS rep)),
h AS (SELECT r.unit, rep, coalesce(min(x) FILTER (WHERE share >= spot), max(x)) AS hits FROM r JOIN d ON d.unit = r.unit GROUP BY r.unit, rep)
SELECT asset, n_pool, n_chosen, round(chosen_hits * 100.0::DOUBLE / n_chosen, 6) AS rate, round(quantile_cont(hits * 100 / m, 0.025), 6) AS low, round(quantile_cont(hits * 100 / m, 0.975), 6) AS high, chosen_hits * 100.0::DOUBLE / n_chosen < quantile_cont(hits * 100 / m, 0.025) AS below
FROM h JOIN u USING (unit) GROUP BY asset, n_pool, n_chosen, chosen_hits""")
def placebo_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir).where("next_hit IS NOT NULL")
    return _rounded(resample.placebo(rows, ["asset"], F.col("pf") > 1.0, F.col("roi_rank") >= 50, "next_hit"))


@_register("stratified_sample", f"{PANEL_SQL} SELECT family, strategy FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY {draw_sql('strategy::BIGINT', '0::BIGINT', '0::BIGINT', '0::BIGINT', 123)}, strategy) AS r FROM strategies) WHERE r <= 40")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.sample_per_group(strategies(spark, sf_dir).select("family", "strategy"), ["family"], 40, "strategy", 123)


@_register("window_portfolios", f"""{PANEL_SQL}, best AS (SELECT *, row_number() OVER (PARTITION BY window_i ORDER BY pf DESC, strategy) AS r FROM panel WHERE oos_roi IS NOT NULL),
top AS (SELECT * FROM best WHERE r <= 30 AND window_i IN (SELECT window_i FROM best WHERE r = 30)),
drawn AS (SELECT *, row_number() OVER (PARTITION BY window_i, portfolio ORDER BY {draw_sql('r::BIGINT', '0::BIGINT', 'portfolio::BIGINT', '1::BIGINT')}, r) AS k FROM top, (SELECT unnest(range(50))::INTEGER AS portfolio))
SELECT window_i, portfolio, count(*) AS n, round(avg(oos_roi), 6) AS mean_value FROM drawn WHERE k <= 10 GROUP BY window_i, portfolio""")
def window_portfolios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random picks of ten of each window's thirty best by in-sample profit factor."""
    rows = panel(spark, sf_dir).where("oos_roi IS NOT NULL")
    return _rounded(resample.portfolios(rows, ["window_i"], "pf", "strategy", F.col("oos_roi")))


@_register("random_portfolios", f"""{PANEL_SQL}, best AS (SELECT *, row_number() OVER (PARTITION BY window_i ORDER BY pf DESC, strategy) AS r, count(*) OVER (PARTITION BY window_i) AS n_all FROM panel WHERE oos_roi IS NOT NULL),
drawn AS (SELECT *, row_number() OVER (PARTITION BY window_i, portfolio ORDER BY {draw_sql('r::BIGINT', '0::BIGINT', 'portfolio::BIGINT', '1::BIGINT')}, r) AS k FROM best, (SELECT unnest(range(500))::INTEGER AS portfolio) WHERE r <= 17 AND n_all >= 24)
SELECT window_i, portfolio, count(*) AS n, round(avg(oos_roi), 6) AS mean_value FROM drawn WHERE k <= 10 GROUP BY window_i, portfolio""")
def random_portfolios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 random picks of ten of each window's best seventeen; windows with fewer than 24 strategies have none."""
    rows = panel(spark, sf_dir).where("oos_roi IS NOT NULL")
    return _rounded(resample.portfolios(rows, ["window_i"], "pf", "strategy", F.col("oos_roi"), 17, 10, 500, least=24))
