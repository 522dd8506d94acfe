import pandas as pd
from pyspark.sql import functions as F

from liftline.functions import calendar
from liftline.functions import expressions as E
from liftline.operators import simulate
from liftline.sources import fixtures


def test_periods(spark):
    rows = {(r.asset, r.window_i): r for r in calendar.oos_periods(spark).collect()}
    assert len(rows) == 27 + 21 + 30 + 7 + 5 * 15
    start = pd.Timestamp("2019-12-31") + pd.Timedelta(minutes=30 * 10_000)
    first = rows["btc", 1]
    assert pd.Timestamp(first.start) == start and pd.Timestamp(first.end) == start + pd.Timedelta(minutes=30 * 5_000)
    assert pd.Timestamp(rows["eurusd", 2].start) == pd.Timestamp("2017-07-03") + pd.Timedelta(hours=15_000)
    middle = start + pd.Timedelta(minutes=30 * 2_500)
    assert (first.year, first.quarter) == (middle.year, middle.quarter)


def test_rollup_drops_unknown_windows(spark):
    t = spark.createDataFrame([("btc", 1, 5, 2, 3, 1), ("btc", 2, 5, 1, 1, 1), ("btc", 99, 9, 9, 9, 9)], "asset string, window_i int, n int, hits int, n_pass int, pass_hits int")
    assert calendar.by_quarter(t, calendar.oos_periods(spark)).agg(F.sum("n")).first()[0] == 10


def test_small_functions(spark):
    df = spark.createDataFrame([("sweep_phi_0.04", 999.0), ("null", float("inf")), ("edge", 1.5)], "tier string, pf double")
    rows = df.select(E.phi_of_tier(F.col("tier")).alias("p"), E.is_valid_pf(F.col("pf")).alias("v")).collect()
    assert [(r.p, r.v) for r in rows] == [(0.04, False), (None, False), (None, True)]


def test_fixtures_repeat_keys_and_rerun_alike(spark):
    for make in (fixtures.mc_perwindow, fixtures.window_pairs, fixtures.block_perm, fixtures.portfolio_mc):
        assert make(spark).exceptAll(make(spark).repartition(3)).count() == 0
    pairs = fixtures.window_pairs(spark, rows=2000)
    assert pairs.groupBy("strategy", "window_i").count().where("count > 1").count() > 0
    assert pairs.where("next_baseline_oos_pf IS NULL").count() > 0 and pairs.where("next_baseline_oos_pf = double('inf')").count() > 0
    assert fixtures.mc_perwindow(spark).where("roi_pct_rank NOT BETWEEN 0 AND 100").count() == 0


def test_sweep_paths_and_portfolio_null(spark):
    rows = simulate.signal_sweep(spark, (0.0, 0.3), 2, 180, [(2, 4), (3, 6)], 60, 30, 10)
    assert {r.tier for r in rows.select("tier").distinct().collect()} == {"sweep_phi_0.0", "sweep_phi_0.3"}
    bars = spark.createDataFrame([(s, w, p) for s in range(40) for w in range(3) for p in ("edge", "null")], "strategy int, window_i int, path string")
    picked = simulate.pick_path(bars, simulate.edge_tag(F.col("strategy"), F.col("window_i"), 0.5))
    assert picked.count() == 120 and picked.groupBy("strategy", "window_i").count().where("count <> 1").count() == 0
    m = spark.createDataFrame([(p, k, [((i * 7 + k * 3 + p) % 11) - 5 for i in range(30)]) for p in range(2) for k in range(4)], "portfolio bigint, member int, pnls array<bigint>")
    out = simulate.portfolio_null(m, 20).collect()
    assert len(out) == 2 and all(0 <= r["rank"] <= 100 for r in out)
