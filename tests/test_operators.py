import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from liftline.functions import expressions as E
from liftline.functions import rng, student
from liftline.operators import correlation, panel, resample, scan, sequence, simulate
from liftline.operators.lift import FilterSet, lift, ranking


def test_families(spark):
    names = ["RSI_LEVEL_x", "RSI_x", "MACD(24;52)_y", "MACD_12_26_9", "macd_1_2", "xyz", "EMA_cross"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    rows = df.select(E.family_by_prefix(F.col("n")).alias("p"), E.family_with_macd(F.col("n")).alias("m"), E.family_first_token(F.col("n")).alias("t")).collect()
    assert [r.p for r in rows] == ["RSI_LEVEL", "RSI", "MACD", "MACD", "MACD", "OTHER", "EMA"]
    assert [r.m for r in rows][2:5] == ["MACD(24;52)", "MACD(12;26)", "MACD"]
    assert rows[0].t == "RSI"


def test_window_labels(spark):
    rows = spark.createDataFrame([("W03",), ("3",), ("w10",), ("x",), (None,)], "w string").select(E.window_number(F.col("w")).alias("w")).collect()
    assert [r.w for r in rows] == [3, 3, 10, None, None]


def test_degenerate_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "x double, y double")
    row = df.agg(E.safe_corr(F.col("x"), F.col("y")).alias("a"), E.safe_corr(F.col("x"), F.col("y"), 0.0).alias("b")).first()
    assert row.a is None and row.b == 0.0


def test_student():
    assert student.t_tail(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert student.t_tail(1.0, 1) == pytest.approx(0.5, abs=1e-9)
    assert student.t_quantile(0.975, 10) == pytest.approx(2.2281389, abs=1e-6)
    assert student.beta_share(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-9)


def test_generator_agrees_in_python_and_spark(spark):
    reps, at = np.arange(4), np.arange(1, 6)
    wanted = resample._draws(7, 3, reps, at, 42)
    df = spark.range(4).withColumnRenamed("id", "b").crossJoin(spark.range(1, 6).withColumnRenamed("id", "i"))
    got = {(r.b, r.i): (r.c, r.s) for r in df.select("b", "i", rng.draw(F.lit(7), F.lit(3), F.col("b"), F.col("i")).alias("c"), F.expr(rng.draw_sql("7L", "3L", "b", "i")).alias("s")).collect()}
    for b in range(4):
        for i in range(1, 6):
            assert got[b, i] == (wanted[b, i - 1], wanted[b, i - 1])


def test_null_policies(spark):
    df = spark.createDataFrame([(1.0,), (1.5,), (None,), (float("nan"),), (float("inf"),)], "pf double")
    get = lambda p: [r[0] for r in df.select(panel.hit(F.col("pf"), p)).collect()]
    assert get("drop") == [0.0, 1.0, None, None, 1.0]
    assert get("zero") == [0.0, 1.0, 0.0, 0.0, 1.0]
    assert get("finite") == [0.0, 1.0, None, None, None]
    with pytest.raises(ValueError):
        panel.hit(F.col("pf"), "other")


def test_dedupe_of_ranks(spark):
    pairs = spark.createDataFrame([("a", 1), ("b", 1)], "strategy string, window_i int")
    ranks = spark.createDataFrame([("a", 1, 10.0, 1), ("a", 1, 30.0, 2), ("c", 1, 5.0, 3)], "strategy string, window_i int, rank double, ord int")
    keys = ["strategy", "window_i"]
    get = lambda how: sorted(r["rank"] for r in panel.join_ranks(pairs, ranks, keys, how, "ord").collect())
    assert (get("multiply"), get("last"), get("first"), get("mean")) == ([10.0, 30.0], [30.0], [10.0], [20.0])


def test_lift_parts(spark):
    rows = [(i % 2, float(i % 3 == 0), None if i % 7 == 0 else float(i), "x" if i < 20 else "y") for i in range(40)]
    df = spark.createDataFrame(rows, "g int, hit double, r double, a string")
    out = {(r.a, r["filter"]): r for r in lift(df, "hit", FilterSet({"all": "true", "r >= 10": "r >= 10", "odd": "g = 1"}, {"odd": "r >= 10"}), ["a"]).collect()}
    for a in "xy":
        total = out[a, "all"].n_pass
        for f in ("r >= 10", "odd"):
            o = out[a, f]
            assert o.n_pass + o.n_fail == total
            both = (o.n_pass * (o.pass_pct or 0) + o.n_fail * (o.fail_pct or 0)) / total
            assert both == pytest.approx(out[a, "all"].pass_pct)
        assert out[a, "odd"].base_pct == out[a, "r >= 10"].pass_pct
    below = {(r.a, r["filter"]): r for r in lift(df, "hit", FilterSet({"r >= 10": "r >= 10"}), ["a"], complement="below").collect()}
    assert below["x", "r >= 10"].n_fail < out["x", "r >= 10"].n_fail  # missing ranks are in neither
    assert [r["filter"] for r in ranking(lift(df, "hit", FilterSet({"all": "true", "odd": "g = 1"}), ["a"])).collect()]
    with pytest.raises(ValueError):
        FilterSet({"a": "true"}, {"a": "b"})
    assert lift(df.limit(0), "hit", FilterSet({"all": "true"}), ["a"]).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(-1000, 1000), min_size=3, max_size=40), st.integers(1, 12))
def test_permutations_keep_what_they_must(pnls, block):
    p = np.array(pnls, np.int64)
    order = resample.block_order(len(p), block, 5, 2, np.arange(6), 42)
    assert (np.sort(order, axis=1) == np.arange(len(p))).all()
    size = block if len(p) >= 2 * block else 1
    tail = np.arange(len(p) // size * size, len(p))
    assert (order[:, len(p) - len(tail) :] == tail).all()
    assert (p[order].sum(axis=1) == p.sum()).all()
    roi, mdd, calmar = resample.path_kernel(p, 1, 1, 20)
    assert roi == 0.0  # a permuted sum is never strictly below
    assert 0 <= mdd <= 100 and 0 <= calmar <= 100
    assert all(0 <= x <= 100 for x in resample.bootstrap_kernel(p, 1, 1, 20, 42))


@pytest.mark.parametrize("n", [10, 23, 40, 41])
@pytest.mark.parametrize("origin", [False, True])
def test_falls_of_permuted_blocks_are_those_of_the_trades(n, origin):
    p = np.random.default_rng(n).integers(-50, 50, n)
    for block in (1, 2, 5, 20, 30):
        size = block if n >= 2 * block else 1
        order = resample.block_order(n, block, 5, 2, np.arange(40), 42)
        blocks = order[:, ::size] // size  # the rest after the last whole block is a block of its own
        assert (resample.block_falls(resample.block_parts(p, size), blocks, origin) == resample.max_drawdown(p[order], origin)).all()


def test_drawdown_starts():
    assert resample.max_drawdown(np.array([[-5, 3, -4]]))[0] == 4
    assert resample.max_drawdown(np.array([[-5, 3, -4]]), True)[0] == 6
    assert resample.path_kernel(np.array([1, 2]), 1, 1, 5) == (50.0, 50.0, 50.0)


def test_one_cluster_has_no_spread(spark):
    t = spark.createDataFrame([(1, 10, 4, 5, 3)], "c int, n bigint, hits bigint, n_pass bigint, pass_hits bigint")
    row = resample.cluster_bootstrap(t, ["c"], reps=50).first()
    assert row.se_pop == pytest.approx(0) and row.point == pytest.approx(20.0) and row.low == pytest.approx(row.high)


def _series(spark, n=120, seed=1):
    x = 100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.02, n)))
    return spark.createDataFrame(pd.DataFrame({"series": "a", "t": np.arange(n, dtype=np.int32), "close": x})), x


def test_trade_runs_against_a_loop(spark):
    rng_ = np.random.default_rng(3)
    pos, ret = rng_.integers(-1, 2, 60), rng_.normal(0, 0.01, 60)
    df = spark.createDataFrame(pd.DataFrame({"s": "a", "t": np.arange(60), "position": pos.astype(int), "ret": ret}))
    got = [(r.position, r.first_t, r.last_t, round(r.pnl, 9)) for r in sequence.trade_runs(df, ["s"], cost=0.001).orderBy("first_t").collect()]
    want, k = [], 0
    while k < 60:
        j = k
        while j + 1 < 60 and pos[j + 1] == pos[k]:
            j += 1
        if pos[k]:
            want.append((pos[k], k, j, round(float(pos[k] * ret[k : j + 1].sum() - 0.001), 9)))
        k = j + 1
    assert got == want


def test_eigenvalues_sum_to_the_number_of_series(spark):
    parts = [_series(spark, seed=s)[0].withColumn("series", F.lit(f"s{s}")) for s in range(4)]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    pairs = sequence.rolling_corr(scan.log_returns(rows), 40, 20)
    out = sequence.eigenvalues(pairs).toPandas()
    assert out.groupby("w").eigenvalue.sum().round(9).eq(4).all()


def test_simulation(spark):
    paths = simulate.price_paths(spark, 3, 240, seed=4)
    assert paths.groupBy("series").count().collect()[0]["count"] == 240
    again = simulate.price_paths(spark, 3, 240, seed=4)
    assert paths.exceptAll(again).count() == 0
    grid = simulate.strategy_grid(spark, range(2, 6), range(4, 12, 2)).collect()
    assert all(g.slow >= 1.3 * g.fast for g in grid) and [g.strategy for g in grid] == list(range(1, len(grid) + 1))
    rows = simulate.evaluate(paths, [(2, 4), (3, 6), (4, 8)], 60, 30, reps=20).persist()
    assert rows.where("roi_rank NOT BETWEEN 0 AND 100").count() == 0
    table = simulate.filter_table(rows, {"None": "true", "gate": "pf > 1.0"}, ("series",), 2, edge="strategy = 1")
    assert table.where("`filter` = 'None' AND pool_pct <> 100").count() == 0
    assert simulate.average_filters(table).count() <= 2
    tiers = simulate.tier_summary(rows.withColumn("tier", F.lit("null"))).collect()
    assert tiers[0].tier == "null" and -1 <= tiers[0].corr_mc_roi_oos <= 1
    wide = simulate.prevalence_sweep(table.withColumn("prevalence", F.lit(0.1)), {"gate": "gate_lift"})
    assert wide.columns == ["prevalence", "gate_lift"]
    share = spark.range(4000).select(simulate.edge_tag(F.col("id"), F.lit(1), 0.4).cast("double").alias("x")).agg(F.avg("x")).first()[0]
    assert share == pytest.approx(0.28, abs=0.04)
    spread = simulate.factor_portfolios(spark, 2000).agg(F.stddev("value")).first()[0]
    assert spread == pytest.approx(math.sqrt(0.25 + 0.75 / 10), abs=0.05)
