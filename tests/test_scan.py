"""Scans by pieces against loops over whole series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from liftline.operators import scan


def _closes(n, seed=1):
    return 100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.02, n)))


def _frame(spark, series):
    return spark.createDataFrame(pd.concat([pd.DataFrame({"series": s, "t": np.arange(len(x), dtype=np.int32), "close": x}) for s, x in series.items()]), "series string, t int, close double")


def _loop(x, fast=12, slow=26, signal=9, n=14):
    """All indicators bar by bar."""
    rows, f, s, g, up, down = [], x[0], x[0], 0.0, 0.0, 0.0
    for t, c in enumerate(x):
        d = c - x[t - 1] if t else 0.0
        f, s = f + 2 / (fast + 1) * (c - f), s + 2 / (slow + 1) * (c - s)
        g += 2 / (signal + 1) * (f - s - g)
        if t <= n:
            up, down = up + max(d, 0) / n, down + max(-d, 0) / n
        else:
            up, down = (up * (n - 1) + max(d, 0)) / n, (down * (n - 1) + max(-d, 0)) / n
        ratio = 100.0 if down <= 1e-10 else up / down
        rows.append((t, f, s, f - s, g, 100 - 100 / (1 + ratio) if t > n else 50.0))
    return np.array(rows)


_NAMES = ["t", "ema_fast", "ema_slow", "macd", "macd_signal", "rsi"]


@pytest.mark.parametrize("piece", [1, 7, 15, 1 << 16])
def test_indicators_of_any_piece(spark, piece):
    series = {"a": _closes(120), "b": _closes(49, 2), "c": np.full(40, 5.0), "d": _closes(1, 3), "e": _closes(14, 4), "": _closes(30, 5)}
    out = scan.indicators(_frame(spark, series).repartition(5), piece=piece).toPandas()
    assert len(out) == sum(map(len, series.values()))
    for s, x in series.items():
        own = out[out.series == s].sort_values("t")
        assert np.allclose(own[_NAMES], _loop(x), atol=1e-8) and np.array_equal(own.close, x)
    assert scan.indicators(_frame(spark, series).limit(0)).count() == 0


def test_one_series_of_a_million_bars_is_many_tasks(spark):
    n = 1_000_000
    rows = spark.range(n).select(F.lit("a").alias("series"), F.col("id").cast("int").alias("t"), (F.sin(F.col("id") / 50) * 10 + F.pmod(F.hash("id"), F.lit(1000)) / 100 + 100).alias("close"))
    x = rows.orderBy("t").toPandas().close.to_numpy()
    out = scan.indicators(rows)
    assert scan.with_piece(rows).groupBy("piece").count().agg(F.max("count")).first()[0] <= scan.PIECE
    at = [0, 14, 15, 65_535, 65_536, 65_537, 500_000, n - 1]
    got = out.where(F.col("t").isin(at)).orderBy("t").toPandas()
    whole = pd.Series(x)
    for name, span in (("ema_fast", 12), ("ema_slow", 26)):
        assert np.allclose(got[name], whole.ewm(alpha=2 / (span + 1), adjust=False).mean()[at], atol=1e-8)
    assert np.allclose(got[_NAMES][:3], _loop(x[:16])[[0, 14, 15]], atol=1e-8)
    d = np.diff(x)
    up, down = (pd.Series(np.r_[np.maximum(s * d, 0)[:14].mean(), np.maximum(s * d, 0)[14:]]).ewm(alpha=1 / 14, adjust=False).mean().to_numpy() for s in (1, -1))
    assert got.rsi.iloc[-1] == pytest.approx(100 - 100 / (1 + up[-1] / down[-1]))


@pytest.mark.parametrize("piece", [1, 4, 1 << 16])
def test_last_events_and_lags_cross_pieces(spark, piece):
    x = np.random.default_rng(4).normal(0, 1, 300)
    x[100:140] = 0.0
    rows = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(x)] + [("b", t, None if t % 3 else float(v)) for t, v in enumerate(x[:50])], "series string, t int, close double")
    out = scan.lagged(scan.hysteresis(rows.repartition(3), ["series"], "close", -1.0, 1.0, piece=piece), ["series"], "close", "came", piece=piece).toPandas()
    for s, own in out.groupby("series"):
        own = own.sort_values("t")
        state, want = 0, []
        for v in own.close:
            state = 1 if v < -1 else 0 if v > 1 else state
            want.append(state)
        assert own.position.tolist() == want
        assert own.came.fillna(9).tolist() == [9.0, *own.close.fillna(9)[:-1]], s


def test_numbers_have_their_places(spark):
    values = np.unique(np.random.default_rng(1).integers(-500, 500, 300)).tolist()
    rows = spark.createDataFrame([(v,) for v in values], "hour bigint").repartition(4)
    assert [(r.hour, r.t) for r in scan.numbered(rows, "hour", bucket=7).orderBy("hour").collect()] == [(v, k) for k, v in enumerate(values)]


def test_drawdowns_of_groups_over_many_ranges(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", None, int(t), int(v)) for t, v in enumerate(rng.integers(-100, 100, 20_000))]
    rows += [(f"g{k}", k % 3, int(t), int(v)) for k in range(40) for t, v in enumerate(rng.integers(-100, 100, k))]
    rows += [("up", 1, t, 1) for t in range(50)] + [("down", 1, t, -1) for t in range(50)] + [("one", 1, 0, -7)]
    df = spark.createDataFrame(rows, "k string, w int, t int, v int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    found = {(r.k, r.w): (r.mdd, r.mdd_from_origin) for r in scan.drawdowns(df.repartition(6), ["k", "w"], ["t"], "v").collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for (k, w), own in pd.DataFrame(rows, columns=["k", "w", "t", "v"]).groupby(["k", "w"], dropna=False):
        run = own.sort_values("t").v.cumsum().to_numpy()
        peak = np.maximum.accumulate(run)
        assert found[k, None if w != w else w] == ((peak - run).max(), (np.maximum(peak, 0) - run).max())
    assert len(found) == len({r[:2] for r in rows})
