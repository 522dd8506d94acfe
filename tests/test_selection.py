"""Percentiles by digits and placebo counts by inversion, against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from liftline.operators import resample, selection


def test_keys_are_in_the_order_of_the_numbers(spark):
    x = sorted([0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 1e308, -1e308, float("inf"), float("-inf"), 0.1, 0.1 + 2e-17, -3.5, *np.random.default_rng(1).normal(0, 1e10, 50).tolist()])
    got = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "i int, x double").select("i", "x", selection.ordered_key(F.col("x")).alias("k")).withColumn("back", selection.key_value(F.col("k"))).orderBy("i").collect()
    assert all(a.k < b.k if a.x < b.x else a.k == b.k for a, b in zip(got, got[1:], strict=False))
    assert [r.back for r in got] == x


SHARES = {"low": 0.025, "p50": 0.5, "high": 0.975, "least": 0.0, "most": 1.0}


def test_percentiles_of_groups_of_all_sizes(spark):
    rng = np.random.default_rng(2)
    groups = {"hot": rng.normal(0, 1, 20_000), "ties": np.repeat([1.0, 2.0, -3.0], [500, 3, 40]), "one": np.array([7.5]), "wide": 10.0 ** rng.integers(-300, 300, 400) * rng.choice([-1, 1], 400), None: rng.integers(-5, 5, 999).astype(float), "two": np.array([-0.0, 0.0])}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("two", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    found = {r.g: r for r in selection.percentiles(df, ["g"], "x", SHARES).collect()}
    assert set(found) == set(groups)
    for g, x in groups.items():
        for name, share in SHARES.items():
            assert found[g][name] == pytest.approx(np.quantile(x, share), rel=1e-12), (g, name)
    assert selection.percentiles(df.limit(0), ["g"], "x", SHARES).count() == 0


def test_percentiles_without_groups(spark):
    df = spark.range(1, 102).select(F.col("id").cast("double").alias("x"))
    assert tuple(selection.percentiles(df, [], "x", {"a": 0.5, "b": 0.9}).first()) == (51.0, 91.0)


def test_a_task_counts_digits_not_rows(spark):
    rows = spark.range(200_000).select(F.lit("hot").alias("g"), (F.pmod(F.hash("id"), F.lit(1 << 30)) / 7.0).alias("x"))
    plan = rows.select("g", selection.ordered_key(F.col("x")).alias("key"))
    assert plan.groupBy("g", F.shiftright("key", 48)).count().count() <= 1 << 16
    x = rows.toPandas().x.to_numpy()
    assert selection.percentiles(rows, ["g"], "x", {"m": 0.5}).first().m == pytest.approx(np.median(x))


@pytest.mark.parametrize(("pool", "hits", "chosen"), [(40, 17, 12), (5, 0, 3), (5, 5, 3), (9, 4, 9), (1, 1, 1), (1_000_000, 420_000, 300_000)])
def test_counts_follow_the_hypergeometric_distribution(spark, pool, hits, chosen):
    counts = spark.createDataFrame([("a", pool, hits, chosen), ("b", 30, 10, 10)], "g string, n_pool bigint, n_hits bigint, n_chosen bigint")
    found = resample.drawn_hits(counts, ["g"], 4000).where("g = 'a'").toPandas()["count"].to_numpy()
    drawn = np.random.default_rng(3).hypergeometric(hits, pool - hits, chosen, 200_000)
    assert len(found) == 4000 and found.min() >= max(0, chosen + hits - pool) and found.max() <= min(chosen, hits)
    assert found.mean() == pytest.approx(drawn.mean(), abs=4 * drawn.std() / 4000**0.5 + 1e-9)
    for share in (0.025, 0.5, 0.975):
        assert abs(np.quantile(found, share) - np.quantile(drawn, share)) <= max(1.0, 0.15 * drawn.std())


def test_placebo_is_near_a_draw_of_rows(spark):
    """Against the draw itself: 1000 subsamples of the pool, row by row."""
    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"g": rng.choice(["a", "b"], 900), "hit": rng.integers(0, 2, 900).astype(float), "pool": rng.random(900) < 0.8, "chosen": rng.random(900) < 0.3})
    out = resample.placebo(spark.createDataFrame(rows), ["g"], F.col("pool"), F.col("chosen"), "hit").toPandas().set_index("g")
    for g, own in rows[rows.pool].groupby("g"):
        n = int(own.chosen.sum())
        x = np.array([rng.choice(own.hit.to_numpy(), n, replace=False).mean() * 100 for _ in range(1000)])
        assert out.loc[g, "n_pool"] == len(own) and out.loc[g, "n_chosen"] == n
        assert out.loc[g, "rate"] == pytest.approx(own.hit[own.chosen].mean() * 100)
        assert abs(out.loc[g, "low"] - np.quantile(x, 0.025)) < 2 and abs(out.loc[g, "high"] - np.quantile(x, 0.975)) < 2
        assert out.loc[g, "below"] == (out.loc[g, "rate"] < out.loc[g, "low"])
