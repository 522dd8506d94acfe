"""Tallies over all pairs, family means and packed positions, against numpy pair by pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftline.operators import correlation, gram


def _vectors(n, windows, missing, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, windows)) + rng.normal(0, 0.7, (1, windows))
    x[0] = 3.25  # constant
    if missing:
        x[rng.random(x.shape) < 0.2] = np.nan
        x[1, 4:] = np.nan  # too few windows
    return x, rng.integers(0, 4, n)


def _frame(spark, x, families):
    rows = [(i, int(f), [None if np.isnan(v) else float(v) for v in row]) for i, (row, f) in enumerate(zip(x, families, strict=True))]
    return spark.createDataFrame(rows, "unit int, family int, x array<double>")


def _pairs(x, families, windows):
    """i, j, n, r, same of every pair of units with enough windows."""
    fine = [i for i in range(len(x)) if (~np.isnan(x[i])).sum() >= max(3, windows // 2)]
    out = []
    for k, i in enumerate(fine):
        for j in fine[k + 1 :]:
            both = ~np.isnan(x[i]) & ~np.isnan(x[j])
            a, b = x[i][both], x[j][both]
            if a.std() > 1e-9 and b.std() > 1e-9:
                out.append((i, j, both.sum(), np.corrcoef(a, b)[0, 1], families[i] == families[j]))
    return out


@pytest.mark.parametrize("missing", [False, True])
@pytest.mark.parametrize("block", [7, 10, 2048])
def test_tallies_of_all_pairs(spark, monkeypatch, missing, block):
    monkeypatch.setattr(gram, "BLOCK", block)
    x, families = _vectors(60, 16, missing)
    blocks = gram.blocks_of(_frame(spark, x, families).repartition(3), "unit", "family", "x", 16)
    pairs = _pairs(x, families, 16)
    counts = {r.bin: r.n for r in gram.histogram(blocks, 16, 20).collect()}
    want = np.bincount([min(int((r + 1) / 2 * 20), 19) for *_, r, _ in pairs], minlength=20)
    assert [counts[k] for k in range(20)] == want.tolist()
    sums = {r.same_family: r for r in gram.moments(blocks, 16, 0.3).collect()}
    for same in (False, True):
        r, n = (np.array([p[k] for p in pairs if p[4] == same]) for k in (3, 2))
        assert (sums[same].pairs, sums[same]["mean"], sums[same].mean_abs, sums[same].above) == pytest.approx((len(r), r.mean(), np.abs(r).mean(), (r > 0.3).mean()))
        assert sums[same].null_abs == pytest.approx(np.sqrt(2 / (np.pi * n)).mean())


@pytest.mark.parametrize("of_abs", [False, True])
def test_places_of_all_pairs(spark, monkeypatch, of_abs):
    monkeypatch.setattr(gram, "BLOCK", 16)
    x, families = _vectors(50, 12, False, 2)
    x[10:14] = x[9]  # ties at 1
    blocks = gram.blocks_of(_frame(spark, x, families), "unit", "family", "x", 12)
    pairs = _pairs(x, families, 12)
    for same in (False, True):
        values = np.sort([abs(r) if of_abs else r for *_, r, s in pairs if s == same])
        places = sorted({0, 1, len(values) // 2, len(values) - 2, len(values) - 1})
        wanted = spark.createDataFrame([(same, p) for p in places], "same_family boolean, place bigint")
        found = {r.place: r.r for r in gram.ranked(blocks, 12, wanted, of_abs).collect()}
        assert [found[p] for p in places] == pytest.approx(values[places].tolist(), abs=1.1e-9)


def test_family_means_need_no_pairs(spark):
    x, families = _vectors(80, 16, False, 3)
    families[:3] = [9, 8, 7]  # families of one
    found = {(r.family_i, r.family_j): (r.pairs, r.mean_r) for r in gram.family_means(_frame(spark, x, families), "family", "x", 16).collect()}
    want = {}
    for i, j, _, r, _ in _pairs(x, families, 16):
        for key in {(families[i], families[j]), (families[j], families[i])}:
            want.setdefault(tuple(map(int, key)), []).append(r)
    assert set(found) == set(want)
    for key, r in want.items():
        assert found[key] == pytest.approx((len(r), np.mean(r)))


def test_positions_as_bits(spark):
    rng = np.random.default_rng(4)
    grid = rng.choice([-1, 0, 1], (12, 300), p=[0.15, 0.7, 0.15])
    grid[3], grid[4, :], grid[5, 40] = 0, 0, 0
    grid[4, 7] = 1
    rows = [(i, int(b) - 70, int(d)) for i, own in enumerate(grid) for b, d in enumerate(own) if d]
    packed = correlation.packed_positions(spark.createDataFrame(rows, "strategy int, bar bigint, dir int").repartition(4))
    nb = int((grid != 0).any(axis=0).sum())
    pairs = spark.createDataFrame([(i, j, i + j) for i in range(12) for j in range(i + 1, 12) if 3 not in (i, j)], "i int, j int, tag int")
    got = {(r.i, r.j): r for r in correlation.position_corr(packed, pairs).collect()}
    assert len(got) == 55 and all(r.nb == nb and r.tag == r.i + r.j for r in got.values())
    used = grid[:, (grid != 0).any(axis=0)].astype(float)
    for (i, j), r in got.items():
        assert r.r == pytest.approx(np.corrcoef(used[i], used[j])[0, 1], abs=1e-9)
    assert packed.count() <= 12 * 6 and packed.agg(F.max(F.bit_count("up"))).first()[0] > 1


def test_pairs_of_families(spark):
    units = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a"), (5, None), (6, None)], "u int, f string")
    assert sorted((r.i, r.j) for r in correlation.family_pairs(units, "u", "f").collect()) == [(1, 2), (1, 4), (2, 4)]


@pytest.mark.parametrize("block", [1, 5, 1024])
def test_pairs_of_families_meet_in_blocks(spark, block):
    rng = np.random.default_rng(5)
    rows = [(i, int(b) * 7 - 900, int(d)) for i in range(15) for b, d in enumerate(rng.choice([-1, 0, 1], 400)) if d and i != 6]
    rows += [(15, 10**7, 1), (16, 64 * 10**6, -1)]  # bars that few share
    packed = correlation.packed_positions(spark.createDataFrame(rows, "strategy int, bar bigint, dir int")).cache()
    units = spark.createDataFrame([(i, None if i == 4 else "ab"[i % 2]) for i in range(18)], "strategy int, family string")
    pairs = correlation.family_pairs(units.join(packed.select(packed.u.alias("strategy")).distinct(), "strategy", "left_semi"), "strategy", "family")
    want = {(r.i, r.j): r.r for r in correlation.position_corr(packed, pairs).collect()}
    frame = correlation.family_corr(packed, units, "strategy", "family", block)
    found = {(r.i, r.j): r.r for r in frame.collect()}
    assert frame.count() == len(found) and found == want and (15, 16) not in found and (1, 15) in found
