"""Groups of blocks meet in one task; units with and without gaps are met by their own kernels."""

import numpy as np
import pytest

from liftline.operators import gram


def test_blocks_meet_in_groups_and_one_pass_serves_sums_and_places(spark, monkeypatch):
    monkeypatch.setattr(gram, "BLOCK", 4)
    monkeypatch.setattr(gram, "_TASKS", 1)
    rng = np.random.default_rng(7)
    x, families = rng.normal(0, 1, (40, 12)), rng.integers(0, 3, 40)
    x[::5][rng.random((8, 12)) < 0.2] = np.nan
    x[7] = 2.0  # constant
    rows = [(i, int(f), [None if np.isnan(v) else float(v) for v in r]) for i, (r, f) in enumerate(zip(x, families, strict=True))]
    blocks = gram.blocks_of(spark.createDataFrame(rows, "unit int, family int, x array<double>"), "unit", "family", "x", 12)
    want = {False: [], True: []}
    for i in range(40):
        for j in range(i + 1, 40):
            both = ~np.isnan(x[i]) & ~np.isnan(x[j])
            if 7 not in (i, j):
                want[bool(families[i] == families[j])].append(np.corrcoef(x[i][both], x[j][both])[0, 1])
    sums, digits = gram.moments_and_digits(blocks, 12, 0.3)
    for row in sums.collect():
        r = np.array(want[row.same_family])
        assert (row.pairs, row["mean"], row.mean_abs, row.above) == pytest.approx((len(r), r.mean(), np.abs(r).mean(), (r > 0.3).mean()))
    wanted = spark.createDataFrame([(s, len(v) // 2) for s, v in want.items()], "same_family boolean, place bigint")
    found = {row.same_family: row.r for row in gram.ranked(blocks, 12, wanted, digits=digits).collect()}
    assert found == pytest.approx({s: np.sort(v)[len(v) // 2] for s, v in want.items()}, abs=1.1e-9)
