"""Intervals spelled out after the shuffle, against a loop."""

import numpy as np

from liftline.operators import sequence


def test_intervals_are_shuffled_before_they_are_spelled_out(spark):
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(0, 3)), int(f), int(f + rng.integers(0, 200)), k, int(rng.choice([-1, 1]))) for k, f in enumerate(rng.integers(-300, 300, 60))]
    rows += [(7, 63, 64, 100, 1), (7, -65, -64, 101, -1), (8, None, 3, 102, 1)]
    frame = sequence.expand_intervals(spark.createDataFrame(rows, "u int, first bigint, last bigint, place int, dir int").repartition(3), ["u"], "first", "last", ["place"], "dir")
    want = {(u, bar): d for u, first, last, _, d in rows if first is not None for bar in range(first, last + 1)}
    found = frame.collect()
    assert {(r.u, r.bar): r.dir for r in found} == want and len(found) == len(want) and frame.columns == ["u", "bar", "dir"]
    plan = frame._jdf.queryExecution().executedPlan().toString().splitlines()
    shuffles = [k for k, line in enumerate(plan) if "Exchange hashpartitioning" in line]
    bars = next(k for k, line in enumerate(plan) if "Generate explode(sequence(greatest(" in line)
    assert shuffles and min(shuffles) > bars  # lines further down run earlier
