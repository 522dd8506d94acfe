"""All registered queries and their SQL twins, gathered from the plan modules."""

from __future__ import annotations

from liftline.plans import correlations, lifts, resampling, series, statistics

_MODULES = (lifts, statistics, resampling, series, correlations)

QUERIES: dict = {}
ORACLES: dict = {}
for _module in _MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
