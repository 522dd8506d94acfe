"""Trades from a stream of bars: an open run is keyed state, emitted when the position turns.

Bars wait in state until the watermark has passed them, so rows that come out of order within the delay are put in
order first. A timer per batch of bars wakes the key when its bars are due, also if no more rows come for it. Bars that
come when later ones of their key have been taken are dropped, as the watermark says they may be.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

_WAITING = "position int, ret double"
_OPEN = "run bigint, position int, first_t bigint, last_t bigint, pnl double"


class _Runs(StatefulProcessor):
    """State of a key: bars not yet due, by their time in milliseconds, and the run that is open."""

    def __init__(self, keys: list[str], cost: float, unit: int):
        self.keys, self.cost, self.unit = keys, cost, unit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms bigint", _WAITING)
        self.open = handle.getValueState("open", _OPEN)

    def _advance(self, key: tuple, upto: int) -> Iterator[pd.DataFrame]:
        due = sorted(k[0] for k in self.waiting.keys() if k[0] <= upto)
        run, position, first, last, pnl = self.open.get() if self.open.exists() else (0, 0, -1, -1, 0.0)
        found = []
        for ms in due:
            new, ret = self.waiting.getValue((ms,))
            self.waiting.removeKey((ms,))
            t = ms // self.unit
            if new != position:
                if position:
                    found.append((*key, run, position, first, last, pnl - self.cost))
                run, position, first, pnl = run + 1, new, t, 0.0
            last, pnl = t, pnl + new * (ret or 0.0)
        if due:
            self.open.update((run, position, first, last, pnl))
        if found:
            yield pd.DataFrame(found, columns=[*self.keys, "run", "position", "first_t", "last_t", "pnl"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        taken = self.open.get()[3] if self.open.exists() else -1
        last = None
        for batch in rows:
            for ms, position, ret in zip(batch["ms"].tolist(), batch["position"].tolist(), batch["ret"].tolist(), strict=True):
                if ms // self.unit > taken:
                    self.waiting.updateValue((ms,), (position, None if ret != ret else ret))
                    last = ms if last is None else max(last, ms)
        if last is not None:
            self.handle.registerTimer(last + 1)
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def trade_runs(bars: DataFrame, keys: list[str], ts: str, delay: str = "1 day", cost: float = 0.0, unit_ms: int = 3_600_000) -> DataFrame:
    """keys, run, position, first_t, last_t, pnl of a stream of (keys, ts, position, ret), as the batch gives them; t counts units of time since the epoch.

    One bar for each key and unit; of repeated ones the last that comes holds. The last run of a key is open until a bar
    of another position comes.
    """
    kept = bars.withWatermark(ts, delay).select(*keys, ts, F.unix_millis(ts).alias("ms"), F.col("position").cast("int").alias("position"), F.col("ret").cast("double").alias("ret"))
    schema = StructType([f for k in keys for f in bars.schema.fields if f.name == k]).add("run", "long").add("position", "integer").add("first_t", "long").add("last_t", "long").add("pnl", "double")
    return kept.groupBy(*keys).transformWithStateInPandas(_Runs(keys, cost, unit_ms), schema, "append", "eventTime")
