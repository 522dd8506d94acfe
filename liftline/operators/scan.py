"""Parallel scans over long series: pieces of a series are summarised each, the summaries composed in order, and pieces redone from what comes in.

A bar's step is a map of the state, and maps compose associatively: affine maps for averages and Wilder means, "last
event holds" for hysteresis, (sum, highest and lowest prefix, greatest fall) for drawdowns. One row for each piece is
all that is handled in order, so a series is dealt over as many tasks as it has pieces.

``t`` numbers a series' bars from 0 without gaps; piece k holds bars k * PIECE to (k + 1) * PIECE - 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

#: Bars of a piece.
PIECE = 1 << 16


def with_piece(rows: DataFrame, t: str = "t", piece: int = PIECE) -> DataFrame:
    return rows.withColumn("piece", F.floor(F.col(t) / piece))


def _carried(rows: DataFrame, keys: list[str], summary: dict[str, Column], carry: dict[str, Callable]) -> DataFrame:
    """Rows with what comes into their piece: a summary of each piece, carried over the pieces before."""
    before = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy(*keys, "piece").agg(*(c.alias(n) for n, c in summary.items()))
    pieces = pieces.select(*(F.col(k).alias(f"p_{k}") for k in keys), F.col("piece").alias("p_piece"), *(f(F.col(n)).over(before).alias(n) for n, f in carry.items()))
    on = (F.col("piece") == F.col("p_piece"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"p_{k}"))
    return rows.join(pieces, on).drop("p_piece", *(f"p_{k}" for k in keys))


def lagged(rows: DataFrame, keys: list[str], value: str, name: str, t: str = "t", piece: int = PIECE) -> DataFrame:
    """The value of the bar before, as ``name``; null at a series' first bar."""
    cut = with_piece(rows, t, piece)
    own = F.lag(value).over(Window.partitionBy(*keys, "piece").orderBy(t))
    met = _carried(cut.withColumn(name, own), keys, {"scan_came": F.max_by(F.struct(F.col(value).alias("v")), t)}, {"scan_came": F.last})
    return met.withColumn(name, F.when(F.col(t) % piece == 0, F.col("scan_came.v")).otherwise(F.col(name))).drop("piece", "scan_came")


def log_returns(series: DataFrame, piece: int = PIECE) -> DataFrame:
    """series, t, close with ret: the logarithm of the close over the one before."""
    return lagged(series, ["series"], "close", "came_close", piece=piece).withColumn("ret", F.ln(F.col("close") / F.col("came_close"))).drop("came_close")


def last_event(rows: DataFrame, keys: list[str], event: Column, name: str, start: int = 0, t: str = "t", piece: int = PIECE) -> DataFrame:
    """The last event that is not null, up to each bar; ``start`` before the first."""
    cut = with_piece(rows, t, piece).withColumn("scan_event", event)
    own = F.last("scan_event", ignorenulls=True).over(Window.partitionBy(*keys, "piece").orderBy(t).rowsBetween(Window.unboundedPreceding, 0))
    met = _carried(cut.withColumn(name, own), keys, {"scan_came": F.max_by("scan_event", F.when(F.col("scan_event").isNotNull(), F.col(t)))}, {"scan_came": lambda c: F.last(c, ignorenulls=True)})
    return met.withColumn(name, F.coalesce(name, "scan_came", F.lit(start))).drop("piece", "scan_event", "scan_came")


def hysteresis(rows: DataFrame, keys: list[str], x: str, enter: float, leave: float, name: str = "position", t: str = "t", piece: int = PIECE) -> DataFrame:
    """In a position from x < enter until x > leave; exact, as enter < leave."""
    return last_event(rows, keys, F.when(F.col(x) < enter, F.lit(1)).when(F.col(x) > leave, F.lit(0)), name, 0, t, piece)


def _falls(n_keys: int):  # noqa: ANN202
    """Sorted rows (keys, value) of a range -> for each group's rows in it: sum, highest and lowest running sum, greatest fall."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None  # key, sum, top, low, fall of the group that the last batch ended in

        def rows(found: list[list], schema: pa.Schema) -> pa.RecordBatch:
            columns = [pa.array([r[0][k] for r in found], schema.types[k]) for k in range(n_keys)]
            columns += [pa.array([r[k] for r in found], pa.int64()) for k in range(1, 5)]
            return pa.RecordBatch.from_arrays(columns, [*schema.names[:n_keys], "total", "top", "low", "fall"])

        schema = None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = batch.schema
            values = np.array(batch.column(n_keys), np.int64)
            codes = [np.asarray(batch.column(k).dictionary_encode().indices.fill_null(-1)) for k in range(n_keys)]
            begins = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in codes], axis=0)]) if n_keys else np.array([0])
            out = []
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(values)], strict=True):
                key = tuple(batch.column(k)[a].as_py() for k in range(n_keys))
                same = held is not None and held[0] == key
                base, top = (held[1], held[2]) if same else (0, None)
                run = base + np.cumsum(values[a:b])
                peak = np.maximum.accumulate(run if top is None else np.maximum(run, top))
                new = [key, int(run[-1]), int(peak[-1]), int(run.min()), int((peak - run).max())]
                if same:
                    new[3], new[4] = min(new[3], held[3]), max(new[4], held[4])
                elif held is not None:
                    out.append(held)
                held = new
            if out:
                yield rows(out, schema)
        if held is not None:
            yield rows([held], schema)

    return apply


def drawdowns(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """keys, mdd, mdd_from_origin: the greatest fall of the running sum of whole values from its peak, which starts at the first value, or at 0 or above.

    Rows are sorted by ranges over all groups, so one group may span many ranges. A range's part of a group becomes one
    row; falls across parts come from the highest sum before a part and the lowest within it. Rows that tie in the
    order must be equal in value.
    """
    kept = rows.select(*keys, *order, F.col(value).cast("bigint").alias("value"))
    sorted_ = kept.repartitionByRange(*keys, *order).withColumn("piece", F.spark_partition_id()).sortWithinPartitions(*keys, *order)
    named = ["piece", *keys]
    schema = StructType([f for k in named for f in sorted_.schema.fields if f.name == k])
    for n in ("total", "top", "low", "fall"):
        schema = schema.add(n, LongType())
    parts = sorted_.select(*named, "value").mapInArrow(_falls(len(named)), schema)
    before = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0)))
    parts = parts.withColumn("peak", F.max(F.col("base") + F.col("top")).over(before))
    lowest = F.col("base") + F.col("low")
    first = F.greatest("fall", F.col("peak") - lowest)  # greatest() passes over nulls: the first part has no peak before it
    return parts.groupBy(*keys).agg(F.max(first).alias("mdd"), F.max(F.greatest(first, -lowest)).alias("mdd_from_origin"))


class Recurrence(NamedTuple):
    """States of ``size`` numbers, each bar an affine map of the one before.

    ``run(t, x, d, state)`` gives the states after every bar, of its number, value, and change since the bar before (0 at
    the first bar of all). With x and d of zeros it must give the linear part. ``outputs(t, x, states)`` names columns.
    """

    size: int
    run: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    outputs: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]]
    names: tuple[str, ...]


def ewm(start: float, x: np.ndarray, alpha: float) -> np.ndarray:
    """y = (1 - alpha) * y + alpha * x from a start."""
    return pd.Series(np.r_[start, x]).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]


def recur(rows: DataFrame, keys: list[str], value: str, rule: Recurrence, t: str = "t", piece: int = PIECE) -> DataFrame:
    """keys, t, value and the rule's outputs of every bar."""
    cut = rows.select(*keys, F.col(t).cast("bigint").alias("t"), F.col(value).cast("double").alias("x"))
    own = F.floor(F.col("t") / piece)
    # a piece's last bar goes to the next piece as well, for the change at its first bar
    dealt = cut.withColumn("piece", F.explode(F.when((F.col("t") + 1) % piece == 0, F.array(own, own + 1)).otherwise(F.array(own))))

    def bars(group: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, x = group.column("t").to_numpy(), group.column("x").to_numpy()
        order = np.argsort(at, kind="stable")
        at, x = at[order], x[order]
        change = np.diff(x, prepend=x[0])
        mine = at >= k * piece
        return at[mine], x[mine], change[mine]

    names = [*keys, "piece"]

    def keyed(group: pa.Table, columns: dict[str, pa.Array]) -> pa.Table:
        n = len(next(iter(columns.values())))
        same = {k: group.column(k).combine_chunks()[:1].take(pa.array(np.zeros(n, np.int64))) for k in keys}
        return pa.table(same | columns)

    def summary(group: pa.Table) -> pa.Table:
        k = group.column("piece")[0].as_py()
        at, x, d = bars(group, k)
        if not len(at):  # only the bar before: the series ends with the piece before
            return keyed(group, {"piece": pa.array([k]), "shift": pa.array([None], pa.list_(pa.float64())), "linear": pa.array([None], pa.list_(pa.float64()))})
        zero = np.zeros(len(at))
        shift = rule.run(at, x, d, np.zeros(rule.size))[-1]
        linear = np.stack([rule.run(at, zero, zero, e)[-1] for e in np.eye(rule.size)], axis=1)
        return keyed(group, {"piece": pa.array([k]), "shift": pa.array([shift.tolist()]), "linear": pa.array([linear.ravel().tolist()])})

    def compose(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("piece").to_numpy())
        shifts, linears = group.column("shift").to_pylist(), group.column("linear").to_pylist()
        state, came = np.zeros(rule.size), []
        for i in order:
            came.append(state.tolist())
            if shifts[i] is not None:
                state = np.reshape(linears[i], (rule.size, rule.size)) @ state + np.array(shifts[i])
        return keyed(group, {"piece": pa.array(group.column("piece").to_numpy()[order]), "state": pa.array(came, pa.list_(pa.float64()))})

    def apply(group: pa.Table, states: pa.Table) -> pa.Table:
        k = group.column("piece")[0].as_py()
        at, x, d = bars(group, k)
        if not len(at):
            return keyed(group, {"t": pa.array([], pa.int64()), value: pa.array([], pa.float64())} | {n: pa.array([], pa.float64()) for n in rule.names})
        found = rule.outputs(at, x, rule.run(at, x, d, np.array(states.column("state")[0].as_py())))
        return keyed(group, {"t": pa.array(at), value: pa.array(x)} | {n: pa.array(found[n]) for n in rule.names})

    kept = StructType([f for k in names for f in dealt.schema.fields if f.name == k])
    doubles = ArrayType(DoubleType())
    maps = dealt.groupBy(*names).applyInArrow(summary, StructType(list(kept.fields)).add("shift", doubles).add("linear", doubles))
    states = maps.groupBy(*keys).applyInArrow(compose, StructType(list(kept.fields)).add("state", doubles))
    states = states.select(*(F.col(k).alias(f"s_{k}") for k in names), "state")
    out = StructType([f for f in kept.fields if f.name != "piece"]).add("t", LongType()).add(value, DoubleType())
    for n in rule.names:
        out = out.add(n, DoubleType())
    return dealt.groupBy(*names).cogroup(states.groupBy(*(f"s_{k}" for k in names))).applyInArrow(apply, out)


def indicator_rule(fast: int = 12, slow: int = 26, signal: int = 9, rsi: int = 14) -> Recurrence:
    """Two averages begun at the first value, one of their difference, and Wilder's means of gains and losses, begun as the mean of the first ``rsi`` changes; RSI is 50 until a bar after that, and its ratio 100 where losses vanish."""

    def wilder(t: np.ndarray, change: np.ndarray, start: float) -> np.ndarray:
        young = int(np.searchsorted(t, rsi, side="right"))  # bars 1 to rsi add up to a mean
        first = start + np.cumsum(change[:young]) / rsi
        return np.r_[first, ewm(first[-1] if young else start, change[young:], 1 / rsi)]

    def run(t: np.ndarray, x: np.ndarray, d: np.ndarray, state: np.ndarray) -> np.ndarray:
        f0, s0, g0, up, down = (x[0], x[0], 0.0, 0.0, 0.0) if t[0] == 0 else state
        f, s = ewm(f0, x, 2 / (fast + 1)), ewm(s0, x, 2 / (slow + 1))
        return np.stack([f, s, ewm(g0, f - s, 2 / (signal + 1)), wilder(t, np.maximum(d, 0), up), wilder(t, np.maximum(-d, 0), down)], axis=1)

    def outputs(t: np.ndarray, x: np.ndarray, states: np.ndarray) -> dict[str, np.ndarray]:
        f, s, g, up, down = states.T
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(down <= 1e-10, 100.0, up / down)
        return {"ema_fast": f, "ema_slow": s, "macd": f - s, "macd_signal": g, "rsi": np.where(t > rsi, 100 - 100 / (1 + ratio), 50.0)}

    return Recurrence(5, run, outputs, ("ema_fast", "ema_slow", "macd", "macd_signal", "rsi"))


def indicators(series: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, rsi: int = 14, piece: int = PIECE) -> DataFrame:
    """series, t, close, ema_fast, ema_slow, macd, macd_signal, rsi."""
    return recur(series, ["series"], "close", indicator_rule(fast, slow, signal, rsi), piece=piece)


def numbered(rows: DataFrame, by: str, name: str = "t", bucket: int = PIECE) -> DataFrame:
    """Distinct whole numbers with their places in order, from 0: counts by bucket of the numbers, then places within each."""
    cut = rows.select(by, F.floor(F.col(by) / bucket).alias("bucket"))
    counts = cut.groupBy(F.col("bucket").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    counts = counts.select("b", (F.sum("c").over(Window.orderBy("b")) - F.col("c")).alias("first"))  # one row for each bucket
    own = F.row_number().over(Window.partitionBy("bucket").orderBy(by)) - 1
    return cut.withColumn("own", own).join(counts, F.col("bucket") == F.col("b")).select(by, (F.col("first") + F.col("own")).cast("int").alias(name))
