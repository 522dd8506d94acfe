"""Correlations of all pairs of units by blocks, tallied where they are made.

Units are packed into blocks of rows, and blocks into groups; two groups meet in one task, so that a block is shuffled
once for each group and not for each block. Units that have all windows are standardised once, and r is their matrix
product; where values are missing another kernel gives the coefficient over the windows that both units have. Pairs are
counted in the task and never become rows. The work is quadratic in units; what a task holds is two groups, some rows
of coefficients and a table of tallies. Means by family need no pairs at
all: of standardised units, the sum of r over two families' pairs is the product of the families' summed vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftline.scratch import settle

#: Units of a block.
BLOCK = 2048
#: Coefficients are counted as whole numbers of this part.
SCALE = 10**9
_DIGIT = 16

#: Blocks of a group at most, tasks for each core at least, and coefficients that a kernel holds at a time.
_GROUP, _TASKS, _NEAR = 32, 8, 1 << 16

#: Takes coefficients, the number of windows of each (or of all), and 1 for pairs within a family, else 0.
Add = Callable[[np.ndarray, "np.ndarray | float", int], None]
#: Starts a task's tally: what adds to it, and what returns its keys and values for each side.
Tally = Callable[[], tuple[Add, Callable[[], list[tuple[np.ndarray, np.ndarray]]]]]


def present(x: Column) -> Column:
    return F.filter(x, lambda v: v.isNotNull() & ~F.isnan(v))


def blocks_of(units: DataFrame, unit: str, family: str, values: str, windows: int) -> DataFrame:
    """block, units, families, data: units with at least half of the windows, and three; families as numbers of their order."""
    named = units.where(F.size(present(F.col(values))) >= max(3, windows // 2)).select(F.col(unit).cast("bigint").alias("unit"), F.col(family).alias("family"), F.col(values).alias("x"))
    codes = named.select("family").distinct().withColumn("code", F.row_number().over(Window.orderBy("family")).cast("bigint"))  # one row for each family
    named = named.join(codes.withColumnRenamed("family", "f"), F.col("family").eqNullSafe(F.col("f"))).select("unit", "code", "x")
    n = units.count()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, codes, rows = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            codes += batch.column(1).to_pylist()
            for x in batch.column(2).to_pylist():
                row = np.full(windows, np.nan)
                row[: len(x)] = [np.nan if v is None else v for v in x[:windows]]
                rows.append(row)
        if ids:
            arrays = [[np.array(ids, np.int64).tobytes()], [np.array(codes, np.int64).tobytes()], [np.stack(rows).tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()) for a in arrays], ["units", "families", "data"])

    packed = named.repartition(max(1, -(-n // BLOCK)), "unit").mapInArrow(pack, "units binary, families binary, data binary")
    return settle(packed.withColumn("block", F.spark_partition_id()))


def corr_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """r and n of every row of a with every row of b, over the columns that both have; NaN where a side is constant."""
    ma, mb = ~np.isnan(a), ~np.isnan(b)
    a, b = np.where(ma, a, 0.0), np.where(mb, b, 0.0)
    # about each row's mean, which changes no coefficient and keeps the differences below exact
    a = np.where(ma, a - a.sum(axis=1, keepdims=True) / np.maximum(ma.sum(axis=1, keepdims=True), 1), 0.0)
    b = np.where(mb, b - b.sum(axis=1, keepdims=True) / np.maximum(mb.sum(axis=1, keepdims=True), 1), 0.0)
    fa, fb = ma.astype(float), mb.astype(float)
    n = fa @ fb.T
    with np.errstate(divide="ignore", invalid="ignore"):
        sx, sy = a @ fb.T, fa @ b.T
        vx, vy = (a * a) @ fb.T - sx * sx / n, fa @ (b * b).T - sy * sy / n
        least = 1e-13
        r = (a @ b.T - sx * sy / n) / np.sqrt(np.where((vx > least) & (vy > least), vx * vy, np.nan))
    return np.clip(r, -1.0, 1.0), n


class _Block:
    """A block's units in order of their families: standardised ones, and those with gaps."""

    def __init__(self, families: bytes, data: bytes, windows: int) -> None:
        codes, x = np.frombuffer(families, np.int64), np.frombuffer(data).reshape(-1, windows)
        order = np.argsort(codes, kind="stable")
        codes, x = codes[order], x[order]
        gaps = np.isnan(x).any(axis=1)
        c = x[~gaps] - x[~gaps].mean(axis=1, keepdims=True)
        squares = (c * c).sum(axis=1)
        varied = squares > 1e-13  # constant units have no r
        self.z, self.codes = c[varied] / np.sqrt(squares[varied])[:, None], codes[~gaps][varied]
        self.x, self.x_codes = x[~gaps][varied], codes[gaps]
        self.gaps = x[gaps]

    def runs(self, width: int) -> Iterator[tuple[int, int]]:
        """Rows of one family, so many that a kernel's coefficients stay few."""
        ends = [0, *(np.flatnonzero(np.diff(self.codes)) + 1).tolist(), len(self.codes)]
        step = max(1, _NEAR // max(1, width))
        for low, high in zip(ends[:-1], ends[1:], strict=True):
            for k in range(low, high, step):
                yield k, min(high, k + step)


def _meet(a: _Block, b: _Block, windows: int, add: Add) -> None:
    """Adds every pair of different units of two blocks, or of one, once."""
    own = a is b
    for low, high in a.runs(len(b.z)):
        first, last = np.searchsorted(b.codes, [a.codes[low], a.codes[low] + 1]).tolist()
        for start, end, side in ((0, first, 0), (first, last, 1), (last, len(b.z), 0)):
            start = max(start, high) if own else start
            if start < end:
                add((a.z[low:high] @ b.z[start:end].T).ravel(), windows, side)
        if own and high - low > 1:
            add((a.z[low:high] @ a.z[low:high].T)[np.triu_indices(high - low, 1)], windows, 1)
    with_gaps = [(a.gaps, a.x_codes, b.x, b.codes), (a.gaps, a.x_codes, b.gaps, b.x_codes)] + ([] if own else [(b.gaps, b.x_codes, a.x, a.codes)])
    for x, fx, y, fy in with_gaps:
        step = max(1, _NEAR // max(1, len(y)))
        for k in range(0, len(x) if len(y) else 0, step):
            r, n = corr_of(x[k : k + step], y)
            fine, same = ~np.isnan(r), fx[k : k + step, None] == fy[None, :]
            if own and y is x:
                fine &= np.arange(len(y))[None, :] > np.arange(k, k + len(r))[:, None]
            for side in (0, 1):
                at = fine & (same == bool(side))
                add(r[at], n[at], side)


def tallied(blocks: DataFrame, windows: int, *tallies: Tally) -> DataFrame:
    """kind, key, value: the tallies of all pairs of different units, summed; a tally's kinds are two, across families and within, after those of the tallies before it."""
    count = blocks.count()
    parallel = blocks.sparkSession.sparkContext.defaultParallelism
    groups = max(1, min(count, max(int(np.ceil(np.sqrt(2 * _TASKS * parallel))), -(-count // _GROUP))))
    place = F.row_number().over(Window.orderBy("block")) - 1  # one number for each block
    slots = blocks.select("block").withColumn("slot", place)
    dealt = blocks.join(slots, "block").select("slot", (F.col("slot") % groups).alias("own"), "families", "data")
    sent = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    sent = sent.select(F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "slot", "families", "data")

    def meet(group: pa.Table) -> pa.Table:
        started = [t() for t in tallies]

        def add(r: np.ndarray, n: np.ndarray | float, side: int) -> None:
            if len(r):
                for more, _ in started:
                    more(r, n, side)

        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        sides: dict[int, list[tuple[int, _Block]]] = {low: [], high: []}
        for own, slot, families, data in zip(*(group.column(c).to_pylist() for c in ("own", "slot", "families", "data")), strict=True):
            sides[own].append((slot, _Block(families, data, windows)))
        for i, a in sides[low]:
            for j, b in sides[high]:
                if low != high or i <= j:
                    _meet(a, b, windows, add)
        found = [(2 * t + side, keys, values) for t, (_, done) in enumerate(started) for side, (keys, values) in enumerate(done())]
        column = lambda parts, kind: pa.array(np.concatenate([np.asarray(x, kind) for x in parts]))
        return pa.table({"kind": column([np.full(len(k), kind) for kind, k, _ in found], np.int64), "key": column([k for _, k, _ in found], np.int64), "value": column([v for *_, v in found], float)})

    parts = sent.repartition(groups * (groups + 1) // 2, "low", "high")  # few rows that cost much: not coalesced by their size
    return parts.groupBy("low", "high").applyInArrow(meet, "kind bigint, key bigint, value double").groupBy("kind", "key").agg(F.sum("value").alias("value"))


def _counting(size: int, keys: Callable[[np.ndarray], np.ndarray], split: bool = True) -> Tally:
    """Counts of keys from 0 to below ``size``; those of both sides as one unless they are split."""

    def start():  # noqa: ANN202
        counts = np.zeros((2, size), np.int64)

        def add(r: np.ndarray, n: np.ndarray | float, side: int) -> None:
            own, k = counts[side if split else 0], keys(r)
            if len(k) * 4 < size:
                np.add.at(own, k, 1)
            else:
                own += np.bincount(k, minlength=size)

        return add, lambda: [(k := np.flatnonzero(own), own[k]) for own in counts]

    return start


def rounded(r: np.ndarray) -> np.ndarray:
    return np.rint(r * SCALE).astype(np.int64)


def histogram(blocks: DataFrame, windows: int, bins: int) -> DataFrame:
    """bin, n over [-1, 1], empty bins included; the upper end is in the last."""
    at = lambda r: np.minimum((rounded(r) + SCALE) * bins // (2 * SCALE), bins - 1)
    counts = tallied(blocks, windows, _counting(bins, at, False)).select(F.col("key").cast("int").alias("b"), F.col("value").cast("bigint").alias("n"))
    every = blocks.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, F.col("bin") == F.col("b"), "left").select("bin", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


#: What ``moments`` sums up, in order.
_SUMS = ("pairs", "r", "abs", "above", "null_abs")


def _summing(above: float, of_abs: bool) -> Tally:
    def start():  # noqa: ANN202
        sums = np.zeros((2, len(_SUMS)))

        def add(r: np.ndarray, n: np.ndarray | float, side: int) -> None:
            size = np.abs(r)
            null = np.sqrt(2 / (np.pi * n))
            sums[side] += len(r), r.sum(), size.sum(), np.count_nonzero((size if of_abs else r) > above), null.sum() if np.ndim(n) else null * len(r)

        return add, lambda: [(np.arange(len(own)), own) if own[0] else ([], []) for own in sums]

    return start


def _keys(of_abs: bool) -> Callable[[np.ndarray], np.ndarray]:
    return lambda r: rounded(np.abs(r) if of_abs else r) + (0 if of_abs else SCALE)


def _leading(of_abs: bool) -> Tally:
    keys = _keys(of_abs)
    return _counting((2 * SCALE >> _DIGIT) + 1, lambda r: keys(r) >> _DIGIT)


def moments_and_digits(blocks: DataFrame, windows: int, above: float, of_abs: bool = False) -> tuple[DataFrame, DataFrame]:
    """What ``moments`` returns, and the counts that ``ranked`` begins with, of one pass over the pairs."""
    both = settle(tallied(blocks, windows, _summing(above, of_abs), _leading(of_abs)))
    return _moments(both.where("kind < 2")), both.where("kind >= 2").withColumn("kind", F.col("kind") - 2)


def moments(blocks: DataFrame, windows: int, above: float, of_abs: bool = False) -> DataFrame:
    """same_family, pairs, mean, mean_abs, above (share of r, or of |r|, that is greater), null_abs (mean |r| of independent series)."""
    return _moments(tallied(blocks, windows, _summing(above, of_abs)))


def _moments(sums: DataFrame) -> DataFrame:
    wide = sums.groupBy("kind").agg(*(F.max(F.when(F.col("key") == k, F.col("value"))).alias(name) for k, name in enumerate(_SUMS)))
    mean = lambda c: F.col(c) / F.col("pairs")
    return wide.select((F.col("kind") == 1).alias("same_family"), F.col("pairs").cast("bigint").alias("pairs"), mean("r").alias("mean"), mean("abs").alias("mean_abs"), mean("above").alias("above"), mean("null_abs").alias("null_abs"))


def ranked(blocks: DataFrame, windows: int, wanted: DataFrame, of_abs: bool = False, digits: DataFrame | None = None) -> DataFrame:
    """same_family, place, r: of all pairs within families, and across, the coefficient at each wanted (same_family, place), from 0; exact in parts of 1 / SCALE.

    One pass counts the coefficients by their leading digit (unless ``digits`` are those counts), a second those in the
    digits that hold a wanted place.
    """

    def narrowed(counts: DataFrame, left: DataFrame, head: Column) -> DataFrame:
        counts = counts.select((F.col("kind") == 1).alias("side"), F.col("key").alias("cell"), head.alias("top"), F.col("value").cast("bigint").alias("c"))
        counts = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("side", "top").orderBy("cell")))
        met = left.join(counts, (F.col("same_family") == F.col("side")) & F.col("head").eqNullSafe(F.col("top")) & (F.col("inner") >= F.col("upto") - F.col("c")) & (F.col("inner") < F.col("upto")))
        return settle(met.select("same_family", "place", (F.col("inner") - F.col("upto") + F.col("c")).alias("inner"), F.col("cell").alias("head")))

    left = wanted.select("same_family", "place", F.col("place").alias("inner"), F.lit(None).cast("bigint").alias("head"))
    left = narrowed(tallied(blocks, windows, _leading(of_abs)) if digits is None else digits, left, F.lit(None).cast("bigint"))
    held = np.array(sorted({r["head"] for r in left.select("head").distinct().collect()}), np.int64)  # at most one for each wanted place
    slot = np.full((2 * SCALE >> _DIGIT) + 1, -1, np.int64)
    slot[held] = np.arange(len(held))
    keys = _keys(of_abs)

    def cells(r: np.ndarray) -> np.ndarray:
        k = keys(r)
        at = slot.take(k >> _DIGIT)
        fine = np.flatnonzero(at >= 0)
        return (at[fine] << _DIGIT) + (k[fine] & ((1 << _DIGIT) - 1))

    found = tallied(blocks, windows, _counting(max(1, len(held)) << _DIGIT, cells))
    heads = F.array(*(F.lit(h) for h in held.tolist())).cast("array<bigint>")
    found = found.withColumn("key", F.shiftleft(F.element_at(heads, F.shiftright("key", _DIGIT).cast("int") + 1), _DIGIT) + F.col("key") % (1 << _DIGIT))
    left = narrowed(found, left, F.shiftright("key", _DIGIT))
    value = F.col("head") if of_abs else F.col("head") - SCALE
    return left.select("same_family", "place", (value / F.lit(float(SCALE))).alias("r"))


def family_means(units: DataFrame, family: str, values: str, windows: int) -> DataFrame:
    """family_i, family_j, pairs, mean_r, both ways round: from each family's sum of standardised units, linear in their number. Units need all windows; constant ones have no r."""
    x = F.transform(F.slice(values, 1, windows), lambda v: v.cast("double"))
    full = units.where(F.size(present(F.col(values))) == windows).select(F.col(family).alias("family"), x.alias("x"))
    mean = F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / windows
    full = full.withColumn("mean", mean).withColumn("c", F.transform("x", lambda v: v - F.col("mean")))
    full = full.withColumn("norm", F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, v: s + v * v))).where("norm > 3e-7")
    sums = full.groupBy("family").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("c")[k] / F.col("norm")).alias(f"z{k}") for k in range(windows)))
    sums = sums.select("family", "n", F.array(*(f"z{k}" for k in range(windows))).alias("z"))
    # one row for each family
    pair = sums.alias("a").crossJoin(sums.alias("b")).select(F.col("a.family").alias("family_i"), F.col("b.family").alias("family_j"), F.col("a.n").alias("n"), F.col("b.n").alias("m"), F.aggregate(F.zip_with(F.col("a.z"), F.col("b.z"), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v).alias("total"))
    own = F.col("family_i").eqNullSafe(F.col("family_j"))
    pairs = F.when(own, F.floor(F.col("n") * (F.col("n") - 1) / 2)).otherwise(F.col("n") * F.col("m"))
    return pair.select("family_i", "family_j", pairs.alias("pairs"), (F.when(own, (F.col("total") - F.col("n")) / 2).otherwise(F.col("total")) / F.when(pairs > 0, pairs)).alias("mean_r")).where("pairs > 0")
