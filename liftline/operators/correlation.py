"""Pairwise correlation of units: from values by window, or from sparse positions by bar."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftline.functions import rng
from liftline.functions.expressions import safe_corr


def with_support(values: DataFrame, unit: str, value: str, windows: int) -> DataFrame:
    """Only units with values in at least half of the windows, and three."""
    fine = values.where(F.col(value).isNotNull()).groupBy(unit).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= max(3, windows // 2)).select(unit)
    return values.join(fine, unit, "left_semi")


def pair_corr(values: DataFrame, unit: str, window: str, value: str, family: str) -> DataFrame:
    """i, j, family_i, family_j, n, r for i < j: Pearson over the windows that both have. Pairs meet on the window and are summed at once."""
    a = values.select(F.col(window).alias("w"), F.col(unit).alias("i"), F.col(family).alias("family_i"), F.col(value).cast("double").alias("x"))
    b = values.select(F.col(window).alias("w"), F.col(unit).alias("j"), F.col(family).alias("family_j"), F.col(value).cast("double").alias("y"))
    return a.join(b, "w").where("i < j").groupBy("i", "j", "family_i", "family_j").agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col("x"), F.col("y")).alias("r"))


def null_abs_corr(n: Column) -> Column:
    """The mean |r| of independent normal series of length n."""
    return F.sqrt(F.lit(2.0) / (F.pi() * n))


def as_matrix(means: DataFrame, families: list) -> DataFrame:
    """One row and column for each family; 0 where there are no pairs."""
    wide = means.groupBy("family_i").pivot("family_j", families).agg(F.first("mean_r"))
    return wide.select("family_i", *(F.coalesce(F.col(f"`{f}`"), F.lit(0.0)).alias(f"f{f}") for f in families))


def packed_positions(positions: DataFrame, unit: str = "strategy", bar: str = "bar", value: str = "dir") -> DataFrame:
    """u, word, up, down: the bars of a unit's +1 and -1 positions as bits, 64 bars a row."""
    bit = F.expr(f"shiftleft(1L, CAST(pmod({bar}, 64) AS INT))")
    side = lambda sign: F.coalesce(F.bit_or(F.when(F.col(value) == sign, bit)), F.lit(0).cast("bigint"))
    return positions.groupBy(F.col(unit).alias("u"), F.floor(F.col(bar) / 64).alias("word")).agg(side(1).alias("up"), side(-1).alias("down"))


#: Units of a family that meet another such block in one task.
UNITS = 1024
#: Words of 64 bars that are spelled out at a time.
_WORDS = 64


def family_pairs(units: DataFrame, unit: str, family: str) -> DataFrame:
    """i, j for i < j: all pairs of units of one family."""
    a, b = units.select(F.col(family).alias("f"), F.col(unit).alias("i")), units.select(F.col(family).alias("f"), F.col(unit).alias("j"))
    return a.join(b, "f").where("i < j").select("i", "j")


def _dots(a: list[pa.Array], b: list[pa.Array]) -> np.ndarray:
    """Dot products of every unit of a with every unit of b; a side is its units' words, up and down bits."""
    sides = []
    for word, up, down in (a, b):
        row = np.repeat(np.arange(len(word)), np.diff(word.offsets.to_numpy()))
        sides.append((len(word), row, *(x.flatten().to_numpy() for x in (word, up, down))))
    shared = np.intersect1d(sides[0][2], sides[1][2])
    out = np.zeros((len(a[0]), len(b[0])))

    def spelled(n: int, row: np.ndarray, word: np.ndarray, up: np.ndarray, down: np.ndarray, some: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(some, word), len(some) - 1)
        fine = some[at] == word
        bits = np.zeros((2, n, len(some)), np.int64)
        bits[0, row[fine], at[fine]], bits[1, row[fine], at[fine]] = up[fine], down[fine]
        plus, minus = np.unpackbits(bits.view(np.uint8), axis=-1).view(np.int8)
        return (plus - minus).astype(np.float32)  # sums of a chunk are whole numbers far below 2 ** 24

    for k in range(0, len(shared), _WORDS):
        some = shared[k : k + _WORDS]
        out += spelled(*sides[0], some) @ spelled(*sides[1], some).T
    return out


def _corr(dot: Column, nb: Column, si: Column, sj: Column, ci: Column, cj: Column, root=np.sqrt):  # noqa: ANN001, ANN202
    """Numerator and denominator of r, from a dot product, sums and counts; of columns or arrays."""
    return dot - si * sj / nb, root((ci - si * si / nb) * (cj - sj * sj / nb))


def _stats(packed: DataFrame) -> tuple[list[Column], DataFrame]:
    """Aggregates s and c of a unit, and the one row nb: the number of bars that any unit has."""
    count = F.bit_count
    stats = [F.sum(count("up") - count("down")).cast("double").alias("s"), F.sum(count("up") + count("down")).cast("double").alias("c")]
    words = packed.groupBy("word").agg(F.bit_or(F.col("up").bitwiseOR(F.col("down"))).alias("any"))
    return stats, words.agg(F.sum(count("any")).cast("double").alias("nb"))


def family_corr(packed: DataFrame, units: DataFrame, unit: str, family: str, block: int = UNITS) -> DataFrame:
    """i, j, r for i < j: ``position_corr`` of all pairs of units of one family.

    A family is dealt over blocks of units, a unit is one row of its words, and two blocks meet in one task, which
    multiplies them. What is shuffled is each unit once for each block of its family; pairs are only put out.
    """
    stats, bars = _stats(packed)
    rows = packed.groupBy("u").agg(*stats, F.collect_list(F.struct("word", "up", "down")).alias("bits"))
    named = units.select(F.col(unit).alias("u"), F.col(family).alias("family")).where("family IS NOT NULL")
    sizes = named.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))  # one row for each family
    dealt = named.join(sizes, "family").withColumn("own", F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int"))
    rows = rows.join(dealt, "u").crossJoin(F.broadcast(bars)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))  # one row
    rows = rows.select("family", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", F.col("u").cast("bigint").alias("u"), "s", "c", "nb", *(F.col(f"bits.{c}").alias(c) for c in ("word", "up", "down")))

    def meet(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        low, high, own = (group.column(c).to_numpy() for c in ("low", "high", "own"))
        a, b = (group.take(np.flatnonzero(own == side[0])) for side in (low, high))
        bits = lambda t: [t.column(c).combine_chunks() for c in ("word", "up", "down")]
        (u, si, ci), (v, sj, cj) = (([t.column(c).to_numpy() for c in ("u", "s", "c")]) for t in (a, b))
        if not (len(u) and len(v)):
            return pa.table({"i": pa.array([], pa.int64()), "j": pa.array([], pa.int64()), "r": pa.array([], pa.float64())})
        top, norm = _corr(_dots(bits(a), bits(b)), group.column("nb")[0].as_py(), si[:, None], sj[None, :], ci[:, None], cj[None, :])
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.where(norm > 1e-12, top / norm, 0.0)
        x, y = np.nonzero(u[:, None] < v[None, :]) if low[0] == high[0] else (k.ravel() for k in np.indices(r.shape))
        return pa.table({"i": np.minimum(u[x], v[y]), "j": np.maximum(u[x], v[y]), "r": r[x, y]})

    kind = units.schema[unit].dataType.simpleString()
    met = rows.groupBy("family", "low", "high").applyInArrow(meet, "i bigint, j bigint, r double")
    return met.select(F.col("i").cast(kind).alias("i"), F.col("j").cast(kind).alias("j"), "r")


def position_corr(packed: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (i, j) with nb and r, of +1/-1 positions on bars, 0 elsewhere; bars are the nb ones that any unit has. Words meet on the pairs alone, and a dot product is a count of bits."""
    both = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.col(y)))
    sums, bars = _stats(packed)
    stats = packed.groupBy("u").agg(*sums)
    a = packed.select(F.col("u").alias("i"), "word", F.col("up").alias("iu"), F.col("down").alias("id"))
    b = packed.select(F.col("u").alias("j"), "word", F.col("up").alias("ju"), F.col("down").alias("jd"))
    met = pairs.select("i", "j").join(a, "i").join(b, ["j", "word"])
    dots = met.groupBy("i", "j").agg(F.sum(both("iu", "ju") + both("id", "jd") - both("iu", "jd") - both("id", "ju")).cast("double").alias("dot"))
    every = pairs.join(dots, ["i", "j"], "left").crossJoin(F.broadcast(bars))  # one row
    for side in "ij":
        every = every.join(stats.select(F.col("u").alias(side), F.col("s").alias(f"s{side}"), F.col("c").alias(f"c{side}")), side)
    top, norm = _corr(F.coalesce("dot", F.lit(0.0)), *(F.col(c) for c in ("nb", "si", "sj", "ci", "cj")), root=F.sqrt)
    return every.select(*pairs.columns, "nb", F.when(norm > 1e-12, top / F.when(norm > 1e-12, norm)).otherwise(F.lit(0.0)).alias("r"))


def random_projection(positions: DataFrame, unit: str = "strategy", bar: str = "bar", value: str = "dir", dims: int = 3) -> DataFrame:
    """unit, e0, e1, ...: sums of positions times a hash of bar and dimension in [-1, 1), made a unit vector."""
    zero = F.lit(0)
    sums = [F.sum(F.col(value) * (rng.uniform(F.col(bar), F.lit(d), zero, zero) * 2 - 1)).alias(f"e{d}") for d in range(dims)]
    out = positions.groupBy(unit).agg(*sums)
    norm = F.sqrt(sum((F.col(f"e{d}") * F.col(f"e{d}") for d in range(dims)), F.lit(0.0)))
    return out.select(unit, *(F.when(norm > 0, F.col(f"e{d}") / F.when(norm > 0, norm)).otherwise(F.lit(0.0)).alias(f"e{d}") for d in range(dims)))


def sample_pairs(units: DataFrame, unit: str, family: str, draws: int, seed: int = 42) -> DataFrame:
    """i, j, same_family, times for i < j: so many draws of pairs within families, which are weighed by their pairs, and as many across, of two families drawn evenly and a member of each.

    A pair drawn again counts again. Families are one row each; draws are the parallel axis.
    """
    zero, one = F.lit(0), F.lit(1)
    members = units.select(F.col(unit).alias("u"), F.col(family).alias("family")).distinct()
    members = members.withColumn("m", F.row_number().over(Window.partitionBy("family").orderBy("u")).cast("bigint") - 1)
    families = members.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
    families = families.withColumns({"f": F.row_number().over(Window.orderBy("family")).cast("bigint") - 1, "pairs": (F.col("size") * (F.col("size") - 1) / 2).cast("bigint")})
    families = families.withColumn("before", F.sum("pairs").over(Window.orderBy("f")) - F.col("pairs"))
    both = families.agg(F.sum("pairs").alias("all_pairs"), F.count(F.lit(1)).alias("n_families"))
    k = units.sparkSession.range(draws).withColumnRenamed("id", "k").crossJoin(F.broadcast(both))  # one row
    x = rng.draw(zero, zero, F.col("k"), F.lit(1), seed) * F.lit(rng.PRIME).cast("bigint") + rng.draw(zero, zero, F.col("k"), F.lit(2), seed)
    within = k.where("all_pairs > 0").withColumn("x", x % F.col("all_pairs")).join(families, (F.col("x") >= F.col("before")) & (F.col("x") < F.col("before") + F.col("pairs")))
    place = F.col("x") - F.col("before")
    high = F.floor((F.sqrt(place.cast("double") * 8 + 1) + 1) / 2).cast("bigint")
    within = within.select("k", F.col("family").alias("fa"), F.col("family").alias("fb"), (place - (high * (high - 1) / 2).cast("bigint")).alias("a"), high.alias("b"))
    draw = lambda i: rng.draw(zero, one, F.col("k"), F.lit(i), seed)
    cross = k.where("n_families > 1").withColumn("f1", draw(1) % F.col("n_families")).withColumn("f2", (F.col("f1") + 1 + draw(2) % (F.col("n_families") - 1)) % F.col("n_families"))
    for n, i in ((1, 3), (2, 4)):
        cross = cross.join(families.select(F.col("f").alias(f"f{n}"), F.col("family").alias(f"name{n}"), F.col("size").alias(f"size{n}")), f"f{n}").withColumn(f"m{n}", draw(i) % F.col(f"size{n}"))
    cross = cross.select("k", F.col("name1").alias("fa"), F.col("name2").alias("fb"), F.col("m1").alias("a"), F.col("m2").alias("b"))
    drawn = within.unionByName(cross).groupBy("fa", "fb", "a", "b").agg(F.count(F.lit(1)).alias("times"))
    for side in "ab":
        drawn = drawn.join(members.select(F.col("family").alias(f"f{side}"), F.col("m").alias(side), F.col("u").alias(f"u{side}")), [f"f{side}", side])
    pair = drawn.groupBy(F.least("ua", "ub").alias("i"), F.greatest("ua", "ub").alias("j"), (F.col("fa") == F.col("fb")).alias("same_family"))
    return pair.agg(F.sum("times").alias("times"))


def weighted_summary(rows: DataFrame, by: str, x: str, weight: str, cuts: tuple[int, ...], shares: tuple[float, ...]) -> DataFrame:
    """by, n, mean, floor-index percentiles and shares above, of values that count several times. The values of a group are few: those of the drawn pairs."""
    order = Window.partitionBy(by).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"upto": F.sum(weight).over(order), "all_n": F.sum(weight).over(Window.partitionBy(by))})
    w = F.col(weight)
    sums = [F.sum(w).alias("n"), (F.sum(F.col(x) * w) / F.sum(w)).alias("mean")]
    sums += [F.min(F.when(F.col("upto") > F.floor(F.lit(c / 100) * (F.col("all_n") - 1)), F.col(x))).alias(f"p{c}") for c in cuts]
    sums += [(F.sum(F.when(F.col(x) > t, w).otherwise(0)) / F.sum(w)).alias(f"above_{t:g}".replace(".", "")) for t in shares]
    return rows.groupBy(by).agg(*sums)
