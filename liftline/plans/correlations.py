"""Correlation queries: vectors as units with a value for each window, labels as families; line items as sparse positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftline.functions.rng import PRIME, draw_sql
from liftline.operators import correlation, gram, resample
from liftline.plans.given import PANEL_SQL, strategies, table
from liftline.plans.series import _BARS, positions
from liftline.scratch import settle
from liftline.session import ship

QUERIES: dict = {}
ORACLES: dict = {}
PER_FAMILY, WINDOWS = 40, 64


def _register(name: str, sql: str | None):  # noqa: ANN202
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of a sample of at most PER_FAMILY for each family, one row for each window."""
    rows = resample.sample_per_group(table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL AND vec_id IS NOT NULL"), ["label"], PER_FAMILY, "vec_id")
    long = rows.select("vec_id", "label", F.posexplode("embedding").alias("window_i", "x"))
    return correlation.with_support(long, "vec_id", "x", WINDOWS)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation.pair_corr(_values(spark, sf_dir), "vec_id", "window_i", "x", "label")


_PAIRS = f"""WITH picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {draw_sql('vec_id::BIGINT', '0::BIGINT', '0::BIGINT', '0::BIGINT')}, vec_id) AS r FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL) WHERE r <= {PER_FAMILY}),
vals AS (SELECT vec_id, label, unnest(range(len(embedding)))::INTEGER AS window_i, unnest(embedding)::DOUBLE AS x FROM picked),
pairs AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label AS family_i, b.label AS family_j, count(*) AS n, corr(a.x, b.x) AS r FROM vals a JOIN vals b ON a.window_i = b.window_i AND a.vec_id < b.vec_id GROUP BY ALL)"""


@_register("pair_corr", f"{_PAIRS} SELECT i, j, family_i, family_j, n, round(r, 6) AS r FROM pairs")
def pair_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).withColumn("r", F.round("r", 6))


_ALL_PAIRS = """WITH vals AS (SELECT vec_id, label, unnest(range(len(embedding)))::INTEGER AS window_i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
exact AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label AS family_i, b.label AS family_j, count(*) AS n, corr(a.x, b.x) AS r FROM vals a JOIN vals b ON a.window_i = b.window_i AND a.vec_id < b.vec_id GROUP BY ALL),
pairs AS (SELECT * REPLACE (round(r, 9) AS r) FROM exact)"""


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL AND vec_id IS NOT NULL").select("vec_id", "label", "embedding")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return gram.blocks_of(_units(spark, sf_dir), "vec_id", "label", "embedding", WINDOWS)


@_register("pair_corr_summary", f"{_ALL_PAIRS} SELECT family_i = family_j AS same_family, count(*) AS pairs, round(avg(r), 6) AS mean, round(median(r), 6) AS median, round(avg((r > 0.7)::INT::DOUBLE) * 100, 6) AS above_07_pct, round(avg(abs(r)), 6) AS mean_abs, round(avg(sqrt(2.0::DOUBLE / (pi() * n))), 6) AS null_abs FROM pairs GROUP BY 1")
def pair_corr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All units' pairs, within families and across; the pairs are tallied and never made rows."""
    blocks = _blocks(spark, sf_dir)
    sums, digits = gram.moments_and_digits(blocks, WINDOWS, 0.7)
    middle = sums.select("same_family", F.explode(F.array(F.floor((F.col("pairs") - 1) / 2), F.ceil((F.col("pairs") - 1) / 2))).alias("place"))
    medians = gram.ranked(blocks, WINDOWS, middle.distinct(), digits=digits).groupBy("same_family").agg(F.avg("r").alias("median"))
    out = sums.join(medians, "same_family").withColumn("above_07_pct", F.col("above") * 100)
    return out.select("same_family", "pairs", *(F.round(c, 6).alias(c) for c in ("mean", "median", "above_07_pct", "mean_abs", "null_abs")))


_CUTS = (50, 90, 95, 99)


@_register("pair_corr_percentiles", f"{_ALL_PAIRS}, s AS (SELECT family_i = family_j AS same_family, abs(r) AS r FROM pairs), o AS (SELECT same_family, list_sort(list(r)) AS v, count(*) AS n, avg(r) AS mean FROM s GROUP BY 1) SELECT same_family, {', '.join(f'round(v[floor({c / 100!r}::DOUBLE * (n - 1))::BIGINT + 1], 6) AS p{c}' for c in _CUTS)}, round(mean - sqrt(2.0::DOUBLE / (pi() * {WINDOWS})), 6) AS excess, round(len([x FOR x IN v IF x > 0.2])::DOUBLE / n, 6) AS above_02 FROM o")
def pair_corr_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floor-index percentiles of |r|, its mean over the null's, and the share above 0.2, over all units' pairs."""
    blocks = _blocks(spark, sf_dir)
    sums, digits = gram.moments_and_digits(blocks, WINDOWS, 0.2, of_abs=True)
    places = sums.select("same_family", F.inline(F.array(*(F.struct(F.lit(f"p{c}").alias("cut"), F.floor(F.lit(c / 100) * (F.col("pairs") - 1)).alias("place")) for c in _CUTS))))
    found = places.join(gram.ranked(blocks, WINDOWS, places.select("same_family", "place").distinct(), of_abs=True, digits=digits), ["same_family", "place"])
    cuts = found.groupBy("same_family").agg(*(F.round(F.max(F.when(F.col("cut") == f"p{c}", F.col("r"))), 6).alias(f"p{c}") for c in _CUTS))
    return sums.join(cuts, "same_family").select("same_family", *(f"p{c}" for c in _CUTS), F.round(F.col("mean_abs") - correlation.null_abs_corr(F.lit(WINDOWS)), 6).alias("excess"), F.round("above", 6).alias("above_02"))


def _bins_sql(bins: int) -> str:
    return f"least((round(r * {gram.SCALE})::BIGINT + {gram.SCALE}) * {bins} // {2 * gram.SCALE}, {bins - 1})"


@_register("corr_histogram", f"{_ALL_PAIRS} SELECT b.bin, count(r) AS n FROM (SELECT unnest(range(200))::INTEGER AS bin) b LEFT JOIN pairs ON {_bins_sql(200)} = b.bin GROUP BY b.bin")
def corr_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gram.histogram(_blocks(spark, sf_dir), WINDOWS, 200)


_MEANS = "SELECT family_i, family_j, count(*) AS pairs, avg(r) AS mean_r FROM (SELECT family_i, family_j, r FROM exact UNION ALL SELECT family_j, family_i, r FROM exact WHERE family_i <> family_j) GROUP BY ALL"


def _family_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gram.family_means(_units(spark, sf_dir), "label", "embedding", WINDOWS).withColumn("mean_r", F.round("mean_r", 6))


@_register("family_mean_corr", f"{_ALL_PAIRS} SELECT family_i, family_j, pairs, round(mean_r, 6) AS mean_r FROM ({_MEANS})")
def family_mean_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all units, from the families' summed vectors."""
    return _family_means(spark, sf_dir)


@_register("family_corr_matrix", f"{_ALL_PAIRS}, m AS ({_MEANS}) SELECT family_i, {', '.join(f'coalesce(round(max(mean_r) FILTER (WHERE family_j = {k}), 6), 0) AS f{k}' for k in range(10))} FROM m GROUP BY family_i")
def family_corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation.as_matrix(_family_means(spark, sf_dir), list(range(10)))


@_register("family_window_corr", "WITH v AS (SELECT label, unnest(range(len(embedding)))::INTEGER AS w, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, w, avg(x) AS x FROM v GROUP BY ALL) SELECT a.label AS i, b.label AS j, count(*) AS n, round(corr(a.x, b.x), 6) AS r FROM m a JOIN m b ON a.w = b.w AND a.label < b.label GROUP BY ALL")
def family_window_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families' means by window, correlated across windows."""
    long = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("w", "x"))
    means = long.groupBy("label", "w").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return correlation.pair_corr(means, "label", "w", "x", "label").select("i", "j", "n", F.round("r", 6).alias("r"))


_SPARSE = f"""{PANEL_SQL}, {_BARS}, st AS (SELECT strategy, family, sum(dir)::DOUBLE AS s, count(*)::DOUBLE AS c FROM bars JOIN strategies USING (strategy) GROUP BY ALL), nb AS (SELECT count(DISTINCT bar)::DOUBLE AS nb FROM bars),
dots AS (SELECT a.strategy AS i, b.strategy AS j, sum(a.dir * b.dir)::DOUBLE AS dot FROM bars a JOIN bars b ON a.bar = b.bar AND a.strategy < b.strategy GROUP BY ALL)"""


def _members(spark: SparkSession, sf_dir: str, packed: DataFrame) -> DataFrame:
    """Strategies with a position, and their families."""
    return strategies(spark, sf_dir).join(packed.select(F.col("u").alias("strategy")).distinct(), "strategy", "left_semi")


@_register("sparse_corr", f"{_SPARSE} SELECT a.strategy AS i, b.strategy AS j, round((coalesce(dot, 0) - a.s * b.s / nb) / sqrt((a.c - a.s * a.s / nb) * (b.c - b.s * b.s / nb)), 6) AS r FROM st a JOIN st b ON a.strategy < b.strategy AND a.family = b.family LEFT JOIN dots ON dots.i = a.strategy AND dots.j = b.strategy, nb")
def sparse_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of the sparse positions of all pairs of strategies of one family."""
    ship(spark)
    packed = settle(correlation.packed_positions(positions(spark, sf_dir)))
    return correlation.family_corr(packed, strategies(spark, sf_dir), "strategy", "family").select("i", "j", F.round("r", 6).alias("r"))


_E = ", ".join(f"sum(dir * ({draw_sql('bar::BIGINT', f'{d}::BIGINT', '0::BIGINT', '0::BIGINT')} / {float(PRIME)}::DOUBLE * 2 - 1)) AS e{d}" for d in range(3))


@_register("random_projection", f"WITH {_BARS}, e AS (SELECT strategy, {_E} FROM bars GROUP BY strategy) SELECT strategy, {', '.join(f'round(e{d} / sqrt(e0 * e0 + e1 * e1 + e2 * e2), 6) AS e{d}' for d in range(3))} FROM e")
def random_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = correlation.random_projection(positions(spark, sf_dir))
    return out.select("strategy", *(F.round(f"e{d}", 6).alias(f"e{d}") for d in range(3)))


DRAWS, PICKS = 20, 10


@_register("draw_pair_corr", f"{_ALL_PAIRS}, u AS (SELECT DISTINCT vec_id FROM vals), d AS (SELECT draw, vec_id FROM (SELECT draw, vec_id, row_number() OVER (PARTITION BY draw ORDER BY {draw_sql('vec_id::BIGINT', '1::BIGINT', 'draw::BIGINT', '0::BIGINT')}, vec_id) AS k FROM u, (SELECT unnest(range({DRAWS})) AS draw)) WHERE k <= {PICKS}) SELECT a.draw, count(*) AS pairs, round(avg(r), 6) AS mean_r FROM d a JOIN d b ON a.draw = b.draw AND a.vec_id < b.vec_id JOIN pairs ON pairs.i = a.vec_id AND pairs.j = b.vec_id GROUP BY a.draw")
def draw_pair_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean pairwise correlation within random draws of ten series."""
    from pyspark.sql import Window

    from liftline.functions.rng import draw

    values = _units(spark, sf_dir).select("vec_id", F.posexplode("embedding").alias("window_i", "x"))
    units = _units(spark, sf_dir).select("vec_id").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(DRAWS - 1).cast("bigint"))))
    keyed = units.withColumn("key", draw(F.col("vec_id"), F.lit(1), F.col("draw"), F.lit(0)))
    picked = keyed.withColumn("k", F.row_number().over(Window.partitionBy("draw").orderBy("key", "vec_id"))).where(F.col("k") <= PICKS).select("draw", "vec_id")
    long = picked.join(values, "vec_id")
    a = long.select("draw", "window_i", F.col("vec_id").alias("i"), F.col("x").cast("double").alias("x"))
    b = long.select("draw", "window_i", F.col("vec_id").alias("j"), F.col("x").cast("double").alias("y"))
    pairs = a.join(b, ["draw", "window_i"]).where("i < j").groupBy("draw", "i", "j").agg(correlation.safe_corr(F.col("x"), F.col("y")).alias("r"))
    return pairs.groupBy("draw").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("r"), 6).alias("mean_r"))


#: Draws of each kind.
PAIR_DRAWS = 500_000
_D = lambda unit, window, i: draw_sql(f"{unit}::BIGINT", f"{window}::BIGINT", "k::BIGINT", f"{i}::BIGINT")
_SAMPLED = f"""{PANEL_SQL}, {_BARS}, units AS (SELECT DISTINCT s.strategy AS u, s.family FROM bars JOIN strategies s USING (strategy)),
members AS (SELECT u, family, row_number() OVER (PARTITION BY family ORDER BY u) - 1 AS m FROM units),
fam0 AS (SELECT family, count(*) AS size, (count(*) * (count(*) - 1) // 2)::BIGINT AS pairs FROM members GROUP BY family),
fam AS (SELECT *, row_number() OVER (ORDER BY family) - 1 AS f, (sum(pairs) OVER (ORDER BY family) - pairs)::BIGINT AS before FROM fam0),
tot AS (SELECT sum(pairs)::BIGINT AS all_pairs, count(*) AS nf FROM fam), ks AS (SELECT * FROM (SELECT unnest(range({PAIR_DRAWS})) AS k), tot),
wx AS (SELECT ({_D(0, 0, 1)} * {PRIME}::BIGINT + {_D(0, 0, 2)}) % all_pairs AS x FROM ks WHERE all_pairs > 0),
wp AS (SELECT family, x - before AS p, floor((sqrt((x - before)::DOUBLE * 8 + 1) + 1) / 2)::BIGINT AS b FROM wx JOIN fam ON x >= before AND x < before + pairs),
cx AS (SELECT k, {_D(0, 1, 1)} % nf AS f1, ({_D(0, 1, 1)} % nf + 1 + {_D(0, 1, 2)} % (nf - 1)) % nf AS f2 FROM ks WHERE nf > 1),
drawn AS (SELECT family AS fa, family AS fb, p - (b * (b - 1) // 2) AS a, b FROM wp UNION ALL SELECT x.family, y.family, {_D(0, 1, 3)} % x.size, {_D(0, 1, 4)} % y.size FROM cx JOIN fam x ON x.f = f1 JOIN fam y ON y.f = f2),
sampled AS (SELECT least(x.u, y.u) AS i, greatest(x.u, y.u) AS j, fa = fb AS same_family, count(*) AS times FROM drawn JOIN members x ON x.family = fa AND x.m = a JOIN members y ON y.family = fb AND y.m = b GROUP BY ALL),
st AS (SELECT strategy, sum(dir)::DOUBLE AS s, count(*)::DOUBLE AS c FROM bars GROUP BY strategy), nb AS (SELECT count(DISTINCT bar)::DOUBLE AS nb FROM bars),
dots AS (SELECT i, j, sum(p.dir * q.dir)::DOUBLE AS dot FROM sampled JOIN bars p ON p.strategy = i JOIN bars q ON q.strategy = j AND q.bar = p.bar GROUP BY i, j),
corrs AS (SELECT i, j, same_family, times, nb, round((coalesce(dot, 0) - a.s * b.s / nb) / sqrt((a.c - a.s * a.s / nb) * (b.c - b.s * b.s / nb)), 9) AS r FROM sampled LEFT JOIN dots USING (i, j) JOIN st a ON a.strategy = i JOIN st b ON b.strategy = j, nb)"""


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = settle(correlation.packed_positions(positions(spark, sf_dir)))
    pairs = settle(correlation.sample_pairs(_members(spark, sf_dir, packed), "strategy", "family", PAIR_DRAWS))
    return correlation.position_corr(packed, pairs).withColumn("r", F.round("r", 9))


@_register("sampled_pair_corr", f"{_SAMPLED} SELECT i, j, same_family, times::BIGINT AS times, round(r, 6) AS r FROM corrs")
def sampled_pair_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn pairs of all strategies, within families and across, with the correlation of their positions."""
    return _sampled(spark, sf_dir).select("i", "j", "same_family", "times", F.round("r", 6).alias("r"))


def _summary_sql(x: str, excess: str) -> str:
    cuts = ", ".join(f"round(min(x) FILTER (WHERE upto > floor({c / 100!r}::DOUBLE * (all_n - 1))), 6) AS p{c}" for c in _CUTS)
    shares = ", ".join(f"round(sum(CASE WHEN x > {t} THEN times ELSE 0 END)::DOUBLE / sum(times), 6) AS {n}" for t, n in ((0.1, "above_01"), (0.2, "above_02"), (0.5, "above_05")))
    return f"""{_SAMPLED}, o AS (SELECT *, sum(times) OVER (PARTITION BY same_family ORDER BY x ROWS UNBOUNDED PRECEDING) AS upto, sum(times) OVER (PARTITION BY same_family) AS all_n FROM (SELECT *, {x} AS x FROM corrs))
SELECT same_family, sum(times)::BIGINT AS n, round(sum(x * times) / sum(times), 6) AS mean, {cuts}, {shares}{excess} FROM o GROUP BY same_family"""


def _summary(rows: DataFrame) -> DataFrame:
    out = correlation.weighted_summary(rows, "same_family", "x", "times", _CUTS, (0.1, 0.2, 0.5))
    return out.select("same_family", "n", *(F.round(c, 6).alias(c) for c in out.columns[2:]))


@_register("sampled_pair_summary", _summary_sql("r", ""))
def sampled_pair_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(_sampled(spark, sf_dir).withColumn("x", F.col("r")))


@_register("sampled_abs_summary", _summary_sql("abs(r)", ", round(sum(abs(r) * times) / sum(times) - max(sqrt(2.0::DOUBLE / (pi() * nb))), 6) AS excess"))
def sampled_abs_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of |r|, with the mean's excess over that of independent series."""
    rows = _sampled(spark, sf_dir).withColumn("x", F.abs("r"))
    null = rows.groupBy("same_family").agg((F.sum(F.col("x") * F.col("times")) / F.sum("times") - F.max(correlation.null_abs_corr(F.col("nb")))).alias("excess"))
    return _summary(rows).join(null, "same_family").withColumn("excess", F.round("excess", 6))


@_register("corr_density", f"{_ALL_PAIRS}, c AS (SELECT {_bins_sql(79)}::INTEGER AS bin, count(*) AS n FROM pairs GROUP BY 1) SELECT b.bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / ((SELECT sum(n) FROM c) * (2.0::DOUBLE / 79)), 6) AS density FROM (SELECT unnest(range(79))::INTEGER AS bin) b LEFT JOIN c USING (bin)")
def corr_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """79 bins on [-1, 1], normalised to an area of 1."""
    counts = settle(gram.histogram(_blocks(spark, sf_dir), WINDOWS, 79))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("bin", "n", F.round(F.col("n") / (F.col("total") * F.lit(2.0 / 79)), 6).alias("density"))  # one row
