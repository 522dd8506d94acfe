"""Lift tables: every filter registry, grouping and baseline of the evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftline.functions.expressions import family_by_prefix, ratio
from liftline.operators.lift import GATE, FilterSet, all_filters, lift, rank_filters, ranking, robustness_filters
from liftline.plans.given import ASSET_CLASS, PANEL_SQL, lift_sql, panel

QUERIES: dict = {}
ORACLES: dict = {}
ROUND = 6


def _rounded(df: DataFrame) -> DataFrame:
    """Rates to ROUND places, for comparisons across engines."""
    return df.select(*(F.round(c, ROUND).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _sql_rounded(sql: str, columns: str) -> str:
    rates = ("pass_pct", "fail_pct", "base_pct", "lift_pp")
    listed = ", ".join(f"round({c}, {ROUND}) AS {c}" if c in rates else c for c in columns.split(", "))
    return f"{PANEL_SQL} SELECT {listed} FROM ({sql})"


_COLUMNS = "ord, filter, n_pass, n_fail, pass_pct, fail_pct, base_pct, lift_pp"


def _add(name: str, filters: dict[str, str], outcome: str, by: tuple[str, ...], against: dict[str, str] | None = None, where: str | None = None, **more: object) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = panel(spark, sf_dir)
        rows = rows.where(where) if where else rows
        return _rounded(lift(rows, outcome, FilterSet(filters, against), by, **more))

    source = f"(SELECT * FROM panel WHERE {where})" if where else "panel"
    QUERIES[name] = query
    ORACLES[name] = _sql_rounded(lift_sql(filters, outcome, by, against, source, **more), ", ".join([*by, _COLUMNS]))


_ASSET = ("asset",)
_add("lift_gate_by_asset", {"IS PF > 1": GATE}, "next_hit", _ASSET)
_add("next_oos_filters", rank_filters(), "next_hit", _ASSET)
_add("pass_fail", rank_filters() | {"IS PF > 1": GATE}, "next_hit", _ASSET, complement="not")
_add("rank_below_threshold", rank_filters(), "next_hit", _ASSET, complement="below")
_add("all_filters", all_filters(), "oos_hit", _ASSET)
_add("robustness_filters", robustness_filters() | {"IS PF > 1": GATE}, "oos_hit", _ASSET)
_blocks = {"Baseline": "true", "A: MC ROI >= 50": "roi_rank >= 50", "A: MC PF >= 50": "pf_rank >= 50", "B: gate": GATE, "B: gate + MC ROI >= 50": f"{GATE} AND roi_rank >= 50", "B: gate + Rob all": robustness_filters()["Rob all"]}
_add("fair_blocks", _blocks, "oos_hit", _ASSET, against={n: "B: gate" for n in _blocks if n.startswith("B: gate +")})
_add("lift_by_family", {"MC ROI >= 50": "roi_rank >= 50", "IS PF > 1": GATE}, "next_hit", ("family",), where="asset IN ('AMERICA', 'ASIA', 'EUROPE')")
_add("window_lift", {"MC ROI >= 50": "roi_rank >= 50", "IS PF > 1": GATE}, "next_hit", ("asset", "window_i"), min_pass=6, min_rows=10)
_add("pooled_lift", all_filters(), "next_hit", ())
_add("headline", {"None": "true", "IS PF > 1": GATE, "Rob all": robustness_filters()["Rob all"], "MC ROI >= 50": "roi_rank >= 50", "MC ROI >= 50 + gate": f"roi_rank >= 50 AND {GATE}"}, "oos_hit", _ASSET)
_add("cost_levels", {"baseline PF > 1": GATE, "fee PF > 1": "fee_pf > 1.0", "baseline PF > 1 + MC": f"{GATE} AND roi_rank >= 50", "fee PF > 1 + MC": "fee_pf > 1.0 AND roi_rank >= 50"}, "oos_hit", _ASSET, against={"baseline PF > 1 + MC": "baseline PF > 1", "fee PF > 1 + MC": "fee PF > 1"})
_sweep = {f"{kind} {t:.2f}": f"pf > {t}{more}" for t in (0.90, 0.95, 1.00, 1.05, 1.10, 1.20) for kind, more in (("PF", ""), ("PF + MC", " AND roi_rank >= 50"))}
_add("cost_sweep", _sweep, "oos_hit", _ASSET, against={f"PF + MC {t:.2f}": f"PF {t:.2f}" for t in (0.90, 0.95, 1.00, 1.05, 1.10, 1.20)})
#: Half-open bins, the last without an end.
PF_BINS = ((0.0, 0.5), (0.5, 0.8), (0.8, 1.0), (1.0, 1.25), (1.25, 2.0), (2.0, None))
_bins = {f"[{a}, {'inf' if b is None else b})": f"pf >= {a}" + (f" AND pf < {b}" if b is not None else "") for a, b in PF_BINS}
_add("pf_strata", _bins | {f"{n} + MC": f"{p} AND roi_rank >= 50" for n, p in _bins.items()}, "oos_hit", (), against={f"{n} + MC": n for n in _bins}, min_pass=1)


#: Of nations' names; the longest that fits names the family, the others are OTHER.
NAMED = ("NATION_1", "NATION_2", "NATION_21")


def lift_by_named_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lift by family of the name's longest known prefix; OTHER is measured with the rest and dropped after."""
    rows = panel(spark, sf_dir).withColumn("family", family_by_prefix(F.col("family"), NAMED))
    return _rounded(lift(rows, "next_hit", FilterSet({"MC ROI >= 50": "roi_rank >= 50"}), ("family",))).where("family <> 'OTHER'")


QUERIES["lift_by_named_family"] = lift_by_named_family
_NAMED_SQL = "(SELECT * REPLACE (CASE " + " ".join(f"WHEN starts_with(upper(family), '{p}') THEN '{p}'" for p in sorted(NAMED, key=lambda p: (-len(p), p))) + " ELSE 'OTHER' END AS family) FROM panel)"
ORACLES["lift_by_named_family"] = _sql_rounded(lift_sql({"MC ROI >= 50": "roi_rank >= 50"}, "next_hit", ("family",), source=_NAMED_SQL), "family, " + _COLUMNS) + " WHERE family <> 'OTHER'"


def filter_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters by their mean lift over assets."""
    return ranking(lift(panel(spark, sf_dir), "oos_hit", FilterSet(all_filters()), ["asset"]), places=4)


QUERIES["filter_ranking"] = filter_ranking
ORACLES["filter_ranking"] = f"{PANEL_SQL} SELECT filter, round(avg(pass_pct), 4) AS pass_pct, round(avg(lift_pp), 4) AS lift_pp, round(avg(base_pct), 4) AS base_pct FROM ({lift_sql(all_filters(), 'oos_hit', _ASSET)}) GROUP BY filter ORDER BY lift_pp DESC, filter"


def selection_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-sample against out-of-sample means of capped profit factors, by whether the rank passes; ratio of the means."""
    rows = panel(spark, sf_dir).where("pf > 1.0 AND oos_n_trades >= 10 AND oos_pf IS NOT NULL")
    rows = rows.groupBy("asset", (F.col("roi_rank") >= 50).alias("mc_pass")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.least("pf", F.lit(5.0))).alias("is_pf"), F.avg(F.least("oos_pf", F.lit(5.0))).alias("oos_pf"))
    return _rounded(rows.withColumn("kept", ratio(F.col("oos_pf"), F.col("is_pf"))))


QUERIES["selection_bias"] = selection_bias
ORACLES["selection_bias"] = f"""{PANEL_SQL}, m AS (
    SELECT asset, roi_rank >= 50 AS mc_pass, count(*) AS n, avg(least(pf, 5.0::DOUBLE)) AS is_pf, avg(least(oos_pf, 5.0::DOUBLE)) AS oos_pf
    FROM panel WHERE pf > 1.0 AND oos_n_trades >= 10 AND oos_pf IS NOT NULL GROUP BY ALL)
SELECT asset, mc_pass, n, round(is_pf, {ROUND}) AS is_pf, round(oos_pf, {ROUND}) AS oos_pf, round(oos_pf / is_pf, {ROUND}) AS kept FROM m"""

_SWEEP_COLUMNS = ("roi_rank", "sharpe_rank", "pf_rank")


def _classes() -> F.Column:
    return F.coalesce(*(F.when(F.col("asset") == a, F.lit(c)) for a, c in ASSET_CLASS.items()))


def block_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank columns unpivoted: pass rate, outcome among passing and failing, lift and strategies, by asset and method."""
    long = panel(spark, sf_dir).where("next_hit IS NOT NULL").unpivot(["asset", "strategy", "next_hit"], list(_SWEEP_COLUMNS), "method", "rank")
    passed = F.col("rank") >= 50
    out = long.groupBy("asset", "method").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("strategy").alias("strategies"), F.avg(passed.cast("double")).alias("pass_share"), F.avg(F.when(passed, F.col("next_hit"))).alias("pass_hit"), F.avg(F.when(~passed, F.col("next_hit"))).alias("fail_hit"), F.avg("next_hit").alias("base_hit"))
    return _rounded(out.withColumn("lift", F.col("pass_hit") - F.col("base_hit")))


QUERIES["block_sweep"] = block_sweep
_LONG_SQL = f"{PANEL_SQL}, long AS (" + " UNION ALL ".join(f"SELECT asset, strategy, next_hit, '{c}' AS method, {c} AS rank FROM panel WHERE next_hit IS NOT NULL" for c in _SWEEP_COLUMNS) + ")"
ORACLES["block_sweep"] = f"""{_LONG_SQL}
SELECT asset, method, count(*) AS n, count(DISTINCT strategy) AS strategies, round(avg((rank >= 50)::INT::DOUBLE), {ROUND}) AS pass_share,
       round(avg(next_hit) FILTER (WHERE rank >= 50), {ROUND}) AS pass_hit, round(avg(next_hit) FILTER (WHERE NOT rank >= 50), {ROUND}) AS fail_hit,
       round(avg(next_hit), {ROUND}) AS base_hit, round(avg(next_hit) FILTER (WHERE rank >= 50) - avg(next_hit), {ROUND}) AS lift
FROM long GROUP BY asset, method"""


def grouping_sets_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep pooled and by class in one pass over grouping sets."""
    rows = panel(spark, sf_dir).where("next_hit IS NOT NULL").withColumn("class", _classes())
    long = rows.unpivot(["class", "next_hit"], list(_SWEEP_COLUMNS), "method", "rank")
    sets = long.groupingSets([["method"], ["method", "class"]], "method", "class")
    out = sets.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("rank") >= 50, F.col("next_hit"))).alias("pass_hit"), F.avg("next_hit").alias("base_hit"))
    return _rounded(out.select(F.col("method"), F.coalesce("class", F.lit("All")).alias("class"), "n", "pass_hit", "base_hit"))


QUERIES["grouping_sets_sweep"] = grouping_sets_sweep
_CASE = "CASE " + " ".join(f"WHEN asset = '{a}' THEN '{c}'" for a, c in ASSET_CLASS.items()) + " END"
ORACLES["grouping_sets_sweep"] = f"""{_LONG_SQL}
SELECT method, coalesce(class, 'All') AS class, count(*) AS n, round(avg(next_hit) FILTER (WHERE rank >= 50), {ROUND}) AS pass_hit, round(avg(next_hit), {ROUND}) AS base_hit
FROM (SELECT *, {_CASE} AS class FROM long) GROUP BY GROUPING SETS ((method), (method, class))"""


def sweep_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Method by asset lifts as a matrix with the row's mean."""
    assets = sorted(ASSET_CLASS)
    wide = block_sweep(spark, sf_dir).groupBy("method").pivot("asset", assets).agg(F.first("lift"))
    mean = sum((F.col(f"`{a}`") for a in assets), F.lit(0.0)) / len(assets)
    return wide.select("method", *(F.col(f"`{a}`").alias(a.lower().replace(" ", "_")) for a in assets), F.round(mean, 4).alias("mean"))


QUERIES["sweep_matrix"] = sweep_matrix
ORACLES["sweep_matrix"] = f"SELECT method, {', '.join(f'max(lift) FILTER (WHERE asset = {a!r}) AS {a.lower().replace(chr(32), chr(95))}' for a in sorted(ASSET_CLASS))}, round((0.0::DOUBLE + {' + '.join(f'max(lift) FILTER (WHERE asset = {a!r})' for a in sorted(ASSET_CLASS))}) / {len(ASSET_CLASS)}, 4) AS mean FROM ({ORACLES['block_sweep']}) GROUP BY method"


def top_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifteen of the ranking."""
    return filter_ranking(spark, sf_dir).limit(15)


QUERIES["top_filters"] = top_filters
ORACLES["top_filters"] = ORACLES["filter_ranking"] + " LIMIT 15"


def sweep_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweeps by asset and by class in one table; what one side lacks is null."""
    return block_sweep(spark, sf_dir).unionByName(grouping_sets_sweep(spark, sf_dir), allowMissingColumns=True)


QUERIES["sweep_union"] = sweep_union
ORACLES["sweep_union"] = f"SELECT * FROM ({ORACLES['block_sweep']}) UNION ALL BY NAME SELECT * FROM ({ORACLES['grouping_sets_sweep']})"


def selection_bias_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection bias with measures as rows and assets as columns."""
    long = selection_bias(spark, sf_dir).unpivot(["asset", "mc_pass"], ["is_pf", "oos_pf", "kept"], "measure", "x")
    wide = long.groupBy("measure", "mc_pass").pivot("asset", sorted(ASSET_CLASS)).agg(F.first("x"))
    return wide.select("measure", "mc_pass", *(F.col(f"`{a}`").alias(a.lower().replace(" ", "_")) for a in sorted(ASSET_CLASS)))


QUERIES["selection_bias_table"] = selection_bias_table
ORACLES["selection_bias_table"] = "SELECT measure, mc_pass, " + ", ".join(f"max(x) FILTER (WHERE asset = {a!r}) AS {a.lower().replace(' ', '_')}" for a in sorted(ASSET_CLASS)) + " FROM (" + " UNION ALL ".join(f"SELECT asset, mc_pass, '{m}' AS measure, {m} AS x FROM ({ORACLES['selection_bias']})" for m in ("is_pf", "oos_pf", "kept")) + ") GROUP BY measure, mc_pass"
