"""Filter sets and lift: outcome rate among rows that pass a filter against a baseline, for all filters in one pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftline.functions.expressions import ratio


class FilterSet:
    """Named predicates in order; each may be measured against another filter's rate instead of the overall one."""

    def __init__(self, filters: dict[str, str], against: dict[str, str] | None = None):
        self.filters, self.against = dict(filters), dict(against or {})
        unknown = set(self.against.values()) - set(self.filters)
        if unknown:
            raise ValueError(f"no such baseline: {sorted(unknown)}")

    def __iter__(self):  # noqa: ANN204
        return iter(self.filters.items())

    def column(self, name: str) -> Column:
        """A missing value fails a filter, as a comparison with it is false."""
        return F.coalesce(F.expr(self.filters[name]), F.lit(False))


#: Column lists of the standard registries; thresholds are inclusive.
RANKS = {"MC ROI": "roi_rank", "MC Sharpe": "sharpe_rank", "MC PF": "pf_rank"}
GATE = "pf > 1.0"


def rank_filters() -> dict[str, str]:
    out = {f"{label} >= {t}": f"{c} >= {t}" for label, c in RANKS.items() for t in (50, 75)}
    return out | {"MC ROI >= 90": "roi_rank >= 90"}


def robustness_filters() -> dict[str, str]:
    single = {f"Rob {s}": f"{GATE} AND {s}_pf > 1.0" for s in ("ent", "fee", "sli", "entind")}
    return single | {"Rob all": " AND ".join([GATE, *(f"{s}_pf > 1.0" for s in ("ent", "fee", "sli", "entind"))])}


def all_filters() -> dict[str, str]:
    ranks = rank_filters()
    return {"None": "true", "IS PF > 1": GATE} | robustness_filters() | ranks | {f"{n} + gate": f"{p} AND {GATE}" for n, p in ranks.items()}


#: Bits of a mask that a BIGINT holds.
_WORD = 62


def _atoms(predicate: str) -> list[str]:
    """The predicates that a conjunction joins; anything else is one."""
    plain = not any(x in predicate.upper() for x in ("(", " OR ", "BETWEEN", "'", "CASE "))
    return [x.strip() for x in predicate.split(" AND ")] if plain else [predicate]


def _words(bits: set[int], n: int) -> list[int]:
    return [sum(1 << (b - k) for b in bits if k <= b < k + _WORD) for k in range(0, max(n, 1), _WORD)]


def lift(panel: DataFrame, outcome: str, filters: FilterSet, by: Sequence[str] = (), min_pass: int = 0, complement: str = "not", min_rows: int = 0) -> DataFrame:
    """by, filter, n_pass, n_fail, pass_pct, fail_pct, base_pct, lift_pp (percent and percentage points).

    Rows without an outcome do not count. ``complement`` is what fails: "not" (all that do not pass) or "below" (rows
    whose predicate is false, not missing). Filters are conjunctions of a few predicates: a row becomes a mask of those
    that hold (for "below" also one of those that are false), rows are counted by group and mask in one pass, and a
    filter's counts are sums over the masks that include its own. Rows with fewer than min_pass passing ones, or of
    groups with fewer than min_rows with an outcome, are left out.
    """
    atoms = list(dict.fromkeys(a for _, p in filters for a in _atoms(p)))
    place = {a: k for k, a in enumerate(atoms)}
    n_words = len(_words(set(), len(atoms)))

    def masks(holds: Callable[[str], Column]) -> list[Column]:
        words = [[F.when(holds(a), F.lit(1 << k)).otherwise(F.lit(0)) for k, a in enumerate(atoms[w * _WORD : (w + 1) * _WORD])] for w in range(n_words)]
        return [sum(x, F.lit(0)).cast("bigint") for x in words]

    columns = {f"yes{w}": c for w, c in enumerate(masks(F.expr))}
    if complement == "below":
        columns |= {f"no{w}": c for w, c in enumerate(masks(lambda a: ~F.expr(a)))}
    rows = panel.where(F.col(outcome).isNotNull()).select(*by, *(c.alias(n) for n, c in columns.items()), F.col(outcome).cast("double").alias("hit"))
    counted = rows.groupBy(*by, *columns).agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))
    if not by:  # one group, also of no rows
        none = panel.sparkSession.range(1).select(*(F.lit(0).cast("bigint").alias(n) for n in columns), F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("hits"))
        counted = counted.unionByName(none)
    own = {name: _words({place[a] for a in _atoms(p)}, len(atoms)) for name, p in filters}
    against = {name: own[filters.against[name]] if name in filters.against else [0] * n_words for name in own}
    array = lambda words: F.array(*(F.lit(w).cast("bigint") for w in words))
    listed = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(name).alias("filter"), array(own[name]).alias("own"), array(against[name]).alias("base")) for i, name in enumerate(own)))
    met = counted.select("*", F.inline(listed))
    all_of = lambda name: reduce(lambda x, y: x & y, (F.col(f"yes{w}").bitwiseAND(F.col(name)[w]) == F.col(name)[w] for w in range(n_words)))
    passed = all_of("own")
    failed = reduce(lambda x, y: x | y, (F.col(f"no{w}").bitwiseAND(F.col("own")[w]) != 0 for w in range(n_words))) if complement == "below" else ~passed
    sums = {"all_n": (F.lit(True), "n"), "n_pass": (passed, "n"), "pass_hits": (passed, "hits"), "n_fail": (failed, "n"), "fail_hits": (failed, "hits"), "n_base": (all_of("base"), "n"), "base_hits": (all_of("base"), "hits")}
    out = met.groupBy(*by, "ord", "filter").agg(*(F.sum(F.when(c, F.col(x)).otherwise(F.lit(0))).alias(n) for n, (c, x) in sums.items()))
    rate = lambda h, n: ratio(F.col(h) * 100.0, F.col(n))
    if min_rows:
        out = out.where(F.col("all_n") >= min_rows)
    if min_pass:
        out = out.where(F.col("n_pass") >= min_pass)
    base = rate("base_hits", "n_base")
    return out.select(*by, "ord", "filter", "n_pass", "n_fail", rate("pass_hits", "n_pass").alias("pass_pct"), rate("fail_hits", "n_fail").alias("fail_pct"), base.alias("base_pct"), (rate("pass_hits", "n_pass") - base).alias("lift_pp"))


def ranking(lifts: DataFrame, places: int = 1) -> DataFrame:
    """Unweighted means over groups by filter, rounded, best lift first."""
    means = lifts.groupBy("filter").agg(*(F.round(F.avg(c), places).alias(c) for c in ("pass_pct", "lift_pp", "base_pct")))
    return means.orderBy(F.col("lift_pp").desc(), "filter")
