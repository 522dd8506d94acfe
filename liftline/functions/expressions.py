"""Columns that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest first, so that the first match is the longest prefix.
FAMILY_PREFIXES = ("RSI_LEVEL", "STOCHK", "EMA", "SMA", "RSI", "MACD", "PPO", "ROC")


def ratio(top: Column, bottom: Column) -> Column:
    """A double, null where the divisor is 0."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def no_nan(x: Column) -> Column:
    """NaN as null: comparisons with NaN are true here, and false where these tables come from."""
    return F.when(~F.isnan(x), x)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def safe_corr(x: Column, y: Column, degenerate: float | None = None) -> Column:
    """Pearson's r over pairs without nulls; a constant side gives ``degenerate``."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return r if degenerate is None else F.coalesce(r, F.lit(float(degenerate)))


def window_number(label: Column) -> Column:
    """W03, w03 or 3 -> 3."""
    return F.regexp_replace(label.cast("string"), "^[Ww]", "").try_cast("int")


def family_by_prefix(name: Column, prefixes: tuple[str, ...] = FAMILY_PREFIXES) -> Column:
    """The longest known prefix of the upper-cased name, else OTHER."""
    upper = F.upper(name)
    return F.coalesce(*(F.when(upper.startswith(p), F.lit(p)) for p in sorted(prefixes, key=lambda p: (-len(p), p))), F.lit("OTHER"))


def family_with_macd(name: Column) -> Column:
    """As by prefix, case as given, with a MACD's parameters: MACD(f;s) or MACD_f_s."""
    f = F.coalesce(F.nullif(F.regexp_extract(name, r"MACD[(_](\d+)[;_]\d+", 1), F.lit("")), F.lit(""))
    s = F.coalesce(F.nullif(F.regexp_extract(name, r"MACD[(_]\d+[;_](\d+)", 1), F.lit("")), F.lit(""))
    return F.when(name.startswith("MACD"), F.when(f != "", F.concat(F.lit("MACD("), f, F.lit(";"), s, F.lit(")"))).otherwise("MACD")).otherwise(family_by_prefix(name))


def family_first_token(name: Column) -> Column:
    return F.substring_index(name, "_", 1)


def profit_factor(won: Column, lost: Column, no_loss: float = 100.0) -> Column:
    """Sum of wins over sum of losses (as a positive number); 1 without either, no_loss (a cap as well) without losses."""
    return F.when(lost == 0, F.when(won == 0, F.lit(1.0)).otherwise(F.lit(float(no_loss)))).otherwise(F.least(ratio(won, lost), F.lit(float(no_loss))))


def sharpe(n: Column, total: Column, squares: Column) -> Column:
    """Mean over population deviation; 0 where the deviation vanishes."""
    mean = ratio(total, n)
    variance = ratio(squares, n) - mean * mean
    return F.when(variance > 1e-24, mean / F.sqrt(F.when(variance > 1e-24, variance))).otherwise(F.lit(0.0))


def phi_of_tier(tier: Column) -> Column:
    """sweep_phi_0.04 -> 0.04."""
    return F.regexp_extract(tier, r"sweep_phi_([0-9.]+)", 1).try_cast("double")


def is_valid_pf(pf: Column, sentinel: float = 900.0) -> Column:
    """Whether a profit factor is a measured one, not the mark for no losses."""
    return finite(pf) & (pf < sentinel)
