"""Lenient casts, safe ratios, normalisation and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def lenient_double(c: Column) -> Column:
    """A number from text; blank, invalid or NaN text is null (NaN would never be dominated and is dropped at the door)."""
    value = blank_to_null(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def lenient_int(c: Column, through_float: bool = False) -> Column:
    """An integer from text; with ``through_float`` "3.7" is 3, without it "3.0" is null."""
    if through_float:
        value = lenient_double(c)
        return F.when(F.abs(value) < 2**31, F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))).cast("int")
    text = blank_to_null(c)
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))


def first_present(df: DataFrame, names: list[str]) -> Column:
    """The first non-blank value among those columns that exist."""
    have = [blank_to_null(F.col(f"`{n}`")) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def ratio_nan(n: Column, d: Column, places: int = 3) -> Column:
    return F.when(d > 0, F.round(n / d, places)).otherwise(F.lit(float("nan")))


def ratio_null(n: Column, d: Column, places: int = 4) -> Column:
    return F.when(d > 0, F.round(n / d, places))


def ratio_zero(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def normalize_high(v: Column, lo: Column, hi: Column) -> Column:
    """(v - lo) / (hi - lo), 1 for a degenerate range."""
    return F.when(hi <= lo, F.lit(1.0)).otherwise((v - lo) / F.nullif(hi - lo, F.lit(0.0)))


def normalize_low(v: Column, lo: Column, hi: Column) -> Column:
    return F.when(hi <= lo, F.lit(1.0)).otherwise((hi - v) / F.nullif(hi - lo, F.lit(0.0)))


def is_close(a: Column, b: Column, relative: float = 1e-9) -> Column:
    return F.abs(a - b) <= relative * F.greatest(F.abs(a), F.abs(b))


def minmax_score(v: Column, lo: Column, hi: Column, higher_is_better: bool) -> Column:
    """Min-max with a relative test of the degenerate range."""
    gap = F.nullif(hi - lo, F.lit(0.0))
    return F.when(is_close(lo, hi), F.lit(1.0)).otherwise((v - lo) / gap if higher_is_better else (hi - v) / gap)


def length_gap(m: Column, target: Column) -> Column:
    return F.abs(m - target)


def length_score(m: Column, target: Column, tolerance: float) -> Column:
    """1 - gap / tolerance, at least 0; null stays null, which greatest() alone would not do."""
    return F.when(m.isNotNull() & target.isNotNull(), F.greatest(F.lit(0.0), 1 - length_gap(m, target) / tolerance))


def window_score(d: Column, preferred: float, maximum: float) -> Column:
    """0 from ``maximum`` on, 1 up to ``preferred``, linear between; tested in that order."""
    width = maximum - preferred
    between = F.lit(0.0) if width <= 1e-6 else F.greatest(F.lit(0.0), (maximum - d) / width)
    return F.when(d >= maximum, F.lit(0.0)).when(d <= preferred, F.lit(1.0)).otherwise(between)


def composite(qed: Column, sa: Column, clash: Column, out: Column) -> Column:
    """Weighted desirability of a design."""
    return 0.40 * qed + 0.35 * F.greatest(F.lit(0.0), (6.5 - sa) / 5.5) + 0.25 * (1 - clash) - 0.30 * out


def composite_extended(base: Column, ph4: Column, w_ph4: float, interaction: Column, w_interaction: float) -> Column:
    """Terms count only with a positive weight and a value."""
    for weight, value in ((w_ph4, ph4), (w_interaction, interaction)):
        if weight > 0:
            base = base + F.coalesce(weight * value, F.lit(0.0))
    return base


def composite_fallback(stored: Column, qed: Column, sa: Column) -> Column:
    """The stored composite, or one without geometry terms."""
    return F.coalesce(lenient_double(stored), F.round(0.40 * qed + 0.35 * F.greatest(F.lit(0.0), (6.5 - sa) / 5.5), 4))


def sweep_composite(diversity: Column, docking: Column, length: Column, runtime: Column) -> Column:
    return 0.35 * diversity + 0.35 * docking + 0.20 * length + 0.10 * runtime


def sa_heuristic(rings: Column, chiral: Column) -> Column:
    return F.least(F.lit(6.5), 2 + 0.25 * rings + 0.6 * chiral)


def round_or_blank(v: Column, places: int = 4) -> Column:
    return F.coalesce(F.round(v, places).cast("string"), F.lit(""))
