"""Column expressions shared by the operators. All stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from surtido.functions.labels import HIGH_SEASON_MONTHS, SYMBOLS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(c: Column | str) -> Column:
    return _col(c).cast("double")


def rnd(c: Column | str, digits: int = 0) -> Column:
    """Round half to even on the binary value.

    ``F.round`` goes through a decimal text per row and rounds halves up;
    ``rint`` is one CPU instruction and has the array-library semantics that
    result tables were defined with.
    """
    c = as_double(c)
    if digits == 0:
        return F.rint(c)
    scale = F.lit(10.0**digits)
    return F.rint(c * scale) / scale


def clip(c: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    """Clamp that keeps NULL (``greatest``/``least`` would skip it)."""
    c = _col(c)
    out = c
    if hi is not None:
        out = F.when(c > hi, F.lit(hi)).otherwise(out)
    if lo is not None:
        out = F.when(c < lo, F.lit(lo)).otherwise(out)
    return out


def guarded_div(num: Column | str, den: Column | str, default: float | None = 0.0) -> Column:
    """``num / den`` where ``den > 0``, else ``default`` (also for a NULL denominator)."""
    num, den = as_double(num), as_double(den)
    return F.when(den > 0, num / den).otherwise(F.lit(default).cast("double"))


def non_zero(c: Column | str) -> Column:
    """NULL instead of 0, for a denominator under ANSI division."""
    return F.nullif(as_double(c), F.lit(0.0))


def classify(c: Column | str, ladder: Sequence[tuple[float, str]], default: str) -> Column:
    """First label whose threshold is reached; NULL falls to ``default``."""
    c = _col(c)
    out = None
    for threshold, label in ladder:
        hit = c >= threshold
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def min_max(c: Column | str, lo: Column, hi: Column) -> Column:
    """Min-max scaling with the 0.01 guard of the index formulas."""
    return (_col(c) - lo) / (hi - lo + F.lit(0.01))


def lookup(c: Column | str, table: Mapping, default) -> Column:
    """Small fixed key -> value table as a ``when`` chain."""
    c = _col(c)
    out = None
    for key, value in table.items():
        out = F.when(c == key, F.lit(value)) if out is None else out.when(c == key, F.lit(value))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def iso_week_key(d: Column | str, calendar_year: bool = False) -> tuple[Column, Column]:
    """(year, week) columns. ISO year by default, so that a week around New Year
    stays whole; ``calendar_year=True`` pairs the ISO week with the calendar year."""
    d = _col(d)
    year = F.year(d) if calendar_year else F.extract(F.lit("YEAROFWEEK"), d)
    return year.cast("int"), F.weekofyear(d).cast("int")


def high_season(d: Column | str) -> Column:
    return F.month(_col(d)).isin(*HIGH_SEASON_MONTHS)


def strip_symbols(c: Column | str) -> Column:
    """Label text without its leading pictogram."""
    return F.trim(F.regexp_replace(_col(c), f"[{SYMBOLS}]", ""))
