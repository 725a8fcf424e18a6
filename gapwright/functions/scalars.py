"""Scalar expressions shared by the operators. All are built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values at or below this have no logarithm (fixed value).
FLOOR = 1e-4


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounding that every engine repeats: the boundary lies off exact halves, on which sums in another order would disagree."""
    c = F.col(c) if isinstance(c, str) else c
    k = float(10**digits)
    return F.floor(c * k + 0.5003) / k


def guarded_log10(v: Column) -> Column:
    """NULL unless v > FLOOR."""
    return F.when(v > FLOOR, F.log10(v))


def inverse_log10(v: Column) -> Column:
    return F.pow(F.lit(10.0), v)


def clipped(v: Column) -> Column:
    """At least FLOOR; NULL stays NULL (greatest() alone would skip it)."""
    return F.when(v.isNotNull(), F.greatest(v, F.lit(FLOOR)))


def day_number(date: Column) -> Column:
    return F.unix_date(date)


def season_of_month(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "DJF").when(month.isin(3, 4, 5), "MAM").when(month.isin(6, 7, 8), "JJA").otherwise("SON")


def season(date: Column) -> Column:
    return season_of_month(F.month(date))


def season_encodings(date: Column) -> tuple[Column, Column]:
    angle = 2 * F.pi() * F.dayofyear(date) / 365.25
    return F.sin(angle), F.cos(angle)


def relative_time(x: Column, start_x: Column, length: Column) -> Column:
    """Whole days from the gap's centre, in half lengths."""
    half = length / 2.0
    return F.floor(x - (start_x + half)) / F.greatest(half, F.lit(1.0))


def gap_id(length: Column, start: Column, prefix: str = "L", width: int = 2) -> Column:
    return F.concat(F.lit(prefix), F.lpad(length.cast("string"), width, "0"), F.lit("_"), F.date_format(start, "yyyyMMdd"))


def gap_class(length: Column) -> Column:
    return F.when(length <= 7, "short").when(length <= 30, "medium").when(length <= 90, "long").otherwise("very_long")


def class_code(length: Column) -> Column:
    """The least length of a gap's class, as real-gap identifiers have it."""
    return F.when(length <= 7, "L001").when(length <= 30, "L010").when(length <= 90, "L031").otherwise("L091")


def seasons_spanned(start: Column, end: Column) -> Column:
    """Seasons of the month starts within the gap, or of its first month if it holds none."""
    first = F.when(F.dayofmonth(start) == 1, start).otherwise(F.trunc(F.add_months(start, 1), "month"))
    starts = F.when(first <= end, F.sequence(first, end, F.expr("interval 1 month")))
    names = F.array_distinct(F.transform(starts, lambda d: season(d)))
    return F.coalesce(F.array_join(names, "/"), season(start))


#: Gap lengths that were validated (fixed values).
VALIDATED = (1, 3, 7, 14, 30)


def nearest_lengths(length: Column) -> Column:
    grid = F.array(*[F.lit(v) for v in VALIDATED])
    below = F.array_max(F.filter(grid, lambda v: v < length))
    above = F.array_min(F.filter(grid, lambda v: v > length))
    text = F.concat(F.coalesce(below.cast("string"), F.lit("?")), F.lit("–"), F.coalesce(above.cast("string"), F.lit("?")))
    return F.when(length.isin(*VALIDATED), length.cast("string")).otherwise(text)


def extrapolation(length: Column) -> Column:
    return F.when(length.isin(*VALIDATED), "no").when(length > 30, "yes").otherwise("interpolation_within_range")


def required_context(length: Column) -> Column:
    return F.when(length <= 30, 30).otherwise(60)


def support_role(length: Column) -> Column:
    return F.when(length <= 30, "primary").otherwise("exploratory_extended")


#: Rule to (longest for the first method, longest for the second) (fixed values).
ROUTES = {"D": (3, 29), "C": (3, 13)}


def route(length: Column, rule: str = "D") -> Column:
    if rule not in ROUTES:
        raise ValueError(f"unknown rule {rule!r}")
    low, high = ROUTES[rule]
    return F.when(length <= low, "gaussian_process").when(length <= high, "kalman").otherwise("gap_edge")


def difference_class(ours: Column, theirs: Column, tolerance: Column) -> Column:
    gap = F.abs(ours - theirs)
    return (
        F.when(ours.isNull() | theirs.isNull(), "unavailable").when(gap == 0, "exact").when(gap < 1e-9, "numerically_equal")
        .when(gap < tolerance, "within_tolerance").otherwise("mismatched")
    )


def id_digest(ids: Column) -> Column:
    """SHA-256 of a sorted list of identifiers (an aggregate over a bounded pool)."""
    return F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(ids))), 256)


def fraction(x: Column, x0: Column, x1: Column) -> Column:
    return F.try_divide((x - x0).cast("double"), (x1 - x0).cast("double"))


def picked(seed: str, *parts: Column, modulo: Column) -> Column:
    """A portable pseudo-random index: 32 bits of md5 of 'seed|part|...' modulo a count."""
    text = F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % modulo
