"""Reconstruction baselines: climatology, persistence, interpolation. Long rows (gap_id, date, method, prediction)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .intervals import densify, hidden_days


def seen() -> Column:
    """Eligible days whose value is known."""
    return F.coalesce(F.col("eligible"), F.lit(False)) & F.col("value").isNotNull()


def edges(daily: DataFrame, pool: DataFrame, floor: float | None = None) -> DataFrame:
    """The nearest known observation strictly before and strictly after each gap (NULL if there is none).

    One pass over the dense series: the last known value up to a day, the first from a day on; gaps then look up
    the days next to them. No scan for each gap.
    """
    known = seen() if floor is None else seen() & (F.col("value") > floor)
    dense = densify(daily.select("series_id", "date", "value", "eligible"))
    w = Window.partitionBy("series_id").orderBy("x")
    o = F.when(known, F.struct(F.col("x").alias("ox"), F.col("value").alias("ov")))
    dense = dense.withColumn("p", F.last(o, True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("q", F.first(o, True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    left = dense.select("series_id", F.col("date").alias("start"), F.col("p.ox").alias("x0"), F.col("p.ov").alias("v0"))
    right = dense.select("series_id", F.col("date").alias("end"), F.col("q.ox").alias("x1"), F.col("q.ov").alias("v1"))
    return pool.join(left, ["series_id", "start"], "left").join(right, ["series_id", "end"], "left")


def _long(days: DataFrame, method: str, prediction: Column) -> DataFrame:
    return days.select("series_id", "gap_id", "gap_length", "date", "x", F.lit(method).alias("method"), prediction.alias("prediction"))


def persistence(daily: DataFrame, pool: DataFrame) -> DataFrame:
    return _long(hidden_days(edges(daily, pool), "v0"), "persistence", F.col("v0"))


def _between(a: Column, b: Column) -> Column:
    t = S.fraction(F.col("x"), F.col("x0"), F.col("x1"))
    return F.coalesce(a + t * (b - a), (a + b) / 2)


def linear(daily: DataFrame, pool: DataFrame) -> DataFrame:
    """Between the nearest known days; NULL for the whole gap if one is missing."""
    return _long(hidden_days(edges(daily, pool), "x0", "v0", "x1", "v1"), "linear", _between(F.col("v0"), F.col("v1")))


def log_linear(daily: DataFrame, pool: DataFrame) -> DataFrame:
    """Interpolation of logarithms; days without both neighbours stay, with NULL. The prediction is a logarithm."""
    days = hidden_days(edges(daily, pool, S.FLOOR), "x0", "v0", "x1", "v1")
    return _long(days, "log_linear", _between(F.log10("v0"), F.log10("v1")))


def anchor(daily: DataFrame, pool: DataFrame) -> DataFrame:
    """Interpolation of values, then the logarithm. Not the same as log_linear, and never a substitute for it."""
    days = hidden_days(edges(daily, pool, S.FLOOR), "x0", "v0", "x1", "v1")
    return _long(days, "anchor", S.guarded_log10(_between(F.col("v0"), F.col("v1"))))


def climatology(daily: DataFrame, pool: DataFrame) -> DataFrame:
    """The month's mean without the gap's own days, else the whole mean without them.

    Leave-one-gap-out by subtraction: totals by month less the gap's part, so the series isn't read once per gap.
    """
    known = daily.where(seen()).withColumn("month", F.month("date"))
    by_month = known.groupBy("series_id", "month").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    whole = known.groupBy("series_id").agg(F.sum("value").alias("ts"), F.count(F.lit(1)).alias("tn"))
    days = hidden_days(pool).withColumn("month", F.month("date"))
    inside = days.join(known.select("series_id", "x", "value"), ["series_id", "x"])
    own = inside.groupBy("gap_id", "month").agg(F.sum("value").alias("gs"), F.count(F.lit(1)).alias("gn"))
    total = inside.groupBy("gap_id").agg(F.sum("value").alias("gts"), F.count(F.lit(1)).alias("gtn"))
    rows = days.join(by_month, ["series_id", "month"], "left").join(whole, "series_id", "left").join(own, ["gap_id", "month"], "left").join(total, "gap_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    monthly = F.when(zero("n") - zero("gn") > 0, (zero("s") - zero("gs")) / (zero("n") - zero("gn")))
    overall = F.when(zero("tn") - zero("gtn") > 0, (zero("ts") - zero("gts")) / (zero("tn") - zero("gtn")))
    return _long(rows, "climatology", F.coalesce(monthly, overall))


def log_climatology(daily: DataFrame, pool: DataFrame) -> DataFrame:
    """Climatology of logarithms, back on the value's scale."""
    logs = daily.withColumn("value", S.guarded_log10(F.col("value")))
    return climatology(logs, pool).withColumn("method", F.lit("log_climatology")).withColumn("prediction", S.inverse_log10(F.col("prediction")))


METHODS = {"climatology": climatology, "persistence": persistence, "linear": linear, "log_linear": log_linear, "anchor": anchor, "log_climatology": log_climatology}


def predict(method: str, daily: DataFrame, pool: DataFrame) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    return METHODS[method](daily, pool)


def baselines(daily: DataFrame, pool: DataFrame) -> DataFrame:
    return climatology(daily, pool).unionByName(persistence(daily, pool)).unionByName(linear(daily, pool))


def with_truth(predictions: DataFrame, daily: DataFrame) -> DataFrame:
    return predictions.join(daily.select("series_id", "x", F.col("value").alias("truth")), ["series_id", "x"], "left")


def day_of_year_climatology(daily: DataFrame, pool: DataFrame) -> DataFrame:
    """(gap_id, doy 0..366, mean): mean per day of year without the gap; empty bins are interpolated, ends carry."""
    known = daily.where(seen()).withColumn("doy", F.dayofyear("date"))
    sums = known.groupBy("series_id", "doy").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    inside = hidden_days(pool).join(known.select("series_id", "x", "value", "doy"), ["series_id", "x"]).groupBy("gap_id", "doy").agg(F.sum("value").alias("gs"), F.count(F.lit(1)).alias("gn"))
    bins = pool.select("series_id", "gap_id", F.explode(F.sequence(F.lit(0), F.lit(366))).alias("doy"))
    rows = bins.join(sums, ["series_id", "doy"], "left").join(inside, ["gap_id", "doy"], "left")
    n = F.coalesce("n", F.lit(0)) - F.coalesce("gn", F.lit(0))
    rows = rows.withColumn("m", F.when(n > 0, (F.col("s") - F.coalesce("gs", F.lit(0.0))) / n))
    w = Window.partitionBy("gap_id").orderBy("doy")
    o = F.when(F.col("m").isNotNull(), F.struct("doy", "m"))
    rows = rows.withColumn("p", F.last(o, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("q", F.first(o, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    t = S.fraction(F.col("doy"), F.col("p.doy"), F.col("q.doy"))
    mean = F.coalesce("m", F.col("p.m") + t * (F.col("q.m") - F.col("p.m")), "p.m", "q.m")
    return rows.select("series_id", "gap_id", "doy", mean.alias("mean"))


def fill_distances(daily: DataFrame) -> DataFrame:
    """Days since the last and until the next known day (0 on known days)."""
    w = Window.partitionBy("series_id").orderBy("x")
    k = F.when(seen(), F.col("x"))
    back, on = F.last(k, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(k, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return daily.select("series_id", "date", (F.col("x") - back).alias("since"), (on - F.col("x")).alias("until"))


def fill_real_gaps(daily: DataFrame) -> DataFrame:
    """Interpolates the series' own gaps: (series_id, gap_id, date, prediction)."""
    from .intervals import row_gaps

    pool = row_gaps(daily).withColumn("gap_length", F.col("length")).withColumn("gap_id", S.gap_id(F.col("length"), F.col("start")))
    return linear(daily, pool)
