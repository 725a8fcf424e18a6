"""Scores of predictions: rows (method, gap_id, gap_length, prediction, truth)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def error() -> Column:
    return F.col("prediction") - F.col("truth")


def on_log_scale(rows: DataFrame, missing_at_floor: bool = False) -> DataFrame:
    """Truth is raised to the floor before its logarithm; predictions are values too.

    Missing values stay missing; with missing_at_floor they are raised to the floor, too, so their days are scored.
    """
    value = lambda c: F.coalesce(F.col(c), F.lit(S.FLOOR)) if missing_at_floor else F.col(c)
    return rows.withColumns({c: F.log10(S.clipped(value(c))) for c in ("prediction", "truth")})


def gap_metrics(rows: DataFrame, digits: int = 4) -> DataFrame:
    """Per method and gap: valid days, coverage, MAE, RMSE, bias, and r where three days and both spreads allow it."""
    e = error()
    ok = e.isNotNull()
    p, t = F.when(ok, F.col("prediction")), F.when(ok, F.col("truth"))
    rich = (F.count(e) >= 3) & (F.stddev_samp(p) > 0) & (F.stddev_samp(t) > 0)
    out = rows.groupBy("method", "gap_id", "gap_length").agg(
        F.count(e).alias("n_valid"), (F.count("prediction") / F.count(F.lit(1))).alias("coverage"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
        F.when(rich, F.corr(p, t)).alias("r"),
    )
    return out.withColumns({c: S.rounded(c, digits) for c in ("coverage", "mae", "rmse", "bias", "r")})


def summary(metrics: DataFrame, *by: str) -> DataFrame:
    return metrics.groupBy(*by).agg(
        F.countDistinct("gap_id").alias("n_gaps"), F.avg("mae").alias("mae_mean"), F.stddev_samp("mae").alias("mae_std"), F.avg("rmse").alias("rmse_mean"), F.stddev_samp("rmse").alias("rmse_std"),
        F.avg("bias").alias("bias_mean"), F.avg("r").alias("r_mean"), F.avg("coverage").alias("coverage_mean"),
    )


def scores(rows: DataFrame, *by: str, counted_before: bool = False) -> DataFrame:
    """Day-weighted and gap-weighted errors in one aggregate; quantiles need the day rows.

    counted_before: gaps and rows are counted before rows without an error are dropped.
    """
    keys = list(by)
    rows = rows.withColumn("e", error()).withColumn("a", F.abs("e"))
    rows = rows if counted_before else rows.where(F.col("e").isNotNull())
    # A gap's rows meet once; its weights then make the gap-weighted error and the number of gaps plain sums.
    w = Window.partitionBy(*keys, "gap_id")
    rows = rows.withColumn("known", F.count("e").over(w)).withColumn("all", F.count(F.lit(1)).over(w))
    out = rows.groupBy(*keys).agg(
        F.round(F.sum(1 / F.col("all"))).cast("long").alias("n_gaps"), F.count(F.lit(1)).alias("n_days"), F.avg("a").alias("day_weighted_mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("e").alias("bias"),
        F.expr("percentile(a, 0.5)").alias("median_abs"), F.expr("percentile(a, 0.9)").alias("p90_abs"),
        F.try_divide(F.sum(F.try_divide(F.col("a"), F.col("known"))), F.sum(F.when(F.col("e").isNotNull(), 1 / F.col("known")))).alias("gap_weighted_mae"),
    )
    return out


def by_length(rows: DataFrame) -> DataFrame:
    return scores(rows, "method", "gap_length")


def by_event(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Errors of gaps with and without an event; labels (gap_id, is_event)."""
    rows = rows.join(labels.select("gap_id", "is_event"), "gap_id", "left").withColumn("a", F.abs(error()))
    return rows.groupBy("method", "is_event").agg(F.count("a").alias("n_days"), F.avg("a").alias("mae"))


def pooled(lengths: DataFrame) -> DataFrame:
    """Aggregate errors from those by length: weights are days and gaps."""
    return lengths.groupBy("method").agg(
        (F.sum(F.col("day_weighted_mae") * F.col("n_days")) / F.sum("n_days")).alias("day_weighted_mae"), (F.sum(F.col("gap_weighted_mae") * F.col("n_gaps")) / F.sum("n_gaps")).alias("gap_weighted_mae")
    )


def ranks(metrics: DataFrame, missing_last: bool = False) -> DataFrame:
    """Average rank of each method's MAE within a gap (ties share the mean of their places).

    Methods without an MAE in a gap have no place there; with missing_last they share the last ones.
    """
    w = Window.partitionBy("gap_id").orderBy(F.asc_nulls_last("mae"))
    ties = Window.partitionBy("gap_id", "mae")
    place: Column = F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0
    rows = metrics if missing_last else metrics.where(F.col("mae").isNotNull())
    return rows.withColumn("place", place).groupBy("method").agg(F.avg("place").alias("mean_rank"), F.count(F.lit(1)).alias("n_gaps"))


def improvement(rows: DataFrame, base: str) -> DataFrame:
    """Each method's gap-weighted error against the base's, in per cent."""
    s = scores(rows, "method").select("method", "gap_weighted_mae")
    one = s.where(F.col("method") == base).select(F.col("gap_weighted_mae").alias("base_mae"))
    return s.crossJoin(one).withColumn("change_pct", 100 * (F.col("gap_weighted_mae") / F.col("base_mae") - 1))


def against_frozen(rows: DataFrame, frozen: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Gap-weighted errors beside frozen ones (method, frozen_mae)."""
    s = scores(rows, "method").select("method", "n_gaps", "gap_weighted_mae").join(frozen, "method", "full")
    gap = F.abs(F.col("gap_weighted_mae") - F.col("frozen_mae"))
    return s.withColumn("status", F.when(gap.isNull(), "unavailable").when(gap <= tolerance, "reproduced").otherwise("mismatched"))


#: What bounded runs are good for, as a column of their report (fixed value).
CAVEAT = "bounded_length_biased_subset_not_comparable_to_frozen_full_406_gap_headline"


def bounded_stats(rows: DataFrame) -> DataFrame:
    """Gaps, days and mean absolute error by arm and context mode, with the caveat on every row."""
    out = rows.groupBy("arm", "context_mode").agg(F.countDistinct("gap_id").alias("n_gaps"), F.count(F.lit(1)).alias("n_days"), F.avg(F.abs(error())).alias("mae_bounded_subset"))
    return out.select(F.lit(CAVEAT).alias("caveat"), *out.columns)


def pivoted(metrics: DataFrame, row: str, column: str, value: str, values: list) -> DataFrame:
    """Mean values with a column for each of the named values."""
    return metrics.groupBy(row).pivot(column, values).agg(F.avg(value))


def described(rows: DataFrame, by: str, value: str) -> DataFrame:
    """count, mean, std, min, quartiles and max of a value by group."""
    q = lambda p: F.expr(f"percentile({value}, {p})")
    return rows.groupBy(by).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max(value).alias("max")
    )
