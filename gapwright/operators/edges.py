"""Edge features of gaps: what is known just before and just after, and the table that residual models learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .baselines import _between, seen
from .intervals import densify, hidden_days

#: Feature to (family, is it known before the gap ends) (fixed values).
REGISTRY = {
    **{f"pre_{n}": ("pre_edge", True) for n in ("last", "last_log", "days_since", "mean_3d", "mean_7d", "mean_14d", "median_7d", "std_7d", "slope_3d", "slope_7d", "delta")},
    **{f"post_{n}": ("post_edge", False) for n in ("first", "first_log", "days_until", "mean_3d", "mean_7d", "median_7d", "std_7d", "slope_3d", "slope_7d", "delta")},
    **{f"edge_{n}": ("edge", False) for n in ("mean", "log_mean", "delta", "delta_log", "slope", "log_slope")},
}


def registry(spark) -> DataFrame:
    return spark.createDataFrame([(k, f, early) for k, (f, early) in REGISTRY.items()], "feature string, family string, pre_only boolean")


def _frame(w, lo: int, hi: int):
    return w.rangeBetween(lo, hi)


def _side(daily: DataFrame, sign: int) -> DataFrame:
    """Windowed statistics of known days before (sign -1) or after (+1) each calendar day."""
    dense = densify(daily.select("series_id", "date", "value", "eligible")).withColumn("v", F.when(seen() & (F.col("value") > S.FLOOR), F.col("value")))
    w = Window.partitionBy("series_id").orderBy("x")
    near = lambda d: _frame(w, -d, -1) if sign < 0 else _frame(w, 1, d)
    far = w.rowsBetween(Window.unboundedPreceding, -1) if sign < 0 else w.rowsBetween(1, Window.unboundedFollowing)
    pick = F.last if sign < 0 else F.first
    known = F.when(F.col("v").isNotNull(), F.struct(F.col("x").alias("ox"), F.col("v").alias("ov")))
    # The neighbour's own neighbour, along known days only.
    chain = dense.withColumn("next", pick(known, True).over(far)).withColumn("known", known)
    link = F.when(F.col("v").isNotNull(), F.struct(F.col("x").alias("ox"), F.col("v").alias("ov"), F.col("next.ov").alias("ov2"), F.col("next.ox").alias("ox2")))
    std = lambda d: F.when(F.count("v").over(near(d)) == 1, 0.0).otherwise(F.stddev_samp("v").over(near(d)))
    slope = lambda d: F.when(F.count("v").over(near(d)) >= 2, F.regr_slope("v", F.when(F.col("v").isNotNull(), F.col("x").cast("double"))).over(near(d)))
    mean = lambda d: F.avg("v").over(near(d))
    return chain.withColumn("edge", pick(link, True).over(far)).select(
        "series_id", "date", "edge", mean(3).alias("m3"), mean(7).alias("m7"), mean(14).alias("m14"), F.expr("percentile(v, 0.5)").over(near(7)).alias("med7"), std(7).alias("s7"),
        slope(3).alias("k3"), slope(7).alias("k7"), F.max(F.when(F.col("v").isNotNull(), F.col("x"))).over(near(14)).alias("hi14"), F.min(F.when(F.col("v").isNotNull(), F.col("x"))).over(near(14)).alias("lo14"),
    )


def edge_features(daily: DataFrame, pool: DataFrame) -> DataFrame:
    """One row per gap. dep_pre_min, dep_post_max: the furthest days that the features really used."""
    a = _side(daily, -1)
    pre = a.select(
        "series_id", F.col("date").alias("start"), F.col("edge.ov").alias("pre_last"), F.log10("edge.ov").alias("pre_last_log"), (F.unix_date("date") - F.col("edge.ox")).alias("pre_days_since"),
        F.col("m3").alias("pre_mean_3d"), F.col("m7").alias("pre_mean_7d"), F.col("m14").alias("pre_mean_14d"), F.col("med7").alias("pre_median_7d"), F.col("s7").alias("pre_std_7d"),
        F.col("k3").alias("pre_slope_3d"), F.col("k7").alias("pre_slope_7d"), (F.col("edge.ov") - F.col("edge.ov2")).alias("pre_delta"),
        F.least("lo14", "edge.ox", "edge.ox2").alias("dep_pre_min"), F.col("edge.ox").alias("x0"),
    )
    b = _side(daily, 1)
    post = b.select(
        "series_id", F.col("date").alias("end"), F.col("edge.ov").alias("post_first"), F.log10("edge.ov").alias("post_first_log"), (F.col("edge.ox") - F.unix_date("date")).alias("post_days_until"),
        F.col("m3").alias("post_mean_3d"), F.col("m7").alias("post_mean_7d"), F.col("med7").alias("post_median_7d"), F.col("s7").alias("post_std_7d"),
        F.col("k3").alias("post_slope_3d"), F.col("k7").alias("post_slope_7d"), (F.col("edge.ov2") - F.col("edge.ov")).alias("post_delta"),
        F.greatest("hi14", "edge.ox", "edge.ox2").alias("dep_post_max"), F.col("edge.ox").alias("x1"),
    )
    out = pool.select("series_id", "gap_id", "gap_length", "start", "end").join(pre, ["series_id", "start"], "left").join(post, ["series_id", "end"], "left")
    n = F.col("gap_length") + 1
    return out.withColumns({
        "edge_mean": (F.col("pre_last") + F.col("post_first")) / 2,
        "edge_log_mean": (F.col("pre_last_log") + F.col("post_first_log")) / 2,
        "edge_delta": F.col("post_first") - F.col("pre_last"),
        "edge_delta_log": F.col("post_first_log") - F.col("pre_last_log"),
        "edge_slope": (F.col("post_first") - F.col("pre_last")) / n,
        "edge_log_slope": (F.col("post_first_log") - F.col("pre_last_log")) / n,
    })


def edge_table(daily: DataFrame, pool: DataFrame) -> DataFrame:
    """Per (gap, hidden day): edge features, place in the gap, anchor, truth and residual, and the span of source days."""
    f = edge_features(daily, pool)
    names = [c for c in f.columns if c not in ("series_id", "gap_id", "gap_length", "start", "end")]
    days = hidden_days(f, *names)
    days = days.join(daily.select("series_id", "x", F.col("value").alias("truth")), ["series_id", "x"], "left")
    k, n = F.col("day"), F.col("gap_length")
    sin, cos = S.season_encodings(F.col("date"))
    days = days.withColumns({
        "position": k / (n + 1), "distance_left": k, "distance_right": n - k + 1, "doy_sin": sin, "doy_cos": cos,
        "anchor_log": S.guarded_log10(_between(F.col("pre_last"), F.col("post_first"))), "truth_log": S.guarded_log10(F.col("truth")),
        "dep_min": F.least("dep_pre_min", "x"), "dep_max": F.greatest("dep_post_max", "x"),
    })
    return days.withColumn("residual_log", F.col("truth_log") - F.col("anchor_log"))


def meta() -> tuple[str, ...]:
    return ("position", "distance_left", "distance_right", "doy_sin", "doy_cos")


def predictors(pre_only: bool = False) -> list[str]:
    return [*meta(), *[k for k, (_, early) in REGISTRY.items() if early or not pre_only]]


def column(name: str) -> Column:
    if name not in REGISTRY:
        raise ValueError(f"unknown feature {name!r}")
    return F.col(name)
