"""The demonstration's learned methods over any pool: predictions on the value's scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import backends, baselines, masking, models
from .intervals import hidden_days

#: Lengths of the synthetic gaps, how many a model learns from, and how many are tried for each (fixed values).
LENGTHS = (1, 3, 7, 14)
GAPS, TRIES = 80, 20


def _valued(rows: DataFrame) -> DataFrame:
    return rows.select("series_id", "gap_id", "x", F.pow(F.lit(10.0), F.col("prediction")).alias("prediction"))


def external_tabular(daily: DataFrame, features: DataFrame, pool: DataFrame, columns: list[str]) -> DataFrame:
    """Boosting on a day's features and season, trained by every known day outside the gap; missing features are allowed."""
    sin, cos = S.season_encodings(F.col("date"))
    days = features.withColumns({"doy_sin": sin, "doy_cos": cos})
    test, train = models.external_rows(daily.withColumn("y", S.guarded_log10(F.col("value"))), days, pool)
    names = [*columns, "doy_sin", "doy_cos"]
    keep = ["x", *names, "y"]
    return _valued(models.leave_one_gap_out(test.select("series_id", "gap_id", *keep), train.select("held_out", *keep), names, "y", "hist_boosted", least=1, rounds=100, rate=0.1, share=0, seed=0))


def synthetic_gaps(daily: DataFrame, lengths: tuple[int, ...] = LENGTHS, tries: int = GAPS * TRIES, margin: int = 10, seed: str = "0") -> DataFrame:
    """Blocks of wholly known days, drawn by portable picks at least margin days from the series' ends: a pool in the draws' order."""
    ends = daily.groupBy("series_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    draws = ends.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    which = S.picked(seed, F.col("draw"), F.lit("length"), modulo=F.lit(len(lengths)))
    draws = draws.withColumn("gap_length", F.get(F.array(*[F.lit(n) for n in lengths]), which.cast("int")))
    room = F.col("hi") - F.col("lo") + 1 - F.col("gap_length") - 2 * margin
    draws = draws.withColumn("room", room).where("room > 0").withColumn("a", (F.col("lo") + margin + S.picked(seed, F.col("draw"), F.lit("start"), modulo=F.col("room"))).cast("int"))
    draws = draws.withColumn("b", F.col("a") + F.col("gap_length") - 1)
    known = daily.where(baselines.seen() & (F.col("value") > S.FLOOR)).select("series_id", "x")
    days = draws.select("series_id", "draw", "gap_length", F.explode(F.sequence("a", "b")).alias("x"))
    whole = days.join(known, ["series_id", "x"]).groupBy("series_id", "draw", "gap_length").agg(F.count(F.lit(1)).alias("n")).where("n = gap_length")
    at = lambda c: F.date_from_unix_date(F.col(c))
    return draws.join(whole.select("series_id", "draw"), ["series_id", "draw"]).select("series_id", F.concat(F.lit("S"), F.lpad(F.col("draw").cast("string"), 6, "0")).alias("gap_id"), "gap_length", at("a").alias("start"), at("b").alias("end"))


def residual_days(daily: DataFrame, pool: DataFrame) -> DataFrame:
    """Per hidden day: interpolated logarithm, days from and to the known neighbours, and the truth's residual (NULL where unknown).

    Days without both neighbours are left out. dep_min, dep_max: the neighbours, the only days the row was made from.
    """
    days = hidden_days(baselines.edges(daily, pool, S.FLOOR), "x0", "v0", "x1", "v1").where("x0 is not null and x1 is not null")
    truth = daily.where(baselines.seen()).select("series_id", "x", S.guarded_log10(F.col("value")).alias("truth_log"))
    t = S.fraction(F.col("x"), F.col("x0"), F.col("x1"))
    days = days.withColumn("interp_log", F.log10("v0") + t * (F.log10("v1") - F.log10("v0"))).join(truth, ["series_id", "x"], "left")
    return days.select(
        "series_id", "gap_id", "date", "x", "interp_log", (F.col("x") - F.col("x0")).alias("days_from"), (F.col("x1") - F.col("x")).alias("days_to"),
        (F.col("truth_log") - F.col("interp_log")).alias("residual"), F.col("x0").alias("dep_min"), F.col("x1").alias("dep_max"),
    )


def gap_edge_residual(daily: DataFrame, features: DataFrame, pool: DataFrame, columns: list[str], gaps: int = GAPS, **options) -> DataFrame:
    """Interpolation plus a residual that boosting learns from synthetic gaps elsewhere in the series.

    A gap learns from the first `gaps` synthetic ones (in draw order) whose days and known neighbours lie outside it, so what it
    hides is never seen. Synthetic days without all features are no training rows. No synthetic gap: NULLs.
    """
    names = ["interp_log", "days_from", "days_to", *columns]
    days = residual_days(daily, synthetic_gaps(daily, **options)).join(features.drop("x"), "date").dropna(subset=columns)
    blocks = days.groupBy("series_id", "gap_id").agg(F.first("dep_min").alias("dep_min"), F.first("dep_max").alias("dep_max"))
    own = masking.admissible(blocks, pool).withColumn("k", F.row_number().over(Window.partitionBy("held_out").orderBy("gap_id"))).where(F.col("k") <= gaps)
    train = own.select("held_out", "series_id", "gap_id").join(days, ["series_id", "gap_id"]).select("held_out", "x", *names, "residual")
    test = residual_days(daily, pool).join(features.drop("x"), "date", "left").select("series_id", "gap_id", "x", *names, "residual")
    return _valued(models.leave_one_gap_out(test, train, names, "residual", "hist_boosted", anchor="interp_log", least=1, rounds=150, rate=0.1, leaf_rows=5, share=0, seed=0))


def sequence_calls(logs: DataFrame, pool: DataFrame, backend: backends.Backend, covariates: tuple[str, ...] = (), mode: str = "full_series") -> DataFrame:
    """(gap_id, x, value, q05, q95, error): a sequence model's reconstruction, from logarithms back to values."""
    out = backends.infer(logs, pool, backend, mode=mode, covariates=covariates)
    ten = lambda c: F.pow(F.lit(10.0), c)
    return out.select("gap_id", "x", ten(F.col("prediction")).alias("value"), ten(F.get("quantiles", F.lit(0))).alias("q05"), ten(F.get("quantiles", F.lit(6))).alias("q95"), "error")
