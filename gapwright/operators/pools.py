"""Pools of artificial gaps, made of candidate windows, samples and labels."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import intervals

#: Lengths and caps of the two parts of the log-scale pool, in the order of sampling (fixed values).
CORE = {1: 100, 3: 100, 7: 100, 14: 100, 30: 100}
EXTENDED = {10: 100, 21: 102, 45: 37, 60: 25}
#: Lengths of the raw-scale pool (fixed values).
MANDATORY, EXPLORATORY = (1, 3, 7, 14, 30, 45, 60), (90, 120)


def neutral(daily: DataFrame, lengths: list[int], seed: int = 42, most: int | None = 100) -> DataFrame:
    """Non-overlapping windows of eligible runs; lengths must be named."""
    if not lengths:
        raise ValueError("lengths must be named")
    return intervals.greedy_sample(intervals.candidate_starts(intervals.eligible_runs(daily), lengths), seed, most)


def core_and_extended(daily: DataFrame, lengths: list[int] | None = None, seed: int = 42) -> DataFrame:
    """The log-scale pool with its labels: core lengths with a generator each, extended ones (values above the floor)
    with one generator that passes all of them in order, whichever are asked for."""
    lengths = [*CORE, *EXTENDED] if lengths is None else lengths
    if unknown := [n for n in lengths if n not in CORE and n not in EXTENDED]:
        raise ValueError(f"neither core nor extended lengths: {unknown}")
    parts = []
    if core := [n for n in lengths if n in CORE]:
        parts.append(neutral(daily, core, seed).withColumn("part", F.lit("core")))
    if extended := [n for n in lengths if n in EXTENDED]:
        starts = intervals.candidate_starts(intervals.eligible_runs(intervals.above_floor(daily)), list(EXTENDED))
        sample = intervals.shared_greedy_sample(starts, list(EXTENDED), EXTENDED, seed).drop("selection_order")
        parts.append(sample.where(F.col("gap_length").isin(extended)).withColumn("part", F.lit("extended")))
    pool = parts[0]
    for p in parts[1:]:
        pool = pool.unionByName(p)
    return intervals.labelled_pool(daily, pool).join(pool.select("gap_id", "part"), "gap_id")


def by_role(daily: DataFrame, mandatory: tuple[int, ...] = MANDATORY, exploratory: tuple[int, ...] = EXPLORATORY, sample=intervals.greedy_sample, **options) -> DataFrame:
    """The raw-scale pool: a day is eligible if its value is known, too; windows have their context within the run; season
    is that of the first month."""
    seen = daily.withColumn("eligible", F.coalesce(F.col("eligible"), F.lit(False)) & F.col("value").isNotNull())
    runs = intervals.eligible_runs(seen)
    starts = None
    for context in (30, 60):
        own = [n for n in (*mandatory, *exploratory) if (30 if n <= 30 else 60) == context]
        if own:
            rows = intervals.candidate_starts(runs, own, context)
            starts = rows if starts is None else starts.unionByName(rows)
    pool = sample(starts, **options)
    # A window lies in one run: the run's days are looked up by the window's first.
    days = runs.select("series_id", F.col("start").alias("run_start"), F.col("end").alias("run_end"), F.explode(F.sequence("start", "end")).alias("start"))
    pool = intervals.sample_order(pool).join(days, ["series_id", "start"])
    return pool.select(
        "series_id", F.concat(F.lit("RAW_L"), F.lpad(F.col("gap_length").cast("string"), 3, "0"), F.lit("_"), F.date_format("start", "yyyyMMdd")).alias("gap_id"), "gap_length", "start", "end",
        F.col("gap_length").alias("n_hidden_days"), S.season(F.col("start")).alias("season"), F.year("start").alias("year"),
        F.datediff("start", "run_start").alias("context_before_days"), F.datediff("run_end", "end").alias("context_after_days"),
        F.col("gap_length").isin(*mandatory).alias("is_mandatory"), "sample_order_index", S.support_role(F.col("gap_length")).alias("support_role"),
    )


def illustrative(daily: DataFrame, lengths: list[int], sample=intervals.greedy_sample, **options) -> DataFrame:
    """Windows with their true mean and greatest value and whether that is an event; lengths without a window are warned
    of and left out. Season is that of the first month."""
    starts = intervals.candidate_starts(intervals.eligible_runs(daily), lengths)
    pool = sample(starts, **options)
    there = {r["gap_length"] for r in pool.select("gap_length").distinct().collect()}  # at most the lengths asked for
    for n in lengths:
        if n not in there:
            warnings.warn(f"no window of {n} days", stacklevel=2)
    limit = daily.where(F.coalesce("eligible", F.lit(False)) & F.col("value").isNotNull()).groupBy("series_id").agg(F.expr("percentile(value, 0.9)").alias("p90"))
    truth = intervals.hidden_days(pool).join(daily.select("series_id", "x", "value"), ["series_id", "x"], "left").groupBy("gap_id").agg(F.avg("value").alias("mean"), F.max("value").alias("max"))
    out = pool.join(truth, "gap_id").join(limit, "series_id", "left")
    return out.select(
        "series_id", "gap_id", "gap_length", "start", "end", S.season(F.col("start")).alias("season"), F.year("start").alias("year"), F.col("gap_length").alias("n_hidden_days"),
        F.bround("mean", 4).alias("target_mean"), F.bround("max", 4).alias("target_max"), F.coalesce(F.col("max") > F.col("p90"), F.lit(False)).alias("is_event"), F.bround("p90", 4).alias("event_threshold"),
    )


def raw_inventory(daily: DataFrame) -> DataFrame:
    """Calendar gaps of the raw-scale target in six columns; one that reaches the end is open."""
    gaps = intervals.real_gaps(daily)
    name = F.concat(F.when(F.col("open_ended"), "RAWREAL_OPEN_").otherwise("RAWREAL_"), F.date_format("start", "yyyyMMdd"))
    return gaps.select(name.alias("gap_id"), "start", "end", F.col("length").alias("length_days"), "gap_class", "seasons")


def artificial_gap(daily: DataFrame, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """(masked series with in_gap, truth). Repeated dates and unknown values within the gap are errors."""
    a, b = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    if daily.groupBy("series_id", "date").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1):
        raise ValueError("a date occurs twice")
    inside = F.col("date").between(a, b)
    truth = daily.where(inside).select("series_id", "date", F.col("value").alias("truth"))
    if truth.where("truth is null").take(1):
        raise ValueError(f"{start} to {end} isn't observed throughout")
    return daily.withColumn("in_gap", inside).withColumn("value", F.when(~F.col("in_gap"), F.col("value"))), truth


def scored_artificial_gap(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions beside the truth, day by day; no common day is an error."""
    out = predictions.join(truth, ["series_id", "date"])
    if not out.take(1):
        raise ValueError("no day has both a prediction and a truth")
    return out.withColumn("abs_error", F.abs(F.col("prediction") - F.col("truth")))
