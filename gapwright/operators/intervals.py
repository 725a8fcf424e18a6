"""Runs, gaps, candidate windows and their selection. Everything is keyed by series_id."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def densify(days: DataFrame) -> DataFrame:
    """A row for every calendar day from a series' first to its last; absent days have NULLs."""
    span = days.groupBy("series_id").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    every = span.select("series_id", F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date"))
    return every.join(days, ["series_id", "date"], "left").withColumn("x", F.unix_date("date"))


def islands(rows: DataFrame, *by: str) -> DataFrame:
    """Maximal runs of consecutive x: (by, start, end, length)."""
    w = Window.partitionBy(*by).orderBy("x")
    keyed = rows.select(*by, "x", "date", (F.col("x") - F.row_number().over(w)).alias("island"))
    return keyed.groupBy(*by, "island").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).cast("int").alias("length")).drop("island")


def eligible_runs(daily: DataFrame) -> DataFrame:
    """A missing day breaks a run as a day that isn't eligible does."""
    return islands(daily.where(F.coalesce("eligible", F.lit(False))), "series_id")


def row_gaps(daily: DataFrame) -> DataFrame:
    """Runs of rows that aren't eligible: absent days are no gap, but they part gaps."""
    return islands(daily.where(~F.coalesce("eligible", F.lit(False))), "series_id")


def real_gaps(daily: DataFrame, edge_days: int = 14) -> DataFrame:
    """The inventory of calendar gaps: absent days count as missing.

    A gap that reaches the series' end is open: it has its own identifier, counts as having a left edge and
    has no right edge.
    """
    dense = densify(daily.select("series_id", "date", "value", "eligible")).withColumn("eligible", F.coalesce("eligible", F.lit(False)))
    e = F.col("eligible").cast("int")
    w = Window.partitionBy("series_id").orderBy("x")
    dense = dense.withColumn("before", F.max(e).over(w.rangeBetween(-edge_days, -1))).withColumn("after", F.max(e).over(w.rangeBetween(1, edge_days)))
    dense = dense.withColumn("last_x", F.max("x").over(Window.partitionBy("series_id")))
    missing = dense.where(~F.col("eligible")).withColumn("island", F.col("x") - F.row_number().over(w))
    gaps = missing.groupBy("series_id", "island").agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).cast("int").alias("length"), F.min_by("before", "x").alias("before"),
        F.max_by("after", "x").alias("after"), (F.max("x") == F.max("last_x")).alias("open_ended"),
    )
    n = F.col("length")
    day = F.date_format("start", "yyyyMMdd")
    pre = F.coalesce(F.col("before"), F.lit(0)) == 1
    post = ~F.col("open_ended") & (F.coalesce(F.col("after"), F.lit(0)) == 1)
    return gaps.select(
        "series_id",
        F.when(F.col("open_ended"), F.concat(F.lit("REAL_OPEN_"), day)).otherwise(F.concat(F.lit("REAL_"), S.class_code(n), F.lit("_"), day)).alias("gap_id"),
        "start", "end", "length", S.gap_class(n).alias("gap_class"), S.seasons_spanned(F.col("start"), F.col("end")).alias("seasons"),
        S.nearest_lengths(n).alias("nearest_validated"), S.extrapolation(n).alias("extrapolation"),
        (F.col("open_ended") | pre).alias("pre_edge"), post.alias("post_edge"), "open_ended",
    )


def by_class(gaps: DataFrame) -> DataFrame:
    """Counts per class; all four classes are always there, in their order."""
    spark = gaps.sparkSession
    names = spark.createDataFrame([(0, "short"), (1, "medium"), (2, "long"), (3, "very_long")], "k int, gap_class string")
    agg = gaps.groupBy("gap_class").agg(F.count(F.lit(1)).alias("n_gaps"), F.sum("length").alias("total_days"), F.expr("percentile(length, 0.5)").alias("median_days"), F.max("length").alias("max_days"))
    zero = lambda c, t: F.coalesce(F.col(c), F.lit(0)).cast(t).alias(c)
    return names.join(agg, "gap_class", "left").select("k", "gap_class", zero("n_gaps", "long"), zero("total_days", "long"), zero("median_days", "double"), zero("max_days", "int"))


def coverage(daily: DataFrame) -> DataFrame:
    days = daily.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_days"), F.count_if(F.coalesce("eligible", F.lit(False))).alias("n_eligible"), F.min("date").alias("first_day"), F.max("date").alias("last_day"),
        F.count_if(F.col("value").isNull()).alias("n_missing"),
    )
    gaps = row_gaps(daily).groupBy("series_id").agg(F.count(F.lit(1)).alias("n_gaps"), F.max("length").alias("longest_gap"))
    out = days.join(gaps, "series_id", "left").fillna({"n_gaps": 0, "longest_gap": 0})
    return out.withColumn("eligible_share", S.rounded(F.col("n_eligible") / F.col("n_days")))


def candidate_starts(runs: DataFrame, lengths: list[int], context: int = 0) -> DataFrame:
    """Every start of a window of each length, with context days of the same run on both sides."""
    sizes = F.explode(F.array(*[F.lit(int(n)) for n in lengths])).alias("gap_length")
    rows = runs.select("*", sizes).where(F.col("length") >= F.col("gap_length") + 2 * context)
    first, last = F.date_add("start", context), F.date_sub("end", F.col("gap_length") - 1 + F.lit(context))
    return rows.select("series_id", "gap_length", F.col("start").alias("run_start"), F.col("end").alias("run_end"), F.explode(F.sequence(first, last)).alias("start"))


def above_floor(daily: DataFrame, floor: float = S.FLOOR) -> DataFrame:
    """Eligible days whose value is known and above the floor."""
    return daily.withColumn("eligible", F.coalesce(F.col("eligible"), F.lit(False)) & F.coalesce(F.col("value") > floor, F.lit(False)))


def _windows(starts: DataFrame) -> DataFrame:
    return starts.withColumn("end", F.date_add("start", F.col("gap_length") - 1)).withColumn("gap_id", S.gap_id(F.col("gap_length"), F.col("start")))


def block_sample(starts: DataFrame, seed: str = "42") -> DataFrame:
    """Windows that don't overlap, chosen without a sequential pass: of each block of days, the window inside it
    whose md5 is least. Portable between engines, and distributed by block."""
    n, x = F.col("gap_length"), F.unix_date("start")
    size = 4 * n + 12
    inside = starts.withColumn("block", F.floor(x / size)).where(F.floor((x + n - 1) / size) == F.col("block"))
    key = F.md5(F.concat_ws("|", F.lit(seed), n.cast("string"), x.cast("string")))
    best = inside.groupBy("series_id", "gap_length", "block").agg(F.min_by("start", key).alias("start"))
    return _windows(best.select("series_id", "gap_length", "start"))


def _accept(order: list[int], length: int, most: int | None) -> list[int]:
    taken: list[int] = []
    blocked: set[int] = set()
    for s in order:
        if most is not None and len(taken) >= most:
            break
        if s not in blocked:
            taken.append(s)
            blocked.update(range(s - length + 1, s + length))
    return taken


def greedy_sample(starts: DataFrame, seed: int = 42, most: int | None = 100) -> DataFrame:
    """Shuffled starts, accepted while they overlap none before; a fresh generator for each series and length.

    Sequential by definition: one group per (series, length), whose size is bounded by the series' days.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        order = sorted(pdf["x"].tolist())
        length = int(pdf["gap_length"].iloc[0])
        random.Random(seed).shuffle(order)
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "gap_length": length, "x": sorted(_accept(order, length, most))})

    rows = starts.select("series_id", "gap_length", F.unix_date("start").alias("x"))
    out = rows.groupBy("series_id", "gap_length").applyInPandas(pick, "series_id string, gap_length int, x int")
    return _windows(out.select("series_id", "gap_length", F.date_from_unix_date("x").alias("start")))


def shared_greedy_sample(starts: DataFrame, lengths: list[int], caps: dict[int, int], seed: int = 42) -> DataFrame:
    """One generator for each series, advanced over the lengths in order; rows keep the order of selection."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        rng, rows = np.random.default_rng(seed), []
        for n in lengths:
            own = np.array(sorted(pdf.loc[pdf["gap_length"] == n, "x"]), dtype=np.int64)
            order = own[rng.permutation(len(own))].tolist()
            rows += [(pdf["series_id"].iloc[0], n, s, k) for k, s in enumerate(_accept(order, n, caps.get(n)))]
        return pd.DataFrame(rows, columns=["series_id", "gap_length", "x", "k"])

    rows = starts.select("series_id", "gap_length", F.unix_date("start").alias("x"))
    out = rows.groupBy("series_id").applyInPandas(pick, "series_id string, gap_length int, x int, k int")
    return _windows(out.select("series_id", "gap_length", F.date_from_unix_date("x").alias("start"), F.col("k").alias("selection_order")))


def hidden_days(pool: DataFrame, *keep: str) -> DataFrame:
    """(gap_id, date, x, day): one row per hidden day, day from 1."""
    rows = pool.select("series_id", "gap_id", "gap_length", "start", "end", *keep, F.posexplode(F.sequence("start", "end")).alias("k", "date"))
    return rows.withColumn("x", F.unix_date("date")).withColumn("day", F.col("k") + 1).drop("k")


def sample_order(pool: DataFrame) -> DataFrame:
    return pool.withColumn("sample_order_index", F.row_number().over(Window.partitionBy("series_id", "gap_length").orderBy("start")) - 1)


def majority(rows: DataFrame, by: str, value: Column, order: str) -> DataFrame:
    """The most frequent value; of equals the one that comes first by order."""
    counts = rows.select(by, value.alias("v"), order).groupBy(by, "v").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counts.groupBy(by).agg(F.min_by("v", F.struct(-F.col("n"), "first")).alias("majority"))


def labelled_pool(daily: DataFrame, pool: DataFrame, context_days: int = 30) -> DataFrame:
    """Truth, event and context labels of a pool."""
    limit = daily.where(F.coalesce("eligible", F.lit(False)) & F.col("value").isNotNull()).groupBy("series_id").agg(F.expr("percentile(value, 0.9)").alias("p90"))
    days = hidden_days(pool).join(daily.select("series_id", "x", "value"), ["series_id", "x"], "left")
    truth = days.groupBy("gap_id").agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.count(F.lit(1)).alias("n_hidden_days"))
    seasons = majority(days, "gap_id", S.season(F.col("date")), "x").withColumnRenamed("majority", "season")
    e = F.coalesce(F.col("eligible"), F.lit(False)).cast("int")
    w = Window.partitionBy("series_id").orderBy("x")
    near = densify(daily.select("series_id", "date", "eligible")).select(
        "series_id", "date", F.sum(e).over(w.rangeBetween(-context_days, -1)).alias("pre"), F.sum(e).over(w.rangeBetween(1, context_days)).alias("post")
    )
    out = pool.join(truth, "gap_id").join(seasons, "gap_id").join(limit, "series_id")
    out = out.join(near.select("series_id", F.col("date").alias("start"), F.coalesce("pre", F.lit(0)).alias("pre_context_days")), ["series_id", "start"])
    out = out.join(near.select("series_id", F.col("date").alias("end"), F.coalesce("post", F.lit(0)).alias("post_context_days")), ["series_id", "end"])
    need = F.lit(context_days)
    return out.select(
        "series_id", "gap_id", "gap_length", "start", "end", "n_hidden_days", "season", F.year("start").alias("year"), S.rounded("mean", 4).alias("target_mean"), S.rounded("max", 4).alias("target_max"),
        S.rounded("p90", 4).alias("event_threshold"), (F.col("max") > F.col("p90")).alias("is_event"), (F.col("mean") >= F.col("p90")).alias("is_sustained"), (F.col("max") <= F.col("p90")).alias("is_background"),
        "pre_context_days", "post_context_days", ((F.col("pre_context_days") < need) | (F.col("post_context_days") < need)).alias("context_constrained"),
        S.support_role(F.col("gap_length")).alias("support_role"), S.required_context(F.col("gap_length")).alias("required_context_days"),
    )


def row_bounds(daily: DataFrame, pool: DataFrame) -> DataFrame:
    """(gap_id, first_row, last_row): positions of the gap's ends among the series' rows, only if both exist."""
    at = daily.select("series_id", "date", (F.row_number().over(Window.partitionBy("series_id").orderBy("x")) - 1).alias("row"))
    a = at.select("series_id", F.col("date").alias("start"), F.col("row").alias("first_row"))
    b = at.select("series_id", F.col("date").alias("end"), F.col("row").alias("last_row"))
    return pool.join(a, ["series_id", "start"]).join(b, ["series_id", "end"]).select("gap_id", "first_row", "last_row")


def context_slice(bounds: DataFrame, n_rows: int, mode: str, window: int = 0, most: int | None = None) -> DataFrame:
    """Row range [lo, hi) that a model sees; ranges that are too long are trimmed on both sides, the odd row on the right."""
    if mode not in ("full_series", "local_window", "edge_balanced"):
        raise ValueError(f"unknown mode {mode!r}")
    half = window // 2
    lo = F.lit(0) if mode == "full_series" else F.greatest(F.lit(0), F.col("first_row") - half)
    hi = F.lit(n_rows) if mode == "full_series" else F.least(F.lit(n_rows), F.col("last_row") + 1 + half)
    out = bounds.withColumn("lo", lo).withColumn("hi", hi)
    if most is not None:
        extra = F.greatest(F.lit(0), F.col("hi") - F.col("lo") - most)
        left = F.least(F.floor(extra / 2).cast("int"), F.col("first_row") - F.col("lo"))
        out = out.withColumn("lo", F.col("lo") + left).withColumn("hi", F.col("hi") - (extra - left))
    return out


def stratified_subset(pool: DataFrame, n: int, seed: str = "42") -> DataFrame:
    """About n gaps, as many of each length; which ones, an md5 order decides."""
    k = pool.select("gap_length").distinct().count()
    rank = F.row_number().over(Window.partitionBy("gap_length").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "gap_id")), "gap_id"))
    kept = pool.withColumn("rank", rank).where(F.col("rank") <= max(1, n // max(1, k)))
    return kept.orderBy("gap_length", "gap_id").limit(n).drop("rank")


def complete_windows(daily: DataFrame, length: int, stride: int, context: int) -> DataFrame:
    """Windows of row positions, every stride rows, wholly observed, with enough observed rows around."""
    w = Window.partitionBy("series_id").orderBy("x")
    seen = F.col("value").isNotNull().cast("int")
    rows = daily.withColumn("row", F.row_number().over(w) - 1).withColumn("inside", F.sum(seen).over(w.rowsBetween(0, length - 1)))
    rows = rows.withColumn("left", F.coalesce(F.sum(seen).over(w.rowsBetween(-context, -1)), F.lit(0))).withColumn("right", F.coalesce(F.sum(seen).over(w.rowsBetween(length, length + context - 1)), F.lit(0)))
    return rows.where((F.col("row") % stride == 0) & (F.col("inside") == length) & (F.col("left") + F.col("right") >= context)).select("series_id", "row", F.col("date").alias("start"), "left", "right")
