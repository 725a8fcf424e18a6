"""Feature tables, arms, products and placebos."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def override(base: DataFrame, extension: DataFrame, key: str = "date") -> DataFrame:
    """Columns of both tables come from the extension (NULL on days that it lacks); new ones are added."""
    shared = [c for c in base.columns if c in extension.columns and c != key]
    new = [c for c in extension.columns if c not in base.columns]
    out = base.drop(*shared).join(extension, key, "left")
    return out.select(*base.columns, *new)


def numeric_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    """Of the wanted columns those that are there and numeric, in order: decided by the schema, not by data."""
    kinds = dict(df.dtypes)
    return [c for c in wanted if kinds.get(c, "").split("(")[0] in ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")]


def forbidden(columns: list[str], names: set[str] = frozenset(), parts: tuple[str, ...] = ()) -> list[str]:
    """Columns that would tell a model the target."""
    return [c for c in columns if c in names or any(p in c for p in parts)]


def guard(df: DataFrame, names: set[str] = frozenset(), parts: tuple[str, ...] = ()) -> DataFrame:
    if bad := forbidden(df.columns, names, parts):
        raise ValueError(f"forbidden columns: {bad}")
    return df


def arm_columns(groups: dict[str, list[str]], arm: list[str]) -> list[str]:
    """Columns of an arm's groups, one group behind the other; an unknown group is an error."""
    if unknown := [g for g in arm if g not in groups]:
        raise ValueError(f"unknown groups: {unknown}")
    return [c for g in arm for c in groups[g]]


def arm(df: DataFrame, groups: dict[str, list[str]], names: list[str], key: str = "date") -> DataFrame:
    return df.select(key, *arm_columns(groups, names))


def by_prefix(df: DataFrame, prefixes: tuple[str, ...], key: str = "date") -> DataFrame:
    return df.select(key, *[c for c in df.columns if c != key and c.startswith(prefixes)])


def products(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    return df.withColumns({name: F.col(a) * F.col(b) for name, (a, b) in pairs.items()})


def block(df: DataFrame, columns: list[str], key: str = "date") -> DataFrame:
    """Single-precision vectors by day; no columns: no block."""
    return df.select(key, F.array(*[F.col(c).cast("float") for c in columns]).alias("covariates")) if columns else df.select(key, F.lit(None).cast("array<float>").alias("covariates"))


#: Placebo to rows that the block is moved by (fixed values).
ROLLS = {"wrong_lag": 90, "year_shifted": 365}


def roll(df: DataFrame, columns: list[str], by: int) -> DataFrame:
    """Moves the columns' rows on by so many rows, round the end, as a block: a self-join on the row number."""
    at = Window.orderBy("x")
    rows = df.withColumn("_i", F.row_number().over(at) - 1)
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    moved = rows.crossJoin(F.broadcast(n)).select(F.pmod(F.col("_i") + by, F.col("_n").cast("int")).alias("_i"), *columns)
    return rows.drop(*columns).join(moved, "_i").select(*df.columns)


def shuffle_by_md5(df: DataFrame, columns: list[str], by_month: bool, seed: str = "42") -> DataFrame:
    """A portable permutation of the block's rows, within calendar months or over all."""
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col("x").cast("string")))
    keep = df.withColumn("_m", F.month("date") if by_month else F.lit(0))
    to = keep.withColumn("_k", F.row_number().over(Window.partitionBy("_m").orderBy("x")))
    src = keep.withColumn("_k", F.row_number().over(Window.partitionBy("_m").orderBy(order))).select("_m", "_k", *columns)
    return to.drop(*columns).join(src, ["_m", "_k"]).select(*df.columns)


def placebo(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    if kind in ROLLS:
        return roll(df, columns, ROLLS[kind])
    if kind in ("season_shuffled", "permuted"):
        return shuffle_by_md5(df, columns, kind == "season_shuffled")
    raise ValueError(f"unknown placebo {kind!r}")


def exact_permutation(df: DataFrame, columns: list[str], seed: int) -> DataFrame:
    """numpy's permutation of a whole table of days, as one group (the calendar bounds it)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x").reset_index(drop=True)
        k = np.random.default_rng(seed).permutation(len(pdf))
        pdf[columns] = pdf[columns].to_numpy()[k]
        return pdf.drop(columns="_all")

    return df.withColumn("_all", F.lit("a")).groupBy("_all").applyInPandas(run, df.schema)


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns])


def completeness(df: DataFrame, pool: DataFrame, column: str) -> DataFrame:
    """Share of a gap's days on which a covariate is known."""
    days = pool.select("gap_id", F.explode(F.sequence("start", "end")).alias("date")).join(df.select("date", column), "date", "left")
    return days.groupBy("gap_id").agg(F.avg(F.col(column).isNotNull().cast("int")).alias("completeness"))


def call_grid(pool: DataFrame, modes: list[str], arms: list[str], placebos: list[str] | None = None) -> DataFrame:
    """Every call's key: gap|mode|arm[|placebo]. Modes, arms and placebos are short literal lists."""
    out = pool.select("gap_id", "gap_length")
    for name, values in (("context_mode", modes), ("arm", arms), ("placebo_transform", placebos)):
        if values:
            out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    parts = ["gap_id", "context_mode", "arm", *(["placebo_transform"] if placebos else [])]
    return out.withColumn("key", F.concat_ws("|", *parts))


def call_budget(grid: DataFrame, most: int) -> DataFrame:
    if (n := grid.count()) > most:
        raise ValueError(f"{n} calls; {most} are allowed")
    return grid


def daily_from_hours(hours: DataFrame, least: int = 18, expected: int = 24) -> DataFrame:
    """Hourly rows by day: statistics, valid hours, longest run of hours without a value, eligibility at several thresholds."""
    h = F.hour("ts")
    hourly = hours.groupBy("series_id", F.to_date("ts").alias("date"), h.alias("h")).agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("rows"))
    q = lambda p: F.expr(f"percentile(v, {p})")
    days = hourly.groupBy("series_id", "date").agg(
        F.sum("rows").alias("n_rows"), F.count("v").alias("valid_hours"), F.avg("v").alias("mean"), q(0.5).alias("median"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"),
        q(0.1).alias("q10"), q(0.25).alias("q25"), q(0.75).alias("q75"), q(0.9).alias("q90"), F.min(F.when(F.col("v").isNotNull(), F.col("h"))).alias("first_valid_hour"), F.max(F.when(F.col("v").isNotNull(), F.col("h"))).alias("last_valid_hour"),
        F.array_sort(F.collect_set(F.when(F.col("v").isNotNull(), F.col("h")))).alias("hs"),
    )
    marks = F.concat(F.array(F.lit(-1)), F.col("hs"), F.array(F.lit(expected)))
    longest = F.array_max(F.zip_with(F.slice(marks, 2, expected + 2), F.slice(marks, 1, F.size(marks) - 1), lambda b, a: b - a - 1))
    out = days.withColumn("longest_invalid_run_hours", longest).withColumn("coverage_fraction", F.col("valid_hours") / expected).drop("hs")
    return out.withColumns({f"eligible_ge_{k}": F.col("valid_hours") >= k for k in (12, 17, 22)}).withColumn("eligible", F.col("valid_hours") >= least)


def hourly_mean(hours: DataFrame) -> DataFrame:
    """Daily mean of one variable; days with rows but no value stay, with NULL."""
    return hours.groupBy("series_id", F.to_date("ts").alias("date")).agg(F.avg("value").alias("daily_mean"), F.count("value").alias("valid_hours")).withColumn("available", F.col("valid_hours") > 0)


def both_days(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two daily tables side by side, days of either."""
    return a.join(b, "date", "full")
