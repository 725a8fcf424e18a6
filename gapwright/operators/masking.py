"""Masks and leakage control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_mask(daily: DataFrame, gap: DataFrame) -> DataFrame:
    """(gap_id, daily...) with value NULL in each gap's window; other columns are untouched.

    A gap sees its whole series: the join is on series_id, and the gap side is the pool.
    """
    rows = daily.join(gap.select("series_id", "gap_id", "start", "end"), "series_id")
    hidden = F.col("date").between(F.col("start"), F.col("end"))
    return rows.withColumn("value", F.when(~hidden, F.col("value"))).withColumn("hidden", hidden).drop("start", "end")


def visible(daily: DataFrame, gap: DataFrame, pre: int | None = None, post: int | None = None) -> DataFrame:
    """Eligible, known, not hidden rows for each gap; with pre and post, only that near to the gap: then the window's
    days are the join's key."""
    known = daily.where(F.coalesce("eligible", F.lit(False)) & F.col("value").isNotNull())
    gap = gap.select("series_id", "gap_id", "start", "end")
    if pre is not None and post is not None:
        near = gap.withColumn("date", F.explode(F.sequence(F.date_sub("start", pre), F.date_add("end", post))))
        return known.join(near.where(~F.col("date").between(F.col("start"), F.col("end"))), ["series_id", "date"]).select(*daily.columns, "gap_id")
    rows = known.join(gap, "series_id")
    rows = rows.where(~F.col("date").between(F.col("start"), F.col("end")))
    if pre is not None:
        rows = rows.where(F.col("date") >= F.date_sub("start", pre))
    if post is not None:
        rows = rows.where(F.col("date") <= F.date_add("end", post))
    return rows.drop("start", "end")


def leaked(rows: DataFrame, gap: DataFrame) -> DataFrame:
    """Training rows that lie in their own gap: none, if nothing leaks."""
    return rows.join(gap.select("gap_id", "start", "end"), "gap_id").where(F.col("date").between(F.col("start"), F.col("end")))


def dependency_window(pool: DataFrame, lookback: int, lookahead: int) -> DataFrame:
    if lookback < 0 or lookahead < 0:
        raise ValueError("windows can't be negative")
    return pool.withColumn("dep_start", F.date_sub("start", lookback)).withColumn("dep_end", F.date_add("end", lookahead))


def outside(rows: DataFrame, window: DataFrame) -> DataFrame:
    """Rows outside each gap's dependency window."""
    w = window.select("series_id", "gap_id", "dep_start", "dep_end")
    return rows.join(w, "series_id").where(~F.col("date").between(F.col("dep_start"), F.col("dep_end"))).drop("dep_start", "dep_end")


def admissible(table: DataFrame, pool: DataFrame) -> DataFrame:
    """(held_out, rows of table): rows of other gaps whose span of source days doesn't touch the held-out gap."""
    held = pool.select("series_id", F.col("gap_id").alias("held_out"), F.unix_date("start").alias("a0"), F.unix_date("end").alias("a1"))
    apart: Column = (F.col("dep_max") < F.col("a0")) | (F.col("dep_min") > F.col("a1"))
    return table.join(held, "series_id").where((F.col("gap_id") != F.col("held_out")) & apart).drop("a0", "a1")
