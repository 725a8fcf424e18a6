"""Quantile bands, tail days and tail runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .baselines import seen
from .intervals import islands

EDGES = (0.10, 0.25, 0.50, 0.75, 0.90)
NAMES = ("below_p10", "p10_to_p25", "p25_to_p50", "p50_to_p75", "p75_to_p90", "above_p90")


def edges(daily: DataFrame) -> DataFrame:
    """Exact quantiles of known values, linear between neighbours: (series_id, q array)."""
    return daily.where(seen()).groupBy("series_id").agg(F.expr(f"percentile(value, array({', '.join(map(str, EDGES))}))").alias("q"))


def band(v: Column, q: Column) -> Column:
    """A value that equals an edge is in the band above it."""
    out = F.lit(NAMES[0])
    for i, name in enumerate(NAMES[1:]):
        out = F.when(v >= q[i], name).otherwise(out)
    return F.when(v.isNotNull(), out)


def banded(daily: DataFrame) -> DataFrame:
    return daily.where(seen()).join(edges(daily), "series_id").withColumn("band", band(F.col("value"), F.col("q")))


def tail_days(daily: DataFrame) -> DataFrame:
    """Low: at or below p10 (unlike its band, which excludes the edge). High: at or above p90."""
    return daily.where(seen()).join(edges(daily), "series_id").withColumns({"low": F.col("value") <= F.col("q")[0], "high": F.col("value") >= F.col("q")[4]})


def tail_runs(daily: DataFrame) -> DataFrame:
    """Runs of consecutive tail days: isolated, short (2 to 6) or persistent (7 and more)."""
    days = tail_days(daily)
    both = days.where("low").withColumn("tail", F.lit("low")).unionByName(days.where("high").withColumn("tail", F.lit("high")))
    n = F.col("length")
    return islands(both, "series_id", "tail").withColumn("persistence", F.when(n == 1, "isolated").when(n <= 6, "short").otherwise("persistent"))


def errors_by_band(rows: DataFrame, daily: DataFrame) -> DataFrame:
    """Errors of predictions by the truth's band; rows (series_id, method, prediction, truth)."""
    rows = rows.join(edges(daily), "series_id").withColumn("band", band(F.col("truth"), F.col("q")))
    a = F.abs(F.col("prediction") - F.col("truth"))
    return rows.where(a.isNotNull()).groupBy("method", "band").agg(F.count(F.lit(1)).alias("n_days"), F.avg(a).alias("mae"))
