"""Extensions for streams: hourly readings to days, and sessions of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_means(hours: DataFrame, late: str = "2 hours") -> DataFrame:
    """(series_id, date, mean, n) of a stream or table with (series_id, ts, value); late readings within the watermark count."""
    days = hours.withWatermark("ts", late).groupBy("series_id", F.window("ts", "1 day")).agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    return days.select("series_id", F.to_date("window.start").alias("date"), "mean", "n")


def observed_sessions(hours: DataFrame, gap: str = "3 hours", late: str = "1 day") -> DataFrame:
    """Stretches of readings that are parted by more than gap without any."""
    s = hours.withWatermark("ts", late).groupBy("series_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return s.select("series_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
