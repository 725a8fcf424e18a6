"""All queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import baselines
from ..sources import series
from . import more  # noqa: F401 - registers its queries
from .queries import ORACLE, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main daily series' own gaps, found and interpolated."""
    return baselines.fill_real_gaps(series.main_series(spark, sf_dir)).select("series_id", "gap_id", "date", "prediction")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
