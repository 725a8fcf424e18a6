"""Benchmark methods by identifier: (series_id, gap_id, x, prediction) on the logarithm's scale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import baselines, edges, masking, models

_LEARNERS = {"extratrees": "extra_trees", "hgb": "hist_boosted"}


def _logs(daily: DataFrame) -> DataFrame:
    return daily.withColumn("y", F.when(F.col("eligible"), S.guarded_log10(F.col("value"))))


def _gap_edge(daily: DataFrame, held: DataFrame, pool: DataFrame, **options) -> DataFrame:
    """Residuals over the anchor, learned from the other gaps' admissible rows."""
    table, keep = edges.edge_table(daily, pool), [*edges.predictors(), "residual_log", "anchor_log"]
    train = masking.admissible(table, held).select("held_out", "x", *keep)
    test = table.join(held.select("gap_id"), "gap_id", "left_semi").select("series_id", "gap_id", "x", *keep)
    return models.leave_one_gap_out(test, train, edges.predictors(), "residual_log", "extra_trees", anchor="anchor_log", **options)


def _with_places(daily: DataFrame, features: DataFrame, pool: DataFrame, learner: str, columns: list[str], **options) -> DataFrame:
    """External features and the place in the gap, learned from the other gaps' admissible rows."""
    table = edges.edge_table(daily, pool).join(features.drop("x"), "date", "left")
    f = [*columns, *edges.meta()]
    train = masking.admissible(table, pool).select("held_out", "x", *f, "truth_log")
    return models.leave_one_gap_out(table.select("series_id", "gap_id", "x", *f, "truth_log"), train, f, "truth_log", learner, **options)


def _external(daily: DataFrame, features: DataFrame, pool: DataFrame, learner: str, columns: list[str], **options) -> DataFrame:
    """External features alone, learned from every day outside the gap."""
    test, train = models.external_rows(_logs(daily), features, pool)
    return models.leave_one_gap_out(test.select("series_id", "gap_id", "x", *columns, "y"), train.select("held_out", "x", *columns, "y"), columns, "y", learner, **options)


def predict(method_id: str, daily: DataFrame, features: DataFrame, pool: DataFrame, **options) -> DataFrame:
    """One of the eight classical methods; options go to its learner. An unknown identifier is an error."""
    columns = [c for c in features.columns if c not in ("date", "x")]
    if method_id == "canonical_interpolation":
        out = baselines.log_linear(daily, pool)
    elif method_id == "gp_m1":
        out = models.gp_gaps(_logs(daily), pool, fixed=False)
    elif method_id in ("ext_tabular_extratrees", "ext_tabular_hgb"):
        out = _with_places(daily, features, pool, _LEARNERS[method_id.rsplit("_", 1)[1]], columns, **options)
    elif method_id in ("external_only_extratrees", "external_only_hgb"):
        out = _external(daily, features, pool, _LEARNERS[method_id.rsplit("_", 1)[1]], columns, **options)
    elif method_id == "tier_ch_deployed":
        out = _gap_edge(daily, pool, pool, **options)
    elif method_id == "engineered_hybrid":
        routed = pool.withColumn("method", S.route(F.col("gap_length")))
        own = lambda m: pool.join(routed.where(F.col("method") == m).select("gap_id"), "gap_id", "left_semi")
        logs = _logs(daily)
        parts = {
            "gaussian_process": models.gp_gaps(logs, own("gaussian_process"), fixed=False),
            "kalman": models.kalman_gaps(logs, own("kalman"), models.kalman_parameters(logs)),
            "gap_edge": _gap_edge(daily, own("gap_edge"), pool, **options),
        }
        out = models.hybrid(routed, parts)
    else:
        raise ValueError(f"unknown method {method_id!r}")
    return out.select("series_id", "gap_id", "x", "prediction")
