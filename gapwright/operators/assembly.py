"""Routing, assembly and validation of candidate reconstructions; verification against frozen results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

ROLES = {"hybrid": "engineered candidate", "sequence": "sequence-model candidate"}
LABELS = ("observed", "candidate", "missing")


def route(gaps: DataFrame, rule: str = "D") -> DataFrame:
    """A method for each real gap with a right edge; without one there is none. The left edge doesn't matter."""
    return gaps.withColumn("method", F.when(F.col("post_edge"), S.route(F.col("length"), rule)))


def hybrid_candidates(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("is_reconstructed")).select("gap_id", "date", F.col("final_value").alias("hybrid_pred"), F.col("method").alias("component_method"))


def sequence_candidates(rows: DataFrame) -> DataFrame:
    return rows.select("gap_id", "date", F.col("pred").alias("sequence_pred"), "quantiles")


def assemble(hybrid: DataFrame, sequence: DataFrame) -> DataFrame:
    """Days of either candidate; nothing is filled and nothing dropped."""
    return hybrid.join(sequence, ["gap_id", "date"], "full")


def violations(days: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row (rule, n): repeated days, values that aren't finite, quantiles that fall, days outside their gap, unknown gaps."""
    rows = days.join(gaps.select("gap_id", "start", "end"), "gap_id", "left")
    bad = lambda c: F.col(c).isNotNull() & (F.isnan(c) | (F.abs(c) == float("inf")))
    falls = F.exists(F.zip_with(F.slice("quantiles", 2, 99), F.slice("quantiles", 1, F.greatest(F.size("quantiles") - 1, F.lit(0))), lambda b, a: b < a - 1e-9), lambda x: x)
    counts = rows.agg(
        F.count_if(bad("hybrid_pred") | bad("sequence_pred")).alias("not_finite"), F.count_if(F.coalesce(falls, F.lit(False))).alias("quantiles_fall"),
        F.count_if(F.col("start").isNull()).alias("unknown_gap"), F.count_if(~F.col("date").between(F.col("start"), F.col("end"))).alias("outside_gap"),
    )
    twice = days.groupBy("gap_id", "date").agg(F.count(F.lit(1)).alias("k")).agg(F.count_if(F.col("k") > 1).alias("repeated_day"))
    names = ["not_finite", "quantiles_fall", "unknown_gap", "outside_gap", "repeated_day"]
    return counts.crossJoin(twice).select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in names])).alias("r")).select("r.*")


def validated(days: DataFrame, gaps: DataFrame) -> DataFrame:
    if bad := violations(days, gaps).where("n > 0").collect():
        raise ValueError(f"invalid candidates: {[(r['rule'], r['n']) for r in bad]}")
    return days


def gap_level(days: DataFrame, gaps: DataFrame) -> DataFrame:
    """Per gap: days, which candidates there are, their means, the first day's component method."""
    per = days.groupBy("gap_id").agg(
        F.count(F.lit(1)).alias("n_days"), F.max(F.col("hybrid_pred").isNotNull()).alias("has_hybrid"), F.max(F.col("sequence_pred").isNotNull()).alias("has_sequence"),
        F.avg("hybrid_pred").alias("hybrid_mean"), F.avg("sequence_pred").alias("sequence_mean"), F.min_by("component_method", F.when(F.col("component_method").isNotNull(), F.col("date"))).alias("component_method"),
    )
    out = gaps.select("gap_id", "length", "gap_class").join(per, "gap_id", "left").fillna(0, ["n_days"]).fillna(False, ["has_hybrid", "has_sequence"])
    note = F.when(F.col("has_hybrid") & F.col("has_sequence"), "both candidates").when(F.col("has_hybrid"), "hybrid only").when(F.col("has_sequence"), "sequence only").otherwise("no candidate")
    return out.withColumn("support_note", note).withColumn("beyond_validation", F.col("length") > 30)


def divergence(days: DataFrame, n: int = 10) -> DataFrame:
    """The days on which the candidates differ most."""
    return days.withColumn("gap", F.abs(F.col("hybrid_pred") - F.col("sequence_pred"))).where("gap is not null").orderBy(F.desc("gap"), "gap_id", "date").limit(n)


def labelled(daily: DataFrame, days: DataFrame) -> DataFrame:
    """Every day with what its value is: observed, a candidate (never an observation), or missing."""
    rows = daily.join(days.select("date", "gap_id", "hybrid_pred", "sequence_pred"), "date", "left")
    seen = F.coalesce("eligible", F.lit(False)) & F.col("value").isNotNull()
    return rows.withColumn("evidence_label", F.when(seen, LABELS[0]).when(F.coalesce("hybrid_pred", "sequence_pred").isNotNull(), LABELS[1]).otherwise(LABELS[2]))


def verify(ours: DataFrame, frozen: DataFrame, keys: list[str], metrics: list[str], tolerance: dict[str, float], default: float = 1e-6) -> DataFrame:
    """(keys, metric, ours, frozen, status): both tables unpivoted and joined in full."""
    a = ours.unpivot(keys, metrics, "metric", "ours")
    b = frozen.unpivot(keys, metrics, "metric", "frozen")
    tol = F.lit(default)
    for m, t in tolerance.items():
        tol = F.when(F.col("method") == m, F.lit(t)).otherwise(tol)
    return a.join(b, [*keys, "metric"], "full").withColumn("status", S.difference_class(F.col("ours"), F.col("frozen"), tol))


def overall(checked: DataFrame) -> DataFrame:
    """One status per method."""
    n = F.count(F.lit(1))
    good = F.count_if(F.col("status").isin("exact", "numerically_equal", "within_tolerance"))
    bad = F.count_if(F.col("status") == "mismatched")
    known = F.count_if(F.col("status") != "unavailable")
    out = checked.groupBy("method").agg(n.alias("n"), good.alias("n_good"), bad.alias("n_bad"), known.alias("n_known"))
    return out.withColumn("overall", F.when(F.col("n_known") == 0, "not_applicable").when(F.col("n_good") == F.col("n"), "reproduced").when(F.col("n_bad") == 0, "partial").otherwise("mismatched"))


def repeatability(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs (key, date, prediction): days of one only, the greatest difference, and what that means."""
    rows = a.withColumnRenamed("prediction", "pa").withColumn("ia", F.lit(1)).join(b.withColumnRenamed("prediction", "pb").withColumn("ib", F.lit(1)), ["key", "date"], "full")
    out = rows.agg(F.count_if(F.col("ia").isNull() | F.col("ib").isNull()).alias("n_unpaired"), F.max(F.abs(F.col("pa") - F.col("pb"))).alias("max_difference"), F.count_if(~F.col("pa").eqNullSafe(F.col("pb"))).alias("n_unequal"))
    return out.withColumn("verdict", F.when((F.col("n_unpaired") == 0) & (F.col("n_unequal") == 0), "bitwise").when((F.col("n_unpaired") == 0) & (F.col("max_difference") < 1e-6), "numerical").otherwise("not_repeatable"))


def integrity(rows: DataFrame, pool: DataFrame) -> DataFrame:
    """(check, n): gaps without predictions, repeated days, rows against hidden days, predictions that aren't finite."""
    lost = pool.select("gap_id").join(rows, "gap_id", "left_anti").agg(F.count(F.lit(1)).alias("missing_gaps"))
    twice = rows.groupBy("gap_id", "date").agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("repeated_rows"))
    count = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.isnan("prediction")).alias("not_finite"))
    want = pool.agg(F.sum("gap_length").alias("want"))
    wide = lost.crossJoin(twice).crossJoin(count).crossJoin(want).withColumn("row_difference", F.col("n") - F.col("want"))
    names = ["missing_gaps", "repeated_rows", "row_difference", "not_finite"]
    return wide.select(F.explode(F.array(*[F.struct(F.lit(x).alias("check"), F.col(x).cast("long").alias("n")) for x in names])).alias("r")).select("r.*")


def demo_score(candidates: DataFrame) -> DataFrame:
    """An additive score of demo gaps (length, completeness, n_context, is_event): less is better."""
    return candidates.withColumn(
        "score",
        F.abs(F.col("length") - 14) * 0.1 + F.when(F.col("is_event"), 0.0).otherwise(1.0) + (1 - F.col("completeness")) * 2 + F.when(F.col("n_context") < 60, 0.5).otherwise(0.0),
    )


def demo_candidates(candidates: DataFrame, n: int = 10) -> DataFrame:
    """The n best demo gaps by score, each with what speaks against it."""
    said = F.array(
        F.when(F.col("length") != 14, F.concat(F.lit("length "), F.col("length").cast("string"))), F.when(~F.col("is_event"), F.lit("no event")),
        F.when(F.col("completeness") < 1, F.lit("covariates missing")), F.when(F.col("n_context") < 60, F.lit("little context")),
    )
    reason = F.array_join(F.array_compact(said), "; ")
    return demo_score(candidates).withColumn("reason", F.when(reason == "", F.lit("nothing")).otherwise(reason)).orderBy("score", "gap_id").limit(n)
