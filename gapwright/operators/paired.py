"""Paired comparisons of methods with gap-clustered bootstraps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def paired_days(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(gap_id, date, ea, eb, in_a, in_b): absolute errors of two methods on the same days."""
    one = lambda m, e, i: rows.where(F.col("method") == m).select("gap_id", "date", F.abs(F.col("prediction") - F.col("truth")).alias(e), F.lit(True).alias(i))
    out = one(a, "ea", "in_a").join(one(b, "eb", "in_b"), ["gap_id", "date"], "full")
    return out.fillna(False, ["in_a", "in_b"])


def pairing(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Per gap: days of both, of one only, and repeated days."""
    days = paired_days(rows, a, b)
    per = days.groupBy("gap_id").agg(
        F.count_if(F.col("in_a") & F.col("in_b")).alias("n_common"), F.count_if(F.col("in_a") & ~F.col("in_b")).alias("n_only_a"), F.count_if(~F.col("in_a") & F.col("in_b")).alias("n_only_b")
    )
    twice = rows.where(F.col("method").isin(a, b)).groupBy("gap_id", "method", "date").agg((F.count(F.lit(1)) - 1).alias("d")).groupBy("gap_id").agg(F.sum("d").alias("n_repeated"))
    return per.join(twice, "gap_id", "left").fillna(0, ["n_repeated"])


def common_days(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Days that both methods have, repeated ones once; an error is NULL where its prediction or truth is."""
    return paired_days(rows.dropDuplicates(["method", "gap_id", "date"]), a, b).where("in_a and in_b")


def check_pairs(rows: DataFrame, a: str, b: str, mode: str = "strict") -> DataFrame:
    """strict: unequal days or repeated ones are an error. intersection: only common days stay, and what went is told
    by pairing()."""
    if mode not in ("strict", "intersection"):
        raise ValueError(f"unknown mode {mode!r}")
    report = pairing(rows, a, b)
    if mode == "strict":
        bad = report.where("n_only_a > 0 or n_only_b > 0 or n_repeated > 0").limit(3).collect()
        if bad:
            raise ValueError(f"the methods' days differ: {[r.asDict() for r in bad]}")
    return common_days(rows, a, b).where("ea is not null and eb is not null")


def per_gap(days: DataFrame) -> DataFrame:
    """Sufficient statistics of each gap; replicates of means need no more."""
    return days.groupBy("gap_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ea").alias("sa"), F.sum("eb").alias("sb"), F.sum(F.col("ea") * F.col("ea")).alias("qa"), F.sum(F.col("eb") * F.col("eb")).alias("qb")
    )


def replicates(gaps: DataFrame, count: int, seed: str = "42") -> DataFrame:
    """(replicate, n, sa, sb, ...): gaps drawn with replacement by a portable md5 index, as many as there are.

    Draws are generated by replicate and slot and joined to numbered gaps; nothing is collected.
    """
    from pyspark.sql import Window

    numbered = gaps.withColumn("i", F.row_number().over(Window.orderBy("gap_id")) - 1)  # a pool has at most some thousand gaps
    size = gaps.agg(F.count(F.lit(1)).alias("size"))
    spark = gaps.sparkSession
    slots = spark.range(count).withColumnRenamed("id", "replicate").crossJoin(F.broadcast(size)).where("size > 0")
    slots = slots.select("replicate", "size", F.explode(F.sequence(F.lit(0), (F.col("size") - 1).cast("int"))).alias("slot"))
    draws = slots.select("replicate", S.picked(seed, F.col("replicate"), F.col("slot"), modulo=F.col("size")).alias("i"))
    return draws.join(numbered, "i")


def bootstrap(days: DataFrame, count: int = 2000, seed: str = "42") -> DataFrame:
    """Mean errors and their difference (a - b), day- and gap-weighted, with 95 % intervals over replicates."""
    g = per_gap(days).persist()  # read four times, a row for each gap
    day, gap = (F.sum("sa") - F.sum("sb")) / F.sum("n"), F.avg((F.col("sa") - F.col("sb")) / F.col("n"))
    reps = replicates(g, count, seed).groupBy("replicate").agg(day.alias("day"), gap.alias("gap"))
    ci = reps.agg(*[F.expr(f"percentile({c}, {p})").alias(f"{c}_{n}") for c in ("day", "gap") for p, n in ((0.025, "lo"), (0.975, "hi"))])
    point = g.agg(F.count(F.lit(1)).alias("n_gaps"), day.alias("day_delta"), gap.alias("gap_delta"))
    out = point.crossJoin(ci)
    said = (
        F.when(F.col("n_gaps") < 10, "insufficient").when((F.col("gap_lo") < 0) & (F.col("gap_hi") < 0), "improvement").when((F.col("gap_lo") > 0) & (F.col("gap_hi") > 0), "degradation")
        .when(F.abs("gap_delta") < 1e-6, "indistinguishable").otherwise("directional")
    )
    return out.withColumn("interpretation", said)


def exact_bootstrap(days: DataFrame, count: int = 2000, seed: int = 42) -> DataFrame:
    """As bootstrap(), with numpy's generator and all five metrics. One group: (gap, day) errors of one comparison,
    which the pool bounds."""
    schema = ", ".join(f"{m}_{s} double" for m in ("day_mae", "gap_mae", "rmse", "median", "p90") for s in ("a", "b", "delta", "lo", "hi")) + ", n_gaps int"

    def metrics(gaps: list[np.ndarray]) -> np.ndarray:
        e = np.concatenate(gaps)
        return np.array([e.mean(), np.mean([g.mean() for g in gaps]), np.sqrt((e**2).mean()), np.median(e), np.quantile(e, 0.9)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [g for _, g in pdf.sort_values(["gap_id", "date"]).groupby("gap_id")]
        a, b = [g["ea"].to_numpy() for g in own], [g["eb"].to_numpy() for g in own]
        rng = np.random.default_rng(seed)
        reps = []
        for _ in range(count):
            k = rng.integers(0, len(own), len(own))
            reps.append(metrics([a[i] for i in k]) - metrics([b[i] for i in k]))
        ma, mb = metrics(a), metrics(b)
        lo, hi = np.percentile(np.array(reps), [2.5, 97.5], axis=0)
        return pd.DataFrame([[*np.stack([ma, mb, ma - mb, lo, hi], 1).ravel(), len(own)]])

    return days.select("gap_id", F.col("date").cast("string").alias("date"), "ea", "eb", F.lit("all").alias("one")).groupBy("one").applyInPandas(run, schema)


def cluster_interval(values: DataFrame, value: str, count: int = 2000, seed: str = "42") -> DataFrame:
    """Mean of gaps' values with a 95 % interval; no gaps: NULLs."""
    g = values.select("gap_id", F.col(value).alias("v")).where("v is not null").persist()
    reps = replicates(g, count, seed).groupBy("replicate").agg(F.avg("v").alias("m"))
    return g.agg(F.avg("v").alias("mean")).crossJoin(reps.agg(F.expr("percentile(m, 0.025)").alias("lo"), F.expr("percentile(m, 0.975)").alias("hi")))
