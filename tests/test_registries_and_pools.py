"""Registries, pools and model definitions against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapwright.operators import dispatch, intervals, models, pools, registries
from gapwright.sources import series


@pytest.fixture(scope="module")
def daily(spark):
    rng = random.Random(3)
    rows = [("S", k, float(rng.randrange(1, 900)) / 10 if k % 41 else None, rng.random() > 0.03) for k in range(700)]
    df = spark.createDataFrame(rows, "series_id string, k int, value double, eligible boolean")
    return df.select("series_id", F.date_add(F.to_date(F.lit("2020-01-01")), F.col("k")).alias("date"), "value", "eligible").withColumn("x", F.unix_date("date"))


def test_arms_are_safe_and_counted():
    assert len(registries.ARMS) == 18 and len(registries.PRIMARY) == 6 and len(registries.RAW_ARMS) == 9
    with pytest.raises(ValueError):
        registries.check_arms({"x": ("audited", ("proxy",))})
    assert registries.is_diagnostic("external_all_available") and not registries.is_diagnostic("target_only")
    assert all(a in registries.ARMS for a in registries.PLACEBO_ARMS)
    with pytest.raises(ValueError):
        registries.status_of("other", None)


def test_methods_and_artifacts(spark):
    m = {r["method_id"]: r["support_status"] for r in registries.methods(spark).collect()}
    assert len(m) == 10 and m["engineered_hybrid"] == "new_evaluation_on_matched_449" and m["gp_m1"] == "frozen_matched_449"
    a = registries.artifacts(spark).collect()
    assert sum(r["is_candidate"] for r in a) == 4 and not registries.RAW_CANDIDATES_EXIST


def test_core_and_extended_pool(daily):
    pool = pools.core_and_extended(daily, [1, 7, 10]).toPandas()
    whole = pools.core_and_extended(daily, [1, 7, 10, 21, 45, 60]).toPandas()
    assert set(pool["part"]) == {"core", "extended"}
    # the shared generator passes every extended length whichever are asked for
    assert set(pool.loc[pool["gap_length"] == 10, "gap_id"]) == set(whole.loc[whole["gap_length"] == 10, "gap_id"])
    for n, g in pool.groupby("gap_length"):
        starts = sorted(g["start"])
        assert len(starts) <= 100 and all((b - a).days >= n for a, b in zip(starts, starts[1:]))
    with pytest.raises(ValueError):
        pools.core_and_extended(daily, [1, 8])
    with pytest.raises(ValueError):
        pools.neutral(daily, [])


def test_pool_by_role_has_context(daily):
    pool = pools.by_role(daily.withColumn("eligible", F.lit(True)), (1, 3), (7,)).toPandas()
    assert len(pool) == 0  # a missing value every 41 days leaves no run with 30 days on both sides
    full = daily.withColumn("eligible", F.lit(True)).withColumn("value", F.coalesce("value", F.lit(1.0)))
    pool = pools.by_role(full, (1, 3), (7,)).toPandas()
    assert (pool["context_before_days"] >= 30).all() and (pool["context_after_days"] >= 30).all()
    assert set(pool.loc[pool["is_mandatory"], "gap_length"]) == {1, 3} and (pool["support_role"] == "primary").all()
    assert (pool.sort_values("start").groupby("gap_length")["sample_order_index"].apply(lambda s: (s.to_numpy() == np.arange(len(s))).all())).all()


def test_illustrative_pool_warns(daily):
    with pytest.warns(UserWarning, match="500 days"):
        pool = pools.illustrative(daily, [1, 500]).toPandas()
    assert set(pool["gap_length"]) == {1} and len(pool) == 100


def test_artificial_gap(daily, spark):
    one = intervals.eligible_runs(daily.withColumn("eligible", F.col("value").isNotNull())).where("length >= 5").orderBy("start").first()
    start, end = str(one["start"]), str(one["start"].replace(day=one["start"].day + 2))
    masked, truth = pools.artificial_gap(daily, start, end)
    assert masked.where("in_gap and value is not null").count() == 0 and truth.count() == 3
    assert masked.where("not in_gap").exceptAll(daily.withColumn("in_gap", F.lit(False)).select(*masked.columns)).count() == 0
    with pytest.raises(ValueError, match="twice"):
        pools.artificial_gap(daily.unionByName(daily.limit(1)), start, end)
    hole = daily.where("value is null").select(F.col("date").cast("string")).first()[0]
    with pytest.raises(ValueError, match="observed"):
        pools.artificial_gap(daily, hole, hole)
    with pytest.raises(ValueError):
        pools.scored_artificial_gap(truth.where("false").withColumn("prediction", F.lit(1.0)).drop("truth"), truth)


def test_classical_inputs(daily):
    features = daily.select("date", F.lit(1.0).alias("f"))
    assert series.classical_inputs(daily, features)[0] is daily
    with pytest.raises(ValueError):
        series.classical_inputs(daily, features.union(features.limit(1)))


def test_likelihood_is_that_of_the_joint_normal():
    """The filter's likelihood is the density of all values, the first one's too."""
    rng = np.random.default_rng(1)
    y, q, r = rng.normal(size=8), 0.4, 0.7
    n = len(y)
    cov = r * 10 + q**2 * np.minimum.outer(np.arange(n), np.arange(n)) + r**2 * np.eye(n)
    e = y - y[0]
    want = -0.5 * (e @ np.linalg.solve(cov, e) + np.linalg.slogdet(cov)[1] + n * np.log(2 * np.pi))
    assert abs(models.log_likelihood(y, q, r) - want) < 1e-9
    gappy = np.insert(y, 3, np.nan)
    at = np.delete(np.arange(n + 1), 3)
    cov = r * 10 + q**2 * np.minimum.outer(at, at) + r**2 * np.eye(n)
    want = -0.5 * (e @ np.linalg.solve(cov, e) + np.linalg.slogdet(cov)[1] + n * np.log(2 * np.pi))
    assert abs(models.log_likelihood(gappy, q, r) - want) < 1e-9


def test_fit_kalman_finds_the_noise():
    rng = np.random.default_rng(2)
    y = np.cumsum(rng.normal(0, 0.05, 1500)) + rng.normal(0, 0.4, 1500)
    q, r = models.fit_kalman(y)
    assert 0.02 < q < 0.1 and 0.35 < r < 0.45
    assert models.fit_kalman(np.full(5, np.nan)) == (0.1 * 0.3, 0.3)


def test_gaussian_process_keeps_its_bounds():
    rng = np.random.default_rng(5)
    x = np.linspace(-3, 3, 40)[:, None]
    y = np.sin(x[:, 0] * 2) + rng.normal(0, 0.05, 40)
    m, s = models.gp_fit(x, y, np.array([[0.0], [1.0]]))
    assert np.abs(m - np.sin([0.0, 2.0])).max() < 0.15 and (s > 0).all() and (s < 0.5).all()
    assert models.gp_fit(x[:4], y[:4], x[:1]) is None


def test_extra_trees():
    rng = np.random.default_rng(6)
    x = rng.random((300, 4))
    y = 3 * x[:, 1] + (x[:, 2] > 0.5)
    z = rng.random((60, 4))
    p = models.extra_trees(x, y, z, trees=60)
    assert np.corrcoef(p, 3 * z[:, 1] + (z[:, 2] > 0.5))[0, 1] > 0.95
    assert np.allclose(models.extra_trees(x, y, x, trees=5), y)  # a row is in a leaf of its own
    assert np.allclose(models.extra_trees(x, np.full(300, 2.5), z, trees=3), 2.5)
    assert (models.extra_trees(x, y, z, trees=60) == p).all() and p.min() >= y.min() and p.max() <= y.max()
    assert np.allclose(models.extra_trees(x[:1], y[:1], z, trees=2), y[0])


def test_method_dispatch(daily):
    features = daily.select("date", "x", (F.col("x") % 7).cast("double").alias("week"), (F.col("value") * 0 + 1).alias("one"))
    pool = intervals.block_sample(intervals.candidate_starts(intervals.eligible_runs(daily), [1, 7])).orderBy("start").limit(12).cache()
    days = pool.agg(F.sum("gap_length")).first()[0]
    for method in [m.method_id for m in registries.METHODS if m.role == "classical_benchmark"]:
        options = {"trees": 5} if "extratrees" in method or method == "tier_ch_deployed" else {"rounds": 5} if method.endswith("hgb") else {}
        if method == "engineered_hybrid":
            options = {"trees": 5}
        rows = dispatch.predict(method, daily, features, pool, **options).toPandas()
        assert len(rows) == days and rows["gap_id"].nunique() == 12, method
    with pytest.raises(ValueError):
        dispatch.predict("other", daily, features, pool)
