"""Baselines, scores, paired tests, tails, models and runs."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapwright.operators import assembly, backends, baselines, edges, ledger, masking, models, paired, scoring, tails
from gapwright.sources import series

DAY = dt.date(2020, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


@pytest.fixture(scope="module")
def daily(spark):
    rng = np.random.default_rng(0)
    rows = [("a", day(k), float(10 + 3 * math.sin(k / 9) + rng.normal(0, 0.2)), k % 11 != 4) for k in range(200)]
    return spark.createDataFrame(rows, "series_id string, date date, value double, eligible boolean").withColumn("x", F.unix_date("date")).cache()


@pytest.fixture(scope="module")
def pool(spark):
    rows = [("a", f"g{s}", n, day(s), day(s + n - 1)) for s, n in ((20, 3), (60, 7), (120, 5), (160, 2))]
    return spark.createDataFrame(rows, "series_id string, gap_id string, gap_length int, start date, end date").cache()


def test_interpolations_differ(spark):
    d = spark.createDataFrame([("a", day(5), 1.0, True), ("a", day(15), 100.0, True)], "series_id string, date date, value double, eligible boolean").withColumn("x", F.unix_date("date"))
    p = spark.createDataFrame([("a", "g", 9, day(6), day(14))], "series_id string, gap_id string, gap_length int, start date, end date")
    log, phys = ({r["date"]: r["prediction"] for r in f(d, p).collect()} for f in (baselines.log_linear, baselines.anchor))
    assert log[day(10)] == pytest.approx(1.0) and phys[day(10)] == pytest.approx(math.log10(50.5))
    lost = spark.createDataFrame([("a", "h", 3, day(16), day(18))], p.schema)
    assert [r["prediction"] for r in baselines.log_linear(d, lost).collect()] == [None] * 3
    assert [r["prediction"] for r in baselines.persistence(d, p).collect()] == [1.0] * 9
    with pytest.raises(ValueError):
        baselines.predict("guess", d, p)


def test_climatology_without_the_gap(daily, pool):
    pdf = daily.toPandas()
    own = pdf[pdf["eligible"]]
    got = {(r["gap_id"], r["date"]): r["prediction"] for r in baselines.climatology(daily, pool).collect()}
    for r in pool.collect():
        rest = own[(own["date"] < r["start"]) | (own["date"] > r["end"])]
        same = rest[[d.month == r["start"].month for d in rest["date"]]]
        assert got[r["gap_id"], r["start"]] == pytest.approx(same["value"].mean(), abs=1e-9)


@pytest.mark.parametrize("method", sorted(baselines.METHODS))
def test_hidden_truth_changes_nothing(daily, pool, method):
    hidden = F.lit(False)
    for r in pool.collect():
        hidden = hidden | F.col("date").between(F.lit(r["start"]), F.lit(r["end"]))
    one = pool.where("gap_id = 'g60'")
    start, end = one.first()["start"], one.first()["end"]
    changed = daily.withColumn("value", F.when(F.col("date").between(F.lit(start), F.lit(end)), 999.0).otherwise(F.col("value")))
    a, b = (sorted((r["date"], r["prediction"]) for r in baselines.predict(method, d, one).collect()) for d in (daily, changed))
    assert [x for x, _ in a] == [x for x, _ in b]
    assert all(p == q or abs(p - q) < 1e-9 for (_, p), (_, q) in zip(a, b, strict=True))


def test_edge_features(daily, pool):
    pdf = daily.toPandas()
    pdf = pdf[pdf["eligible"]].sort_values("x")
    for r in edges.edge_features(daily, pool).collect():
        before, after = pdf[pdf["date"] < r["start"]], pdf[pdf["date"] > r["end"]]
        a0 = (r["start"] - dt.date(1970, 1, 1)).days
        near = before[before["x"] >= a0 - 7]
        assert r["pre_last"] == before["value"].iloc[-1] and r["post_first"] == after["value"].iloc[0]
        assert r["pre_delta"] == pytest.approx(before["value"].iloc[-1] - before["value"].iloc[-2])
        assert r["post_delta"] == pytest.approx(after["value"].iloc[1] - after["value"].iloc[0])
        assert r["pre_mean_7d"] == pytest.approx(near["value"].mean()) and r["pre_std_7d"] == pytest.approx(near["value"].std())
        assert r["pre_slope_7d"] == pytest.approx(np.polyfit(near["x"], near["value"], 1)[0])
        assert r["dep_pre_min"] == before[before["x"] >= a0 - 14]["x"].min()
    assert set(edges.predictors(True)) < set(edges.predictors())


def test_scores_by_day_and_by_gap(spark):
    rows = [("m", "g1", 5, 0.1, 0.0)] * 5 + [("m", "g2", 1, 1.0, 0.0), ("m", "g2", 1, None, 0.0)]
    s = scoring.scores(spark.createDataFrame(rows, "method string, gap_id string, gap_length int, prediction double, truth double"), "method").first()
    assert (s["n_gaps"], s["n_days"]) == (2, 6) and s["day_weighted_mae"] == pytest.approx(0.25) and s["gap_weighted_mae"] == pytest.approx(0.55)


def test_missing_values_on_the_log_scale(spark):
    rows = spark.createDataFrame([(None, 10.0), (100.0, None), (-1.0, 1.0)], "prediction double, truth double")
    assert [tuple(r) for r in scoring.on_log_scale(rows).collect()] == [(None, 1.0), (2.0, None), (-4.0, 0.0)]
    assert [tuple(r) for r in scoring.on_log_scale(rows, missing_at_floor=True).collect()] == [(-4.0, 1.0), (2.0, -4.0), (-4.0, 0.0)]


def test_ranks_share_ties(spark):
    rows = [("a", "g", 1.0), ("b", "g", 1.0), ("c", "g", 2.0)]
    out = {r["method"]: r["mean_rank"] for r in scoring.ranks(spark.createDataFrame(rows, "method string, gap_id string, mae double")).collect()}
    assert out == {"a": 1.5, "b": 1.5, "c": 3.0}


def test_methods_without_an_error_rank_last_or_not_at_all(spark):
    rows = spark.createDataFrame([("a", "g", 1.0), ("b", "g", None), ("c", "g", None), ("a", "h", 2.0), ("b", "h", 1.0)], "method string, gap_id string, mae double")
    told = lambda df: {r["method"]: (r["mean_rank"], r["n_gaps"]) for r in df.collect()}
    assert told(scoring.ranks(rows)) == {"a": (1.5, 2), "b": (1.0, 1)}
    assert told(scoring.ranks(rows, missing_last=True)) == {"a": (1.5, 2), "b": (1.75, 2), "c": (2.5, 1)}


def _pairs(spark, extra=()):
    rows = [(m, f"g{g}", day(k), 1.0 + (0.1 if m == "a" else 0.3) * (1 + g % 2), 1.0) for m in "ab" for g in range(12) for k in range(3)]
    return spark.createDataFrame(rows + list(extra), "method string, gap_id string, date date, prediction double, truth double")


def test_paired_comparison(spark):
    out = paired.bootstrap(paired.check_pairs(_pairs(spark), "a", "b"), 100).first()
    assert out["interpretation"] == "improvement" and out["gap_delta"] == pytest.approx(-0.3) and out["gap_lo"] <= out["gap_delta"] <= out["gap_hi"]
    exact = paired.exact_bootstrap(paired.check_pairs(_pairs(spark), "a", "b"), 100).first()
    assert exact["gap_mae_delta"] == pytest.approx(-0.3) and exact["gap_mae_lo"] < 0 and exact["n_gaps"] == 12


def test_pairing_is_checked(spark):
    more = _pairs(spark, [("a", "g1", day(9), 1.0, 1.0), ("b", "g2", day(0), 1.0, 1.0)])
    with pytest.raises(ValueError):
        paired.check_pairs(more, "a", "b")
    assert paired.check_pairs(more, "a", "b", "intersection").count() == 36
    report = {r["gap_id"]: r for r in paired.pairing(more, "a", "b").collect()}
    assert report["g1"]["n_only_a"] == 1 and report["g2"]["n_repeated"] == 1
    with pytest.raises(ValueError):
        paired.check_pairs(more, "a", "b", "guess")


def test_tails(spark):
    q = F.array(*[F.lit(float(v)) for v in (4, 5, 6, 7, 8)])
    v = spark.createDataFrame([(x,) for x in (1.0, 4.0, 4.5, 5.5, 6.5, 7.5, 9.0, None)], "v double")
    assert [r[0] for r in v.select(tails.band(F.col("v"), q)).collect()] == ["below_p10", "p10_to_p25", "p10_to_p25", "p25_to_p50", "p50_to_p75", "p75_to_p90", "above_p90", None]
    d = spark.createDataFrame([("a", day(k), float(x), True) for k, x in enumerate([0, 0, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 9, 9])], "series_id string, date date, value double, eligible boolean").withColumn("x", F.unix_date("date"))
    runs = sorted((r["tail"], r["length"], r["persistence"]) for r in tails.tail_runs(d).collect())
    assert ("low", 2, "short") in runs and ("high", 2, "short") in runs


def test_kalman_without_noise_is_interpolation():
    y = np.array([1.0, 2.0, np.nan, np.nan, 5.0, 4.0, np.nan, 2.0])
    s, _ = models.kalman(y, 1.0, 1e-12)
    assert np.allclose(s, [1, 2, 3, 4, 5, 4, 3, 2], atol=1e-6)
    walk = np.cumsum(np.random.default_rng(1).normal(0, 1, 300))
    best = models.log_likelihood(walk, *models.fit_kalman(walk))
    assert all(best >= models.log_likelihood(walk, q, r) - 1e-3 for q in (0.5, 0.8, 1.0, 1.2) for r in (0.01, 0.3, 0.5, 1.0))


def test_kalman_gaps_see_the_whole_series(spark):
    rng = np.random.default_rng(4)
    y = np.concatenate([rng.normal(100, 5, 500), rng.normal(0, 5, 400)])
    daily = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(y)], "series_id string, x int, y double")
    pool = spark.createDataFrame([("s", "g", 600, 606)], "series_id string, gap_id string, a int, b int").selectExpr("series_id", "gap_id", "date_from_unix_date(a) as start", "date_from_unix_date(b) as end")
    parameters = spark.createDataFrame([("s", 0.01, 5.0, False)], "series_id string, sigma_q double, sigma_r double, degenerate boolean")
    masked = y.copy()
    masked[600:607] = np.nan
    s, v = models.kalman(masked, 0.01, 5.0)
    got = models.kalman_gaps(daily, pool, parameters).toPandas().sort_values("x")
    assert got["x"].tolist() == list(range(600, 607))
    assert np.allclose(got["prediction"], s[600:607]) and np.allclose(got["spread"], v[600:607])


def test_gaussian_process_interpolates():
    x, y = np.arange(12.0), np.sin(np.arange(12.0) / 2)
    m, s = models.gp_fixed(x, y, x, noise=1e-8)
    assert np.allclose(m, y, atol=1e-4) and (s < 0.05).all()
    assert models.gp_fit(x[:4, None], y[:4], x[:1, None]) is None


def test_learners():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    y = 2 * x[:, 0] - x[:, 1] + rng.normal(0, 0.05, 300)
    for name, limit in (("ridge", 0.1), ("elastic_net", 0.3), ("extra_trees", 0.9), ("random_forest", 0.9), ("boosted", 0.9), ("hist_boosted", 0.9)):
        opt = {"trees": 20} if name in ("extra_trees", "random_forest") else {}
        e = models.learner(name)(x[:250], y[:250], x[250:], **opt) - y[250:]
        assert np.abs(e).mean() < limit, name
    assert np.allclose(models.ridge(np.array([[0.0], [1.0]]), np.array([0.0, 1.0]), np.array([[2.0]]), alpha=0.5), 1.25)
    with pytest.raises(ValueError):
        models.learner("oracle")


def test_leave_one_gap_out(daily, pool):
    table = edges.edge_table(daily, pool)
    f = ["position", "pre_last_log", "post_first_log"]
    keep = [*f, "residual_log", "anchor_log"]
    train = masking.admissible(table, pool).select("held_out", "x", *keep)
    spans = masking.admissible(table, pool).join(pool.select(F.col("gap_id").alias("held_out"), F.unix_date("start").alias("h0"), F.unix_date("end").alias("h1")), "held_out")
    assert spans.where("dep_max >= h0 and dep_min <= h1").count() == 0
    out = models.leave_one_gap_out(table.select("series_id", "gap_id", "x", *keep), train, f, "residual_log", "ridge", anchor="anchor_log", least=3).toPandas()
    assert len(out) == 17 and out["prediction"].between(0.7, 1.3).all()
    assert models.leave_one_gap_out(table.select("series_id", "gap_id", "x", *keep), train, f, "residual_log", "ridge", least=99).where("prediction is not null").count() == 0


def test_backends(daily, pool):
    y = series.model_series(daily, log=False)
    out = backends.infer(y, pool, backends.Stand()).collect()
    assert len(out) == 17 and all(r["error"] is None and sorted(r["quantiles"]) == r["quantiles"] for r in out)

    class Broken(backends.Stand):
        def impute(self, s, c):
            m, q = super().impute(s, c)
            return m, q[:, ::-1]

    assert {r["error"] for r in backends.infer(y, pool, Broken()).collect()} == {"BackendError: quantiles fall"}
    assert not backends.load(lambda: 1 / 0).live
    with pytest.raises(backends.BackendError):
        backends.require(lambda: 1 / 0)
    with pytest.raises(backends.BackendError):
        backends.covariate_batch(np.zeros(3))
    assert backends.covariate_batch(np.zeros((3, 2))).shape == (1, 3, 2)

    class Covered(backends.Stand):
        def impute(self, s, c):
            assert c.dtype == np.float32 and c.shape == (1, len(s), 2) and np.isnan(c[0, :, 1]).all()
            return super().impute(np.where(np.isnan(s), c[0, :, 0], s), None)

    both = y.withColumn("f", F.col("x") * 1.0).withColumn("none", F.lit(None).cast("double"))
    out = backends.infer(both, pool, Covered(), covariates=("f", "none")).collect()
    assert len(out) == 17 and all(r["error"] is None and r["prediction"] == r["x"] for r in out)
    for bad in ({"covariates": ("lost",)}, {"mode": "nearby"}):
        with pytest.raises(backends.InputError):
            backends.infer(both, pool, Covered(), **bad)


def test_contexts(daily, pool):
    y = series.model_series(daily, log=False)
    lo, hi = y.agg(F.min("x"), F.max("x")).first()
    for mode, window, most in (("full_series", 0, 10**6), ("full_series", 0, 20), ("local_window", 10, 10**6), ("edge_balanced", 40, 21)):
        for r in backends.context_days(y, pool, mode, window, most).collect():
            w = (lo, hi) if mode == "full_series" else (max(lo, r["a"] - window // 2), min(hi, r["b"] + window // 2))
            assert w[0] <= r["lo"] <= r["a"] and r["b"] <= r["hi"] <= w[1] and r["hi"] - r["lo"] + 1 == min(most, w[1] - w[0] + 1)
    assert {r["n_context"] for r in backends.infer(y, pool, backends.Stand(max_context=20), mode="full_series").collect()} == {20}


def test_provenance(tmp_path):
    weights = tmp_path / "weights.bin"
    weights.write_bytes(b"abc")
    stand = backends.Stand()
    stand.version, stand.revision, stand.weights = "1.2", "r7", str(weights)
    digest = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    pin = backends.Pin("1.2", "r7", digest, 4096)
    facts = backends.provenance(stand, pin)
    assert facts["sha256"] == digest and str(tmp_path) not in repr(facts) and backends.require(lambda: stand, pin) is stand
    for wrong in (backends.Pin(version="1.3"), backends.Pin(revision="r8"), backends.Pin(sha256="0" * 64), backends.Pin(max_context=1)):
        with pytest.raises(backends.ProvenanceError):
            backends.require(lambda: stand, wrong)
    stand.weights = str(tmp_path / "lost")
    with pytest.raises(backends.ProvenanceError):
        backends.provenance(stand, backends.Pin())
    stand.max_context = None
    with pytest.raises(backends.ProvenanceError):
        backends.provenance(stand, backends.Pin())


def test_histogram_boosting():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    y = np.where(x[:, 0] > 0.3, 2.0, -1.0)
    x[rng.random(400) < 0.2, 0] = np.nan
    y[np.isnan(x[:, 0])] = 7.0
    p = models.hist_boosted(x[:300], y[:300], x[300:], patience=200, rounds=300)
    assert np.abs(p - y[300:]).max() < 0.1  # missing values have a side of their own
    # One whole tree with a full step: its leaves are means, each of enough rows, and there aren't too many.
    p = models.hist_boosted(x[:300], y[:300], x[:300], rounds=1, rate=1.0, leaves=4, share=0)
    assert np.allclose(p, y[:300])
    noise = rng.normal(size=300)
    p = models.hist_boosted(x[:300], noise, x[:300], rounds=1, rate=1.0, leaves=5, share=0)
    values, sizes = np.unique(p, return_counts=True)
    assert len(values) == 5 and sizes.min() >= 20 and all(np.isclose(noise[p == v].mean(), v) for v in values)
    # The first cut is the best of all cuts.
    p = models.hist_boosted(x[:300, 1:], noise, x[:300, 1:], rounds=1, rate=1.0, leaves=2, share=0)
    left = lambda j, c: x[:300, j] <= c
    fits = [((noise - np.where(a, noise[a].mean(), noise[~a].mean())) ** 2).sum() for j in (1, 2) for c in x[:300, j] if 20 <= (a := left(j, c)).sum() <= 280]
    assert np.isclose(((noise - p) ** 2).sum(), min(fits))
    # Noise stops the rounds early; a column without a value, few rows and equal targets are no trouble.
    few, many = (models.hist_boosted(x[:300], noise, x[:300], patience=k, rounds=80) for k in (3, 80))
    assert np.ptp(few) < np.ptp(many)
    assert np.allclose(models.hist_boosted(np.full((30, 2), np.nan), np.ones(30), np.full((2, 2), np.nan)), 1.0)
    assert np.allclose(models.hist_boosted(x[:12], noise[:12], x[:3], share=0), noise[:12].mean())


def test_fit_warnings_and_fills(spark):
    pool = spark.createDataFrame([("a",), ("b",), ("c",)], "gap_id string")
    table = spark.createDataFrame([("s", "a", 1, None, 1.0), ("s", "b", 2, 1.0, 1.0)], "series_id string, gap_id string, x int, f double, y double")
    train = spark.createDataFrame([("a", k, float(v), float(v)) for k, v in enumerate([0, 0, 0, 0, 10])] + [("b", 1, 1.0, 1.0), ("b", 2, 2.0, None), ("c", 1, 1.0, 1.0)], "held_out string, x int, f double, y double")
    said = {tuple(r) for r in models.fit_warnings(pool, table, train, "y", least=2).collect()}
    assert said == {("b", 1, 1, "too few training rows"), ("c", 0, 1, "no days to predict")}
    one = lambda fill: models.leave_one_gap_out(table, train, ["f"], "y", "ridge", least=5, fill=fill, alpha=1e-9).where("gap_id = 'a'").first()["prediction"]
    assert np.isclose(one(None), 2.0) and np.isclose(one("median"), 0.0, atol=1e-6)
    with pytest.raises(ValueError):
        one("mode")


def test_ridge_from_moments(spark, daily, pool):
    y = daily.withColumn("y", F.col("value"))
    f = daily.select("date", "x", (F.col("x") % 7).alias("f1"), F.when(F.col("x") % 5 > 0, F.col("x") % 11 + 1e6).alias("f2"), F.lit(None).cast("double").alias("f3"))
    names = ["f1", "f2", "f3"]
    test, train = models.external_rows(y, f, pool)
    want = models.leave_one_gap_out(test.select("series_id", "gap_id", "x", *names, "y"), train.select("held_out", "x", *names, "y"), names, "y", "ridge", least=10)
    key = lambda df: {(r["gap_id"], r["x"]): r["prediction"] for r in df.collect()}
    a, b = key(models.ridge_outside(y, f, pool, names)), key(want)
    assert a.keys() == b.keys() and len(a) == 17 and all(abs(a[k] - b[k]) < 1e-7 for k in a)
    assert models.ridge_outside(y, f, pool, names, least=10**6).where("prediction is not null").count() == 0
    assert models.ridge_outside(y.limit(0), f, pool, names).count() == 0 and models.ridge_outside(y, f, pool.limit(0), names).count() == 0


def test_runs_and_manifests(spark, tmp_path):
    ok = spark.createDataFrame([("k1", 1, ["d"], [1.0]), ("k1", 2, ["d"], [2.0]), ("k2", 1, ["d"], [None]), ("k4", 1, ["d"], [float("nan")])], "key string, seq int, date array<string>, pred_log10 array<double>")
    bad = spark.createDataFrame([("k2", 1, "e1"), ("k3", 1, "e1"), ("k3", 2, "e2"), ("k3", 3, "e3"), ("k1", 1, "x")], "key string, seq int, error string")
    now = ledger.state(ok, bad)
    rows = {r["key"]: r for r in now.collect()}
    assert rows["k1"]["status"] == "successful" and rows["k1"]["is_duplicate"] and rows["k2"]["status"] == "failed" and rows["k3"]["last_error"] == "e3" and rows["k4"]["status"] == "successful"
    want = spark.createDataFrame([(k,) for k in ("k1", "k2", "k3", "k5")], "key string")
    assert sorted(r[0] for r in ledger.outstanding(want, now).collect()) == ["k2", "k5"]
    assert ledger.classify(want, now).first()["run_status"] == "FAILED"
    assert {r["key"]: r["pred_log10"] for r in ledger.latest(ok).where("key = 'k1'").collect()} == {"k1": [2.0]}
    p = str(tmp_path / "m.json")
    assert ledger.guard_manifest(p, arms=["b", "a"], seed=1) == ledger.guard_manifest(p, arms=["a", "b"], seed=1)
    with pytest.raises(ledger.ManifestMismatch):
        ledger.guard_manifest(p, arms=["a"], seed=1)
    calls = []

    def compute():
        calls.append(1)
        return spark.createDataFrame([("g", "d", 1.0)], "gap_id string, date string, prediction double")

    for config in ({"a": 1}, {"a": 1}, {"a": 2}):
        ledger.cached(spark, str(tmp_path / "c"), ledger.signature(["g"], config, {}), ["prediction"], 1, compute).count()
    assert len(calls) == 2


def test_candidates_are_validated(spark):
    gaps = spark.createDataFrame([("g", day(0), day(3), 4, "short")], "gap_id string, start date, end date, length int, gap_class string")
    one = ("g", day(1), 1.0, "kalman", 2.0, [1.0, 2.0])
    cols = "gap_id string, date date, hybrid_pred double, component_method string, sequence_pred double, quantiles array<double>"
    assert assembly.validated(spark.createDataFrame([one], cols), gaps).count() == 1
    bad = [one, one, ("g", day(9), float("nan"), None, None, None), ("h", day(1), 1.0, None, None, [2.0, 1.0])]
    with pytest.raises(ValueError):
        assembly.validated(spark.createDataFrame(bad, cols), gaps)
    assert {r["rule"]: r["n"] for r in assembly.violations(spark.createDataFrame(bad, cols), gaps).collect()} == {"not_finite": 1, "quantiles_fall": 1, "unknown_gap": 1, "outside_gap": 1, "repeated_day": 1}


def test_sources_and_sinks(spark, tmp_path):
    p = tmp_path / "d.csv"
    p.write_text("date,value,eligible,note\n2020-01-01,1.5,True,a\n2020-01-02,NaN,False,b\n2020-01-04,,,c\n")
    rows = series.read_daily(spark, str(p)).orderBy("x").collect()
    assert [(r["value"], r["eligible"]) for r in rows] == [(1.5, True), (None, False), (None, False)]
    assert series.checksums(spark, str(p)).first()["sha256"] == series.checksum(str(p))
    with pytest.raises(ValueError):
        series.export_table(spark.createDataFrame([(1,)], "gap_id int"))
    led = spark.createDataFrame([("k", "g", None, "none", ["2020-01-01", "2020-01-02"], [1.0, None], [1.5, 2.0])], "key string, gap_id string, context_mode string, arm string, date array<string>, pred_log10 array<double>, true_log10 array<double>")
    series.append_ledger(led, str(tmp_path / "l"))
    series.append_ledger(led, str(tmp_path / "l"))
    flat = series.flatten_ledger(series.read_ledger(spark, str(tmp_path / "l"))).orderBy("date").collect()
    assert len(flat) == 4 and flat[0]["abs_error"] == 0.5 and flat[3]["abs_error"] is None and flat[0]["method_id"] == "seq_none__full_series"


def test_streamed_days_equal_batch_days(spark, tmp_path):
    from gapwright.streaming import hourly

    rows = [("s", dt.datetime(2024, 1, 1 + k // 24, k % 24), float(k)) for k in range(72)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = hourly.daily_means(stream).writeStream.outputMode("complete").format("memory").queryName("days").start()
    q.processAllAvailable()
    q.stop()
    want = {(r["date"], r["mean"]) for r in hourly.daily_means(df).collect()}
    assert {(r["date"], r["mean"]) for r in spark.sql("select * from days").collect()} == want and len(want) == 3
