"""Runs, gaps, windows and their selection on hand-made series."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gapwright.functions import scalars as S
from gapwright.operators import covariates, intervals, masking

DAY = dt.date(2020, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


@pytest.fixture(scope="module")
def daily(spark):
    def make(flags, values=None, series="a", skip=()):
        rows = [(series, day(k), (None if values is None else values[k]) if values is not None else float(k + 1), bool(f)) for k, f in enumerate(flags) if k not in skip]
        return spark.createDataFrame(rows, "series_id string, date date, value double, eligible boolean").withColumn("x", F.unix_date("date"))

    return make


def test_runs_break_at_absent_days(daily):
    runs = intervals.eligible_runs(daily([1, 1, 0, 1, 1, 1], skip=(4,))).orderBy("start").collect()
    assert [(r["start"], r["length"]) for r in runs] == [(day(0), 2), (day(3), 1), (day(5), 1)]
    gaps = intervals.row_gaps(daily([1, 0, 0, 0, 1], skip=(2,))).orderBy("start").collect()
    assert [r["length"] for r in gaps] == [1, 1]  # absent days part gaps


def test_real_gaps_count_absent_days_and_open_ends(daily):
    out = intervals.real_gaps(daily([1, 1, 1, 1, 1, 0, 0, 0], skip=(2, 3))).orderBy("start").collect()
    assert [(r["gap_id"], r["length"], r["pre_edge"], r["post_edge"], r["open_ended"]) for r in out] == [("REAL_L001_20200103", 2, True, True, False), ("REAL_OPEN_20200106", 3, True, False, True)]
    classes = {r["gap_class"]: r["n_gaps"] for r in intervals.by_class(intervals.real_gaps(daily([1, 0, 1]))).collect()}
    assert classes == {"short": 1, "medium": 0, "long": 0, "very_long": 0}


def test_candidate_starts_and_context(daily):
    runs = intervals.eligible_runs(daily([1] * 10 + [0] + [1] * 3))
    n = {r["gap_length"]: r["count"] for r in intervals.candidate_starts(runs, [1, 3, 7]).groupBy("gap_length").count().collect()}
    assert n == {1: 13, 3: 9, 7: 4}
    near = intervals.candidate_starts(runs, [3], context=3).collect()
    assert [r["start"] for r in sorted(near, key=lambda r: r["start"])] == [day(3), day(4)]


def test_greedy_sample_equals_the_plain_loop(daily):
    starts = intervals.candidate_starts(intervals.eligible_runs(daily([1] * 60)), [4])
    got = sorted(r["x"] for r in intervals.greedy_sample(starts, seed=42, most=5).select(F.unix_date("start").alias("x")).collect())
    order = [(day(k) - dt.date(1970, 1, 1)).days for k in range(57)]
    random.Random(42).shuffle(order)
    want = []
    for s in order:
        if len(want) < 5 and all(abs(s - t) >= 4 for t in want):
            want.append(s)
    assert got == sorted(want)


def test_block_sample_never_overlaps(daily):
    pool = intervals.block_sample(intervals.candidate_starts(intervals.eligible_runs(daily([1] * 400)), [3, 14])).collect()
    for n in (3, 14):
        own = sorted(r["start"] for r in pool if r["gap_length"] == n)
        assert len(own) > 3 and all((b - a).days >= n for a, b in zip(own, own[1:]))


def test_labels(daily):
    d = daily([1] * 20, [float(k) for k in range(20)])
    pool = intervals.block_sample(intervals.candidate_starts(intervals.eligible_runs(d), [3]))
    for r in intervals.labelled_pool(d, pool, 5).collect():
        k = (r["start"] - DAY).days
        assert r["target_mean"] == pytest.approx(k + 1, abs=1e-4) and r["is_event"] == (k + 2 > 17.1) and r["pre_context_days"] == min(5, k) and r["season"] == "DJF"


def test_majority_takes_the_first_of_equals(spark):
    rows = spark.createDataFrame([("g", "b", 1), ("g", "a", 2), ("g", "a", 4), ("g", "b", 3), ("h", "z", 1)], "gap_id string, v string, x int")
    assert {r["gap_id"]: r["majority"] for r in intervals.majority(rows, "gap_id", F.col("v"), "x").collect()} == {"g": "b", "h": "z"}


def test_mask_leaves_the_rest(daily, spark):
    d = daily([1] * 8)
    pool = spark.createDataFrame([("a", "g", 2, day(3), day(4))], "series_id string, gap_id string, gap_length int, start date, end date")
    rows = masking.apply_mask(d, pool).orderBy("x").collect()
    assert [r["value"] for r in rows] == [1, 2, 3, None, None, 6, 7, 8] and [r["hidden"] for r in rows].count(True) == 2
    assert masking.leaked(masking.visible(d, pool), pool).count() == 0
    w = masking.dependency_window(pool, 2, 1)
    assert [r["date"] for r in masking.outside(d, w).orderBy("date").collect()] == [day(0), day(6), day(7)]
    with pytest.raises(ValueError):
        masking.dependency_window(pool, -1, 0)


def test_context_slice(daily, spark):
    b = spark.createDataFrame([("g", 10, 12)], "gap_id string, first_row int, last_row int")
    assert intervals.context_slice(b, 100, "local_window", 7).select("lo", "hi").first()[:] == (7, 16)
    assert intervals.context_slice(b, 100, "full_series", most=21).select("lo", "hi").first()[:] == (10, 31)
    with pytest.raises(ValueError):
        intervals.context_slice(b, 100, "sideways")


def test_scalars(spark):
    rows = spark.createDataFrame([(1, dt.date(2020, 1, 15), dt.date(2020, 4, 2)), (9, dt.date(2020, 6, 3), dt.date(2020, 6, 11)), (40, dt.date(2020, 2, 1), dt.date(2020, 3, 11))], "n int, a date, b date")
    out = rows.select(S.gap_class(F.col("n")), S.nearest_lengths(F.col("n")), S.extrapolation(F.col("n")), S.seasons_spanned(F.col("a"), F.col("b")), S.route(F.col("n"), "D"), S.gap_id(F.col("n"), F.col("a"))).collect()
    assert [tuple(r) for r in out] == [
        ("short", "1", "no", "DJF/MAM", "gaussian_process", "L01_20200115"), ("medium", "7–14", "interpolation_within_range", "JJA", "kalman", "L09_20200603"),
        ("long", "30–?", "yes", "DJF/MAM", "gap_edge", "L40_20200201"),
    ]
    v = spark.createDataFrame([(1.0,), (1e-4,), (-1.0,), (None,)], "v double").select(S.guarded_log10(F.col("v")), S.clipped(F.col("v"))).collect()
    assert [tuple(r) for r in v] == [(0.0, 1.0), (None, 1e-4), (None, 1e-4), (None, None)]
    with pytest.raises(ValueError):
        S.route(F.col("n"), "Z")


def test_hourly_to_daily(spark):
    rows = [("s", dt.datetime(2024, 1, 1, h), None if h == 5 else float(h)) for h in (0, 1, 5, 6, 20)]
    r = covariates.daily_from_hours(spark.createDataFrame(rows, "series_id string, ts timestamp, value double")).first()
    assert (r["n_rows"], r["valid_hours"], r["first_valid_hour"], r["last_valid_hour"], r["longest_invalid_run_hours"], r["eligible"]) == (5, 4, 0, 20, 13, False)


def test_feature_tables(spark):
    base = spark.createDataFrame([(day(0), 1.0, 2.0), (day(1), 3.0, 4.0)], "date date, a double, b double")
    ext = spark.createDataFrame([(day(0), 9.0, 7.0)], "date date, b double, c double")
    out = covariates.override(base, ext).orderBy("date").collect()
    assert [tuple(r)[1:] for r in out] == [(1.0, 9.0, 7.0), (3.0, None, None)]
    with pytest.raises(ValueError):
        covariates.guard(base, {"a"})
    with pytest.raises(ValueError):
        covariates.arm_columns({"x": ["a"]}, ["y"])
    x = base.withColumn("x", F.unix_date("date"))
    assert [r["a"] for r in covariates.roll(x, ["a", "b"], 1).orderBy("date").collect()] == [3.0, 1.0]
    with pytest.raises(ValueError):
        covariates.placebo(x, ["a"], "sideways")
