"""The demonstration's methods over small series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapwright.operators import backends, demo, models


@pytest.fixture(scope="module")
def daily(spark):
    rng = np.random.default_rng(2)
    rows = [("s", k, float(10 ** (1 + 0.5 * np.sin(k / 9) + rng.normal(0, 0.01))), not 140 <= k < 143) for k in range(300)]
    return spark.createDataFrame(rows, "series_id string, x int, value double, eligible boolean").withColumn("date", F.date_from_unix_date("x")).cache()


@pytest.fixture(scope="module")
def pool(spark):
    rows = [("s", "g1", 60, 66), ("s", "g2", 200, 213)]
    return spark.createDataFrame(rows, "series_id string, gap_id string, a int, b int").selectExpr("series_id", "gap_id", "b - a + 1 as gap_length", "date_from_unix_date(a) as start", "date_from_unix_date(b) as end")


@pytest.fixture(scope="module")
def features(daily):
    return daily.select("date", "x", F.sin(F.col("x") / 9).alias("f"), F.when(F.col("x") % 4 > 0, F.lit(1.0)).alias("holes"))


def test_synthetic_gaps_are_wholly_known(daily):
    rows = demo.synthetic_gaps(daily).collect()
    assert len(rows) > 1000 and {r["gap_length"] for r in rows} == {1, 3, 7, 14}
    for r in rows:
        a, b = r["start"].toordinal() - 719163, r["end"].toordinal() - 719163
        assert b - a + 1 == r["gap_length"] and a >= 10 and b < 290 and not set(range(a, b + 1)) & {140, 141, 142}
    assert sorted(map(tuple, rows)) == sorted(map(tuple, demo.synthetic_gaps(daily.repartition(3)).collect()))
    assert demo.synthetic_gaps(daily.limit(0)).count() == 0 and demo.synthetic_gaps(daily.where("x < 20")).count() == 0


def test_residuals_of_hidden_days(daily, pool):
    y = {r["x"]: np.log10(r["value"]) for r in daily.collect()}
    rows = demo.residual_days(daily, pool).collect()
    assert len(rows) == 21
    for r in rows:
        a, b = (59, 67) if r["gap_id"] == "g1" else (199, 214)
        want = y[a] + (r["x"] - a) / (b - a) * (y[b] - y[a])
        assert np.isclose(r["interp_log"], want) and np.isclose(r["residual"], y[r["x"]] - want)
        assert (r["days_from"], r["days_to"], r["dep_min"], r["dep_max"]) == (r["x"] - a, b - r["x"], a, b)


def test_learned_methods_see_no_hidden_value(daily, pool, features):
    hidden = (F.col("x").between(60, 66)) | F.col("x").between(200, 213)
    other = daily.withColumn("value", F.when(hidden, 999.0).otherwise(F.col("value")))
    truth = {r["x"]: np.log10(r["value"]) for r in daily.where(hidden).collect()}
    one = pool.where("gap_id = 'g2'")
    for run in (lambda d: demo.external_tabular(d, features, one, ["f", "holes"]), lambda d: demo.gap_edge_residual(d, features, one, ["f"], tries=400)):
        a, b = ({r["x"]: r["prediction"] for r in run(d).collect()} for d in (daily.where(~F.col("x").between(60, 66)), other.where(~F.col("x").between(60, 66))))
        assert a == b and set(a) == set(range(200, 214))
        assert np.mean([abs(np.log10(a[x]) - truth[x]) for x in a]) < 0.1
    assert demo.gap_edge_residual(daily, features, one, ["f"], tries=1, lengths=(14,), margin=200).where("prediction is not null").count() == 0


def test_sequence_calls(daily, pool):
    logs = daily.withColumn("y", F.log10("value"))
    rows = demo.sequence_calls(logs, pool, backends.Stand()).collect()
    assert len(rows) == 21 and all(r["error"] is None and r["q05"] < r["value"] < r["q95"] for r in rows)


def test_fits_are_spread(daily, pool, spark):
    rows = models.spread(daily.withColumn("gap_id", F.col("x").cast("string")), "gap_id")
    assert rows.groupBy("gap_id").applyInPandas(lambda p: p[["x"]], "x int").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
