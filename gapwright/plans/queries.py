"""One query for each operator of the inventory, over the driver's tables, with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import assembly, backends, baselines, covariates, edges, intervals, ledger, masking, models, paired, scoring, tails
from ..sources import series
from .sql import DAY, EDGES, POOL, PREDICTED, RUNS, S1, S2, r6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
LENGTHS = [1, 3, 7, 14]
#: Trees of the registered gap-edge queries: a model for each gap; the operator's own default is 500.
TREES = 100


def query(sql: str = ""):
    """Registers a query under its function's name; whole numbers leave as 64-bit ones."""

    def wrap(f):
        def run(spark, sf_dir):
            df = f(spark, sf_dir)
            return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return run

    return wrap


def _pool(daily: DataFrame) -> DataFrame:
    return intervals.block_sample(intervals.candidate_starts(intervals.eligible_runs(daily), LENGTHS))


def _both(spark, d) -> tuple[DataFrame, DataFrame]:
    daily = series.main_series(spark, d)
    return daily, _pool(daily)


def _scored(spark, d) -> DataFrame:
    daily, pool = _both(spark, d)
    return baselines.with_truth(baselines.baselines(daily, pool), daily)


def _round_to(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: S.rounded(c, digits) for c in cols})


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: S.rounded(c) for c in cols})


# --- sources ----------------------------------------------------------------------------------------------


@query(f"WITH {S1} SELECT date, x, n, v AS value, e AS eligible FROM s1")
def src1_daily_series(spark, d):
    return series.main_series(spark, d).select("date", "x", "n", "value", "eligible")


@query(f"WITH {S2} SELECT date, f_count, f_mean FROM s2")
def src2_feature_table(spark, d):
    return series.feature_series(spark, d).drop("x")


@query(f"""WITH {S2}, ext AS (SELECT date, -f_mean AS f_mean, f_count + 1 AS f_extra FROM s2 WHERE date_diff('day', DATE '1970-01-01', date) % 2 = 0)
SELECT date, f_count, ext.f_mean, f_extra FROM s2 LEFT JOIN ext USING (date)""")
def src3_feature_override(spark, d):
    base = series.feature_series(spark, d)
    ext = base.where("x % 2 = 0").select("date", (-F.col("f_mean")).alias("f_mean"), (F.col("f_count") + 1).alias("f_extra"))
    return covariates.override(base.drop("x"), ext)


@query(f"WITH {POOL} SELECT gap_id, gap_length::BIGINT AS gap_length, start, stop AS \"end\" FROM pool WHERE md5(gap_id) < '8'")
def src6_matched_support(spark, d):
    _, pool = _both(spark, d)
    return series.matched_support(pool, pool.where(F.md5("gap_id") < "8")).select("gap_id", "gap_length", "start", "end")


@query(f"WITH {POOL} SELECT CASE WHEN gap_length <= 30 THEN 'primary' ELSE 'exploratory_extended' END AS support_role, count(*) AS n, sum(gap_length)::BIGINT AS days FROM pool WHERE gap_length <= 30 GROUP BY 1")
def src7_pool_by_role(spark, d):
    _, pool = _both(spark, d)
    pool = series.pool_by_role(pool.withColumn("support_role", S.support_role(F.col("gap_length"))), "primary")
    return pool.groupBy("support_role").agg(F.count(F.lit(1)).alias("n"), F.sum("gap_length").alias("days"))


@query(f"WITH {S1} SELECT date, floor(CAST(CAST(CASE WHEN e AND v > 1e-4 THEN log10(v) END AS FLOAT) AS DOUBLE) * 1e4 + 0.5003) / 1e4 AS y FROM s1")
def src8_log_model_series(spark, d):
    y = series.model_series(series.main_series(spark, d))
    return y.select("date", S.rounded(F.col("y").cast("double"), 4).alias("y"))


@query(f"WITH {S1} SELECT date, floor(CAST(CAST(CASE WHEN e THEN v END AS FLOAT) AS DOUBLE) * 1e2 + 0.5003) / 1e2 AS y FROM s1")
def src9_raw_model_series(spark, d):
    return series.model_series(series.main_series(spark, d), log=False).select("date", S.rounded(F.col("y").cast("double"), 2).alias("y"))


@query(f"WITH {POOL} SELECT gap_id, start, stop AS \"end\", gap_length::BIGINT AS length FROM pool")
def src10_gap_specs(spark, d):
    _, pool = _both(spark, d)
    return series.gap_specs(pool.withColumn("length", F.col("gap_length"))).select("gap_id", "spec.*")


@query(f"""WITH {PREDICTED} SELECT gap_id, gap_length::BIGINT AS gap_length, 'seq_none__full_series' AS method_id, {DAY.format('x')} AS date, {r6('log10(prediction)', 'pred_log10')}, {r6('a2', 'abs_error')}
FROM (SELECT *, abs(log10(prediction) - log10(truth)) AS a2 FROM scored WHERE method = 'linear')""")
def src11_ledger_flatten(spark, d):
    rows = _scored(spark, d).where("method = 'linear'")
    days = F.sort_array(F.collect_list(F.struct("x", F.date_format("date", "yyyy-MM-dd").alias("date"), F.log10("prediction").alias("p"), F.log10("truth").alias("t"))))
    nested = rows.groupBy("gap_id", "gap_length").agg(days.alias("r"))
    nested = nested.select("gap_id", "gap_length", F.lit("none").alias("arm"), F.lit(None).cast("string").alias("context_mode"), F.col("r.date").alias("date"), F.col("r.p").alias("pred_log10"), F.col("r.t").alias("true_log10"))
    return _round(series.flatten_ledger(nested).select("gap_id", "gap_length", "method_id", "date", "pred_log10", "abs_error"), "pred_log10", "abs_error")


@query(f"""WITH {PREDICTED} SELECT gap_id, {DAY.format('x')} AS date, method, {r6('truth', 'truth')}, {r6('prediction', 'prediction')}, NULL::DOUBLE AS q05, NULL::DOUBLE AS q95, {r6('a', 'abs_error')}, '' AS covariates, NULL::DOUBLE AS runtime_s
FROM scored WHERE method = 'linear'""")
def snk4_demo_export(spark, d):
    null = F.lit(None).cast("double")
    rows = _scored(spark, d).where("method = 'linear'").withColumns({"q05": null, "q95": null, "runtime_s": null, "covariates": F.lit(""), "abs_error": F.abs(F.col("prediction") - F.col("truth"))})
    return _round(series.export_table(rows), "truth", "prediction", "abs_error")


# --- filters ----------------------------------------------------------------------------------------------


@query(f"WITH {S1} SELECT date, v AS value FROM known WHERE v > 1e-4")
def flt2_observed_series(spark, d):
    daily = intervals.above_floor(series.main_series(spark, d))
    return daily.where("eligible").select("date", "value")


@query(f"WITH {POOL} SELECT gap_id, count(*) AS n, {r6('avg(v)', 'mean')} FROM pool, known WHERE x NOT BETWEEN a0 AND a1 GROUP BY gap_id")
def flt3_visible_rows(spark, d):
    daily, pool = _both(spark, d)
    return _round(masking.visible(daily, pool).groupBy("gap_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")), "mean")


@query(f"WITH {POOL} SELECT gap_id, date, v AS value FROM pool, known WHERE x NOT BETWEEN a0 AND a1 AND x BETWEEN a0 - 5 AND a1 + 5")
def flt4_context_window(spark, d):
    daily, pool = _both(spark, d)
    return masking.visible(daily, pool, 5, 5).select("gap_id", "date", "value")


@query(f"WITH {POOL}, {S2} SELECT gap_id, count(*) AS n_train, {r6('avg(log10(v))', 'mean_log')} FROM pool, known JOIN s2 USING (date) WHERE x NOT BETWEEN a0 AND a1 AND v > 1e-4 GROUP BY gap_id")
def flt5_training_split(spark, d):
    daily, pool = _both(spark, d)
    logs = daily.withColumn("y", S.guarded_log10(F.col("value")))
    _, train = models.external_rows(logs, series.feature_series(spark, d), pool)
    return _round(train.groupBy(F.col("held_out").alias("gap_id")).agg(F.count(F.lit(1)).alias("n_train"), F.avg("y").alias("mean_log")), "mean_log")


@query(f"WITH {S2} SELECT date, {r6('f_count * f_mean', 'f_total')} FROM s2")
def flt14_feature_products(spark, d):
    return _round(covariates.products(series.feature_series(spark, d), {"f_total": ("f_count", "f_mean")}).select("date", "f_total"), "f_total")


@query(f"WITH {S2} SELECT date, f_mean FROM s2")
def flt11_feature_arm(spark, d):
    return covariates.arm(series.feature_series(spark, d), {"counts": ["f_count"], "means": ["f_mean"]}, ["means"])


@query(f"WITH {S1}, {S2} SELECT min(date) AS first_day, max(date) AS last_day, count(*) AS n_rows, count(*) FILTER (f_mean IS NULL) AS missing_f_mean FROM s1 LEFT JOIN s2 USING (date)")
def flt16_dataset_summary(spark, d):
    rows = series.main_series(spark, d).select("date").join(series.feature_series(spark, d), "date", "left")
    return covariates.summary(rows, ["f_mean"])


@query(f"WITH {POOL}, {S2} SELECT gap_id, {r6('avg(CASE WHEN f_mean IS NULL THEN 0 ELSE 1 END)', 'completeness')} FROM hidden LEFT JOIN s2 ON s2.date = {DAY.format('x')} GROUP BY gap_id")
def flt17_completeness(spark, d):
    _, pool = _both(spark, d)
    return _round(covariates.completeness(series.feature_series(spark, d), pool, "f_mean"), "completeness")


# --- joins ------------------------------------------------------------------------------------------------


@query(f"WITH {S1}, {S2} SELECT date, n, f_count, f_mean FROM s1 LEFT JOIN s2 USING (date)")
def jn1_left_features(spark, d):
    return series.main_series(spark, d).select("date", "n").join(series.feature_series(spark, d).drop("x"), "date", "left")


@query(f"WITH {S2}, d AS (SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS n FROM lineitem GROUP BY 1) SELECT date, n, f_count FROM d FULL JOIN s2 USING (date)")
def jn3_full_outer_days(spark, d):
    a = series.daily_counts(spark.read.parquet(f"{d}/lineitem.parquet"), "l_shipdate", "l_extendedprice", "S1").select("date", "n")
    return covariates.both_days(a, series.feature_series(spark, d).select("date", "f_count"))


@query(f"WITH {EDGES} SELECT gap_id, x0, v0, x1, v1 FROM edge")
def jn9_asof_edges(spark, d):
    return baselines.edges(*_both(spark, d)).select("gap_id", "x0", "v0", "x1", "v1")


@query(f"WITH {POOL} SELECT p.gap_id, count(*) AS n_runs, max(len) AS longest FROM pool p JOIN runs r ON r.x0 <= p.a0 AND r.x1 >= p.a1 GROUP BY 1")
def jn10_gap_in_run(spark, d):
    daily, pool = _both(spark, d)
    runs = intervals.eligible_runs(daily).select("series_id", F.col("length").alias("len"), F.explode(F.sequence("start", "end")).alias("start"), F.col("end").alias("run_end"))
    return pool.join(runs, ["series_id", "start"]).where("run_end >= end").groupBy("gap_id").agg(F.count(F.lit(1)).alias("n_runs"), F.max("len").alias("longest"))


@query(f"""WITH {POOL} SELECT gap_id, m AS context_mode, arm, gap_id || '|' || m || '|' || arm AS key, gap_length::BIGINT AS gap_length
FROM pool, (VALUES ('full_series'), ('local_window')) a(m), (VALUES ('none'), ('proxy')) b(arm)""")
def jn12_call_grid(spark, d):
    _, pool = _both(spark, d)
    return covariates.call_grid(pool, ["full_series", "local_window"], ["none", "proxy"])


@query(f"WITH {S1} SELECT date, x, n FROM s1")
def jn14_dense_calendar(spark, d):
    days = series.daily_counts(spark.read.parquet(f"{d}/lineitem.parquet"), "l_shipdate", "l_extendedprice", "S1")
    return intervals.densify(days).select("date", "x", F.coalesce("n", F.lit(0)).alias("n"))


# --- gaps and intervals -----------------------------------------------------------------------------------


@query(f"WITH {RUNS} SELECT {DAY.format('x0')} AS start, {DAY.format('x1')} AS \"end\", len AS length FROM runs")
def gt1_eligible_runs(spark, d):
    return intervals.eligible_runs(series.main_series(spark, d)).select("start", "end", "length")


@query(f"WITH {RUNS} SELECT {DAY.format('x0')} AS start, {DAY.format('x1')} AS \"end\", len AS length FROM gaps")
def gt2_row_gaps(spark, d):
    return intervals.row_gaps(series.main_series(spark, d)).select("start", "end", "length")


@query(f"""WITH {RUNS}, g AS (SELECT *, {DAY.format('x0')} AS a, {DAY.format('x1')} AS b, x1 = (SELECT max(x) FROM s1) AS open_ended FROM gaps),
w AS (SELECT x, max(e::INT) OVER (ORDER BY x RANGE BETWEEN 14 PRECEDING AND 1 PRECEDING) AS bef, max(e::INT) OVER (ORDER BY x RANGE BETWEEN 1 FOLLOWING AND 14 FOLLOWING) AS aft FROM s1),
ms AS (SELECT x0, string_agg(se, '/' ORDER BY o) AS seasons FROM (SELECT x0, se, min(t) AS o FROM (
  SELECT x0, t, CASE WHEN month(t) IN (12, 1, 2) THEN 'DJF' WHEN month(t) IN (3, 4, 5) THEN 'MAM' WHEN month(t) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS se
  FROM (SELECT x0, unnest(generate_series(CASE WHEN day(a) = 1 THEN a ELSE CAST(date_trunc('month', a + INTERVAL 1 MONTH) AS DATE) END, b, INTERVAL 1 MONTH)) AS t FROM g)) GROUP BY x0, se) GROUP BY x0)
SELECT CASE WHEN open_ended THEN 'REAL_OPEN_' ELSE 'REAL_' || CASE WHEN len <= 7 THEN 'L001' WHEN len <= 30 THEN 'L010' WHEN len <= 90 THEN 'L031' ELSE 'L091' END || '_' END || strftime(a, '%Y%m%d') AS gap_id,
 a AS start, b AS "end", len AS length, CASE WHEN len <= 7 THEN 'short' WHEN len <= 30 THEN 'medium' WHEN len <= 90 THEN 'long' ELSE 'very_long' END AS gap_class,
 coalesce(seasons, CASE WHEN month(a) IN (12, 1, 2) THEN 'DJF' WHEN month(a) IN (3, 4, 5) THEN 'MAM' WHEN month(a) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END) AS seasons,
 CASE WHEN len IN (1, 3, 7, 14, 30) THEN len::VARCHAR ELSE coalesce((SELECT max(v)::VARCHAR FROM (VALUES (1), (3), (7), (14), (30)) t(v) WHERE v < len), '?') || '–' || coalesce((SELECT min(v)::VARCHAR FROM (VALUES (1), (3), (7), (14), (30)) t(v) WHERE v > len), '?') END AS nearest_validated,
 CASE WHEN len IN (1, 3, 7, 14, 30) THEN 'no' WHEN len > 30 THEN 'yes' ELSE 'interpolation_within_range' END AS extrapolation,
 open_ended OR coalesce(p.bef, 0) = 1 AS pre_edge, NOT open_ended AND coalesce(q.aft, 0) = 1 AS post_edge, open_ended
FROM g JOIN w p ON p.x = x0 JOIN w q ON q.x = x1 LEFT JOIN ms USING (x0)""")
def gt3_real_gap_inventory(spark, d):
    return intervals.real_gaps(series.main_series(spark, d)).drop("series_id")


@query(f"WITH {POOL} SELECT gap_length::BIGINT AS gap_length, {DAY.format('sx')} AS start FROM starts")
def gt5_candidate_starts(spark, d):
    runs = intervals.eligible_runs(series.main_series(spark, d))
    return intervals.candidate_starts(runs, LENGTHS).select("gap_length", "start")


@query(f"WITH {RUNS} SELECT l::BIGINT AS gap_length, {DAY.format('unnest(generate_series(x0 + 3, x1 - l + 1 - 3))')} AS start FROM runs, (VALUES (1), (3), (7)) t(l) WHERE len >= l + 6")
def gt6_context_starts(spark, d):
    runs = intervals.eligible_runs(series.main_series(spark, d))
    return intervals.candidate_starts(runs, [1, 3, 7], context=3).select("gap_length", "start")


@query(f"""WITH {S1}, f AS (SELECT min(x) AS x0, max(x) AS x1, count(*) AS len FROM (SELECT x, x - row_number() OVER (ORDER BY x) AS g FROM known WHERE v > 20000) GROUP BY g)
SELECT l::BIGINT AS gap_length, count(*) AS n FROM (SELECT l, unnest(generate_series(x0, x1 - l + 1)) AS s FROM f, (VALUES (1), (3), (7)) t(l) WHERE len >= l) GROUP BY l""")
def gt7_value_floor_starts(spark, d):
    daily = intervals.above_floor(series.main_series(spark, d), 20000.0)
    return intervals.candidate_starts(intervals.eligible_runs(daily), [1, 3, 7]).groupBy("gap_length").agg(F.count(F.lit(1)).alias("n"))


@query()
def gt8_greedy_sample(spark, d):
    runs = intervals.eligible_runs(series.main_series(spark, d))
    return intervals.greedy_sample(intervals.candidate_starts(runs, LENGTHS)).drop("series_id")


@query()
def gt9_shared_greedy_sample(spark, d):
    runs = intervals.eligible_runs(series.main_series(spark, d))
    return intervals.shared_greedy_sample(intervals.candidate_starts(runs, [3, 7]), [3, 7], {3: 50, 7: 20}).drop("series_id")


@query(f"WITH {POOL} SELECT gap_id, gap_length::BIGINT AS gap_length, start, stop AS \"end\" FROM pool")
def gt10_candidate_pool(spark, d):
    _, pool = _both(spark, d)
    return pool.select("gap_id", "gap_length", "start", "end")


_LABELS = f"""WITH {POOL}, p90 AS (SELECT quantile_cont(v, 0.9) AS q FROM known),
t AS (SELECT gap_id, avg(v) AS m, max(v) AS mx, count(*) AS nh FROM hidden JOIN s1 USING (x) GROUP BY 1),
se AS (SELECT gap_id, arg_min(season, (-n, f)) AS season FROM (SELECT gap_id, CASE WHEN month(date) IN (12, 1, 2) THEN 'DJF' WHEN month(date) IN (3, 4, 5) THEN 'MAM' WHEN month(date) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season, count(*) AS n, min(x) AS f
  FROM hidden JOIN s1 USING (x) GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT x, coalesce(sum(e::INT) OVER (ORDER BY x RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pre, coalesce(sum(e::INT) OVER (ORDER BY x RANGE BETWEEN 1 FOLLOWING AND 30 FOLLOWING), 0)::BIGINT AS post FROM s1)"""


@query(f"""{_LABELS} SELECT gap_id, gap_length::BIGINT AS gap_length, start, stop AS "end", nh AS n_hidden_days, season, year(start) AS year, floor(m * 1e4 + 0.5003) / 1e4 AS target_mean, floor(mx * 1e4 + 0.5003) / 1e4 AS target_max,
 floor(q * 1e4 + 0.5003) / 1e4 AS event_threshold, mx > q AS is_event, m >= q AS is_sustained, mx <= q AS is_background, a.pre AS pre_context_days, b.post AS post_context_days, a.pre < 30 OR b.post < 30 AS context_constrained,
 'primary' AS support_role, 30::BIGINT AS required_context_days
FROM pool JOIN t USING (gap_id) JOIN se USING (gap_id) JOIN c a ON a.x = a0 JOIN c b ON b.x = a1, p90""")
def gt13_labelled_pool(spark, d):
    return intervals.labelled_pool(*_both(spark, d)).drop("series_id")


@query(f"WITH {POOL} SELECT gap_id, count(*) AS n, count(CASE WHEN x NOT BETWEEN a0 AND a1 THEN v END) AS n_visible, count(*) FILTER (x BETWEEN a0 AND a1) AS n_hidden FROM pool, s1 GROUP BY 1")
def gt15_apply_mask(spark, d):
    daily, pool = _both(spark, d)
    return masking.apply_mask(daily, pool).groupBy("gap_id").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_visible"), F.count_if("hidden").alias("n_hidden"))


@query(f"""WITH {S1}, r AS (SELECT date, row_number() OVER (ORDER BY x) - 1 AS row, sum((v IS NOT NULL)::INT) OVER (ORDER BY x ROWS BETWEEN CURRENT ROW AND 13 FOLLOWING) AS i,
 coalesce(sum((v IS NOT NULL)::INT) OVER (ORDER BY x ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "left", coalesce(sum((v IS NOT NULL)::INT) OVER (ORDER BY x ROWS BETWEEN 14 FOLLOWING AND 43 FOLLOWING), 0)::BIGINT AS "right" FROM s1)
SELECT row, date AS start, "left", "right" FROM r WHERE row % 5 = 0 AND i = 14 AND "left" + "right" >= 30""")
def gt17_complete_windows(spark, d):
    return intervals.complete_windows(series.main_series(spark, d), 14, 5, 30).drop("series_id")


@query(f"WITH {POOL} SELECT gap_id, {DAY.format('x')} AS date, x - a0 + 1 AS day FROM hidden")
def gt18_hidden_days(spark, d):
    _, pool = _both(spark, d)
    return intervals.hidden_days(pool).select("gap_id", "date", "day")


@query(f"WITH {POOL}, r AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS row FROM s1) SELECT gap_id, a.row AS first_row, b.row AS last_row FROM pool JOIN r a ON a.x = a0 JOIN r b ON b.x = a1")
def gt19_row_bounds(spark, d):
    return intervals.row_bounds(*_both(spark, d))


@query(f"""WITH {POOL}, r AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS row FROM s1)
SELECT gap_id, a.row AS first_row, b.row AS last_row, greatest(0, a.row - 90) AS lo, least(2499, b.row + 91) AS hi FROM pool JOIN r a ON a.x = a0 JOIN r b ON b.x = a1""")
def gt20_context_slice(spark, d):
    return intervals.context_slice(intervals.row_bounds(*_both(spark, d)), 2499, "local_window", 180)


# --- aggregates -------------------------------------------------------------------------------------------


@query(f"""WITH {RUNS} SELECT count(*) AS n_days, count(*) FILTER (e) AS n_eligible, min(date) AS first_day, max(date) AS last_day, count(*) FILTER (v IS NULL) AS n_missing,
 (SELECT count(*) FROM gaps) AS n_gaps, (SELECT coalesce(max(len), 0) FROM gaps) AS longest_gap, {r6('count(*) FILTER (e) / count(*)', 'eligible_share')} FROM s1""")
def ag1_coverage(spark, d):
    return intervals.coverage(series.main_series(spark, d)).drop("series_id")


@query("SELECT event_type AS series_id, CAST(ts AS DATE) AS date, floor(avg(value) * 1e6 + 0.5003) / 1e6 AS daily_mean, count(value) AS valid_hours, count(value) > 0 AS available FROM events GROUP BY 1, 2")
def ag2_hourly_to_daily(spark, d):
    return _round(covariates.hourly_mean(series.hourly(spark, d)), "daily_mean")


@query("""WITH h AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS date, hour(ts) AS h, avg(value) AS v, count(*) AS k FROM events GROUP BY 1, 2, 3),
g AS (SELECT *, h - coalesce(lag(h) OVER w, -1) - 1 AS gap FROM h WINDOW w AS (PARTITION BY series_id, date ORDER BY h))
SELECT series_id, date, sum(k)::BIGINT AS n_rows, count(v) AS valid_hours, floor(avg(v) * 1e6 + 0.5003) / 1e6 AS mean, floor(quantile_cont(v, 0.5) * 1e6 + 0.5003) / 1e6 AS median, floor(stddev_samp(v) * 1e6 + 0.5003) / 1e6 AS std,
 floor(quantile_cont(v, 0.1) * 1e6 + 0.5003) / 1e6 AS q10, floor(quantile_cont(v, 0.9) * 1e6 + 0.5003) / 1e6 AS q90, min(h) AS first_valid_hour, max(h) AS last_valid_hour, greatest(max(gap), 23 - max(h)) AS longest_invalid_run_hours,
 count(v) >= 22 AS eligible_ge_22, count(v) >= 18 AS eligible FROM g GROUP BY 1, 2""")
def ag3_daily_target(spark, d):
    df = covariates.daily_from_hours(series.hourly(spark, d))
    df = df.select("series_id", "date", "n_rows", "valid_hours", "mean", "median", "std", "q10", "q90", "first_valid_hour", "last_valid_hour", "longest_invalid_run_hours", "eligible_ge_22", "eligible")
    return _round(df, "mean", "median", "std", "q10", "q90")


@query(f"""WITH {POOL}, dy AS (SELECT dayofyear(date) AS doy, sum(v) AS s, count(*) AS n FROM known GROUP BY 1), o AS (SELECT gap_id, dayofyear(k.date) AS doy, sum(k.v) AS s, count(*) AS n FROM hidden JOIN known k USING (x) GROUP BY 1, 2),
b AS (SELECT gap_id, unnest(generate_series(0, 366)) AS doy FROM pool), m AS (SELECT gap_id, doy, CASE WHEN dy.n - coalesce(o.n, 0) > 0 THEN (dy.s - coalesce(o.s, 0)) / (dy.n - coalesce(o.n, 0)) END AS m FROM b LEFT JOIN dy USING (doy) LEFT JOIN o USING (gap_id, doy)),
w AS (SELECT *, max(CASE WHEN m IS NOT NULL THEN doy END) OVER (PARTITION BY gap_id ORDER BY doy ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p, min(CASE WHEN m IS NOT NULL THEN doy END) OVER (PARTITION BY gap_id ORDER BY doy ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM m)
SELECT w.gap_id, w.doy, {r6('coalesce(w.m, a.m + (w.doy - w.p)::DOUBLE / nullif(w.q - w.p, 0) * (c.m - a.m), a.m, c.m)', 'mean')} FROM w LEFT JOIN m a ON a.gap_id = w.gap_id AND a.doy = w.p LEFT JOIN m c ON c.gap_id = w.gap_id AND c.doy = w.q""")
def ag5_day_of_year_climatology(spark, d):
    daily, pool = _both(spark, d)
    return _round(baselines.day_of_year_climatology(daily, pool).drop("series_id"), "mean")


_METRICS = f"""{PREDICTED}, gm AS (SELECT method, gap_id, gap_length, count(e) AS n_valid, count(prediction) / count(*) AS coverage, avg(a) AS mae, sqrt(avg(e * e)) AS rmse, avg(e) AS bias FROM scored GROUP BY 1, 2, 3)"""


@query(f"WITH {_METRICS} SELECT method, gap_id, gap_length::BIGINT AS gap_length, n_valid, {r6('coverage', 'coverage')}, {r6('mae', 'mae')}, {r6('rmse', 'rmse')}, {r6('bias', 'bias')} FROM gm")
def ag6_gap_metrics(spark, d):
    return scoring.gap_metrics(_scored(spark, d), digits=6).drop("r")


@query(f"WITH {_METRICS} SELECT method, gap_length::BIGINT AS gap_length, count(DISTINCT gap_id) AS n_gaps, {r6('avg(mae)', 'mae_mean')}, {r6('stddev_samp(mae)', 'mae_std')}, {r6('avg(bias)', 'bias_mean')} FROM gm GROUP BY 1, 2")
def ag7_metric_summary(spark, d):
    s = scoring.summary(scoring.gap_metrics(_scored(spark, d), digits=9), "method", "gap_length")
    return _round(s.select("method", "gap_length", "n_gaps", "mae_mean", "mae_std", "bias_mean"), "mae_mean", "mae_std", "bias_mean")


_SCORE = f"""n_gaps, n_days, {r6('dw', 'day_weighted_mae')}, {r6('r', 'rmse')}, {r6('b', 'bias')}, {r6('md', 'median_abs')}, {r6('p9', 'p90_abs')}, {r6('gw', 'gap_weighted_mae')}"""
_SCORE_FROM = "(SELECT {0}, count(DISTINCT gap_id) AS n_gaps, count(*) AS n_days, avg(a) AS dw, sqrt(avg(e * e)) AS r, avg(e) AS b, quantile_cont(a, 0.5) AS md, quantile_cont(a, 0.9) AS p9 FROM scored WHERE e IS NOT NULL GROUP BY {0}) JOIN (SELECT {0}, avg(m) AS gw FROM (SELECT {0}, gap_id, avg(a) AS m FROM scored WHERE e IS NOT NULL GROUP BY {0}, gap_id) GROUP BY {0}) USING ({0})"
_SCORE_COLS = ("day_weighted_mae", "rmse", "bias", "median_abs", "p90_abs", "gap_weighted_mae")


@query(f"WITH {PREDICTED} SELECT method, {_SCORE} FROM {_SCORE_FROM.format('method')}")
def ag8_benchmark_score(spark, d):
    return _round(scoring.scores(_scored(spark, d), "method"), *_SCORE_COLS)


@query(f"WITH {PREDICTED} SELECT method, gap_length::BIGINT AS gap_length, {_SCORE} FROM {_SCORE_FROM.format('method, gap_length')}")
def ag9_score_by_length(spark, d):
    return _round(scoring.by_length(_scored(spark, d)), *_SCORE_COLS)


@query(f"""WITH {PREDICTED} SELECT method, {r6('sum(a) / count(a)', 'day_weighted_mae')}, {r6('(SELECT avg(m) FROM (SELECT avg(a) AS m FROM scored t WHERE t.method = scored.method GROUP BY gap_id))', 'gap_weighted_mae')} FROM scored GROUP BY method""")
def ag9_pooled_from_lengths(spark, d):
    return _round(scoring.pooled(scoring.by_length(_scored(spark, d))), "day_weighted_mae", "gap_weighted_mae")


@query(f"""{_LABELS.replace(POOL, PREDICTED)} SELECT method, mx > q AS is_event, count(a) AS n_days, {r6('avg(a)', 'mae')} FROM scored JOIN t USING (gap_id), p90 GROUP BY 1, 2""")
def ag12_event_split(spark, d):
    daily, pool = _both(spark, d)
    labels = intervals.labelled_pool(daily, pool)
    return _round(scoring.by_event(_scored(spark, d), labels), "mae")


@query(f"""WITH {RUNS}, c AS (SELECT * FROM (VALUES (0, 'short'), (1, 'medium'), (2, 'long'), (3, 'very_long')) t(k, gap_class)), g AS (SELECT CASE WHEN len <= 7 THEN 'short' WHEN len <= 30 THEN 'medium' WHEN len <= 90 THEN 'long' ELSE 'very_long' END AS gap_class, len FROM gaps)
SELECT k::BIGINT AS k, gap_class, count(len) AS n_gaps, coalesce(sum(len), 0)::BIGINT AS total_days, coalesce(quantile_cont(len, 0.5), 0)::DOUBLE AS median_days, coalesce(max(len), 0) AS max_days FROM c LEFT JOIN g USING (gap_class) GROUP BY 1, 2""")
def ag14_inventory_by_class(spark, d):
    return intervals.by_class(intervals.real_gaps(series.main_series(spark, d)))


@query(f"WITH {S1} SELECT {r6('quantile_cont(v, 0.1)', 'p10')}, {r6('quantile_cont(v, 0.25)', 'p25')}, {r6('quantile_cont(v, 0.5)', 'p50')}, {r6('quantile_cont(v, 0.75)', 'p75')}, {r6('quantile_cont(v, 0.9)', 'p90')} FROM known")
def ag16_quantile_edges(spark, d):
    q = tails.edges(series.main_series(spark, d))
    return q.select(*[S.rounded(F.col("q")[i]).alias(n) for i, n in enumerate(("p10", "p25", "p50", "p75", "p90"))])


# --- windows, ranks, order --------------------------------------------------------------------------------

_SIDE = """{p} AS (SELECT s1.x, {f}(k.x) OVER far AS ox, avg(k.v) OVER (ORDER BY s1.x RANGE BETWEEN {w3}) AS m3, avg(k.v) OVER (ORDER BY s1.x RANGE BETWEEN {w7}) AS m7, median(k.v) OVER (ORDER BY s1.x RANGE BETWEEN {w7}) AS med7,
 CASE WHEN count(k.v) OVER (ORDER BY s1.x RANGE BETWEEN {w7}) = 1 THEN 0 ELSE stddev_samp(k.v) OVER (ORDER BY s1.x RANGE BETWEEN {w7}) END AS s7,
 CASE WHEN count(k.v) OVER (ORDER BY s1.x RANGE BETWEEN {w7}) >= 2 THEN regr_slope(k.v, k.x::DOUBLE) OVER (ORDER BY s1.x RANGE BETWEEN {w7}) END AS k7
 FROM s1 LEFT JOIN known k ON k.x = s1.x WINDOW far AS (ORDER BY s1.x ROWS BETWEEN {far}))"""
_PRE = _SIDE.format(p="pre", f="max", w3="3 PRECEDING AND 1 PRECEDING", w7="7 PRECEDING AND 1 PRECEDING", far="UNBOUNDED PRECEDING AND 1 PRECEDING")
_POST = _SIDE.format(p="post", f="min", w3="1 FOLLOWING AND 3 FOLLOWING", w7="1 FOLLOWING AND 7 FOLLOWING", far="1 FOLLOWING AND UNBOUNDED FOLLOWING")


@query(f"""WITH {POOL}, {_PRE} SELECT gap_id, k.v AS pre_last, a0 - ox AS pre_days_since, {r6('m3', 'pre_mean_3d')}, {r6('m7', 'pre_mean_7d')}, {r6('med7', 'pre_median_7d')}, floor(s7 * 1e4 + 0.5003) / 1e4 AS pre_std_7d, floor(k7 * 1e4 + 0.5003) / 1e4 AS pre_slope_7d
FROM pool JOIN pre ON pre.x = a0 LEFT JOIN known k ON k.x = ox""")
def wn1_pre_edge_features(spark, d):
    f = edges.edge_features(*_both(spark, d)).select("gap_id", "pre_last", "pre_days_since", "pre_mean_3d", "pre_mean_7d", "pre_median_7d", "pre_std_7d", "pre_slope_7d")
    return _round(f, "pre_mean_3d", "pre_mean_7d", "pre_median_7d").withColumns({c: S.rounded(c, 4) for c in ("pre_std_7d", "pre_slope_7d")})


@query(f"""WITH {POOL}, {_POST} SELECT gap_id, k.v AS post_first, ox - a1 AS post_days_until, {r6('m3', 'post_mean_3d')}, {r6('m7', 'post_mean_7d')}, {r6('med7', 'post_median_7d')}, floor(s7 * 1e4 + 0.5003) / 1e4 AS post_std_7d, floor(k7 * 1e4 + 0.5003) / 1e4 AS post_slope_7d
FROM pool JOIN post ON post.x = a1 LEFT JOIN known k ON k.x = ox""")
def wn2_post_edge_features(spark, d):
    f = edges.edge_features(*_both(spark, d)).select("gap_id", "post_first", "post_days_until", "post_mean_3d", "post_mean_7d", "post_median_7d", "post_std_7d", "post_slope_7d")
    return _round(f, "post_mean_3d", "post_mean_7d", "post_median_7d").withColumns({c: S.rounded(c, 4) for c in ("post_std_7d", "post_slope_7d")})


@query(f"""WITH {S1} SELECT s1.date, s1.x - max(k.x) OVER (ORDER BY s1.x) AS since, min(k.x) OVER (ORDER BY s1.x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - s1.x AS until FROM s1 LEFT JOIN known k ON k.x = s1.x""")
def wn5_fill_distances(spark, d):
    return baselines.fill_distances(series.main_series(spark, d)).drop("series_id")


@query(f"""WITH {_METRICS}, r AS (SELECT method, gap_id, floor(mae * 1e6 + 0.5003) / 1e6 AS mae FROM gm), p AS (SELECT method, rank() OVER (PARTITION BY gap_id ORDER BY mae) + (count(*) OVER (PARTITION BY gap_id, mae) - 1) / 2.0 AS place FROM r)
SELECT method, {r6('avg(place::DOUBLE)', 'mean_rank')}, count(*) AS n_gaps FROM p GROUP BY 1""")
def wn7_method_ranks(spark, d):
    return _round(scoring.ranks(scoring.gap_metrics(_scored(spark, d), digits=6), missing_last=True), "mean_rank")


@query(f"WITH {POOL} SELECT gap_id, row_number() OVER (PARTITION BY gap_length ORDER BY a0) - 1 AS sample_order_index FROM pool")
def wn8_sample_order(spark, d):
    _, pool = _both(spark, d)
    return intervals.sample_order(pool).select("gap_id", "sample_order_index")


@query(f"WITH {RUNS} SELECT {DAY.format('x0')} AS start, len AS length FROM runs ORDER BY len DESC, x0 LIMIT 10")
def so2_longest_runs(spark, d):
    return intervals.eligible_runs(series.main_series(spark, d)).orderBy(F.desc("length"), "start").limit(10).select("start", "length")


@query(f"WITH {POOL} SELECT gap_id FROM (SELECT gap_id, gap_length, row_number() OVER (PARTITION BY gap_length ORDER BY md5('42|' || gap_id), gap_id) AS k FROM pool) WHERE k <= 5 ORDER BY gap_length, gap_id LIMIT 20")
def so5_stratified_subset(spark, d):
    _, pool = _both(spark, d)
    return intervals.stratified_subset(pool, 20).select("gap_id")


@query(f"WITH {S1}, {S2} SELECT date FROM known INTERSECT SELECT date FROM s2")
def st2_common_days(spark, d):
    known = series.main_series(spark, d).where(baselines.seen()).select("date")
    return known.intersect(series.feature_series(spark, d).select("date"))


@query(f"WITH {S1}, {S2} SELECT date FROM known EXCEPT SELECT date FROM s2 WHERE f_count >= 7")
def st3_days_without_features(spark, d):
    known = series.main_series(spark, d).where(baselines.seen()).select("date")
    return known.subtract(series.feature_series(spark, d).where("f_count >= 7").select("date"))


# --- reconstruction ---------------------------------------------------------------------------------------


def _baseline(method: str, sql: str):
    def run(spark, d):
        return _round(baselines.predict(method, *_both(spark, d)).select("gap_id", "date", "prediction"), "prediction")

    return run, f"WITH {PREDICTED} SELECT gap_id, {DAY.format('x')} AS date, {r6('p', 'prediction')} FROM {sql}"


for _name, _method, _sql in (
    ("bl1_climatology", "climatology", "clim"),
    ("bl2_persistence", "persistence", "per"),
    ("bl3_linear", "linear", "lin"),
    ("bl5_log_linear", "log_linear", "(SELECT h.gap_id, h.x, log10(v0) + (h.x - x0)::DOUBLE / (x1 - x0) * (log10(v1) - log10(v0)) AS p FROM hidden h JOIN edge USING (gap_id))"),
    ("bl6_anchor", "anchor", "(SELECT gap_id, x, log10(p) AS p FROM lin)"),
):
    _run, _oracle = _baseline(_method, _sql)
    _run.__name__ = _name
    query(_oracle)(_run)


@query(f"WITH {PREDICTED} SELECT method, count(*) AS n, count(prediction) AS n_predicted, {r6('avg(prediction)', 'mean')} FROM scored GROUP BY 1")
def bl4_all_baselines(spark, d):
    return _round(_scored(spark, d).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count("prediction").alias("n_predicted"), F.avg("prediction").alias("mean")), "mean")


@query(f"""WITH {RUNS}, near AS (SELECT s1.x, max(k.x) OVER (ORDER BY s1.x) AS px, min(k.x) OVER (ORDER BY s1.x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qx FROM s1 LEFT JOIN known k ON k.x = s1.x)
SELECT s1.date, {r6('p.v + (s1.x - px)::DOUBLE / (qx - px) * (q.v - p.v)', 'prediction')} FROM s1 JOIN near ON near.x = s1.x LEFT JOIN known p ON p.x = px LEFT JOIN known q ON q.x = qx WHERE NOT e""")
def bl3_real_gaps_filled(spark, d):
    return _round(baselines.fill_real_gaps(series.main_series(spark, d)).select("date", "prediction"), "prediction")


@query(f"""WITH {POOL}, mon AS (SELECT month(date) AS m, sum(log10(v)) AS s, count(*) AS n FROM known GROUP BY 1), own AS (SELECT gap_id, month(k.date) AS m, sum(log10(k.v)) AS s, count(*) AS n FROM hidden JOIN known k USING (x) GROUP BY 1, 2)
SELECT h.gap_id, {DAY.format('h.x')} AS date, floor(pow(10, (mon.s - coalesce(own.s, 0)) / (mon.n - coalesce(own.n, 0))) * 1e4 + 0.5003) / 1e4 AS prediction FROM hidden h JOIN mon ON mon.m = month({DAY.format('h.x')}) LEFT JOIN own ON own.gap_id = h.gap_id AND own.m = mon.m""")
def bl8_log_climatology(spark, d):
    return baselines.predict("log_climatology", *_both(spark, d)).select("gap_id", "date", S.rounded("prediction", 4).alias("prediction"))


# --- leakage and edge tables ------------------------------------------------------------------------------


@query(f"WITH {POOL} SELECT gap_id, {DAY.format('a0 - 14')} AS dep_start, {DAY.format('a1 + 7')} AS dep_end FROM pool")
def lk1_dependency_window(spark, d):
    _, pool = _both(spark, d)
    return masking.dependency_window(pool, 14, 7).select("gap_id", "dep_start", "dep_end")


@query(f"WITH {POOL} SELECT gap_id, count(*) AS n FROM pool, s1 WHERE x NOT BETWEEN a0 - 14 AND a1 + 7 GROUP BY 1")
def lk2_rows_outside(spark, d):
    daily, pool = _both(spark, d)
    return masking.outside(daily, masking.dependency_window(pool, 14, 7)).groupBy("gap_id").agg(F.count(F.lit(1)).alias("n"))


_DEP = f"""{EDGES}, kk AS (SELECT x, lag(x) OVER (ORDER BY x) AS before, lead(x) OVER (ORDER BY x) AS after FROM known),
dep AS (SELECT e.gap_id, e.gap_length, e.a0, e.a1, least(coalesce((SELECT min(x) FROM known k WHERE k.x BETWEEN a0 - 14 AND a0 - 1), x0), x0, coalesce(p.before, x0)) AS lo, greatest(coalesce((SELECT max(x) FROM known k WHERE k.x BETWEEN a1 + 1 AND a1 + 14), x1), x1, coalesce(q.after, x1)) AS hi
 FROM edge e LEFT JOIN kk p ON p.x = x0 LEFT JOIN kk q ON q.x = x1)"""


@query(f"WITH {_DEP} SELECT h.gap_id, {DAY.format('h.x')} AS date, least(coalesce(lo, h.x), h.x) AS dep_min, greatest(coalesce(hi, h.x), h.x) AS dep_max FROM hidden h JOIN dep USING (gap_id)")
def lk3_dependency_spans(spark, d):
    return edges.edge_table(*_both(spark, d)).select("gap_id", "date", "dep_min", "dep_max")


@query(f"""WITH {_DEP}, rows AS (SELECT h.gap_id, h.x, least(coalesce(lo, h.x), h.x) AS dmin, greatest(coalesce(hi, h.x), h.x) AS dmax FROM hidden h JOIN dep USING (gap_id))
SELECT p.gap_id AS held_out, count(*) AS n_rows, count(DISTINCT r.gap_id) AS n_gaps FROM pool p JOIN rows r ON r.gap_id <> p.gap_id AND (r.dmax < p.a0 OR r.dmin > p.a1) GROUP BY 1""")
def lk4_admissible_rows(spark, d):
    daily, pool = _both(spark, d)
    rows = masking.admissible(edges.edge_table(daily, pool), pool)
    return rows.groupBy("held_out").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("gap_id").alias("n_gaps"))


@query(f"""WITH {EDGES} SELECT h.gap_id, {DAY.format('h.x')} AS date, {r6('(h.x - h.a0 + 1)::DOUBLE / (h.gap_length + 1)', 'position')}, {r6('(v0 + v1) / 2', 'edge_mean')}, {r6('(v1 - v0) / (h.gap_length + 1)', 'edge_slope')},
 {r6('log10(v0 + (h.x - x0)::DOUBLE / (x1 - x0) * (v1 - v0))', 'anchor_log')}, {r6('log10(s1.v) - log10(v0 + (h.x - x0)::DOUBLE / (x1 - x0) * (v1 - v0))', 'residual_log')}, {r6('sin(2 * pi() * dayofyear(s1.date) / 365.25)', 'doy_sin')}
FROM hidden h JOIN edge USING (gap_id) JOIN s1 ON s1.x = h.x""")
def ml1_edge_table(spark, d):
    t = edges.edge_table(*_both(spark, d)).select("gap_id", "date", "position", "edge_mean", "edge_slope", "anchor_log", "residual_log", "doy_sin")
    return _round(t, "position", "edge_mean", "edge_slope", "anchor_log", "residual_log", "doy_sin")


_SIDES = "('last'), ('last_log'), ('days_since'), ('mean_3d'), ('mean_7d'), ('mean_14d'), ('median_7d'), ('std_7d'), ('slope_3d'), ('slope_7d'), ('delta')"
_AFTER = "('first'), ('first_log'), ('days_until'), ('mean_3d'), ('mean_7d'), ('median_7d'), ('std_7d'), ('slope_3d'), ('slope_7d'), ('delta')"


@query(f"""SELECT 'pre_' || n AS feature, 'pre_edge' AS family, true AS pre_only FROM (VALUES {_SIDES}) t(n) UNION ALL SELECT 'post_' || n, 'post_edge', false FROM (VALUES {_AFTER}) t(n)
UNION ALL SELECT 'edge_' || n, 'edge', false FROM (VALUES ('mean'), ('log_mean'), ('delta'), ('delta_log'), ('slope'), ('log_slope')) t(n)""")
def ml2_feature_registry(spark, d):
    return edges.registry(spark)


@query()
def ml3_gap_edge_models(spark, d):
    daily, pool = _both(spark, d)
    table = edges.edge_table(daily, pool)
    keep = [*edges.predictors(), "residual_log", "anchor_log"]
    train = masking.admissible(table, pool).select("held_out", "x", *keep)
    test = table.select("series_id", "gap_id", "x", *keep)
    return models.leave_one_gap_out(test, train, edges.predictors(), "residual_log", "extra_trees", anchor="anchor_log", trees=TREES, least=30)


@query(f"""WITH {POOL}, {S2}, tr AS (SELECT x, f_count::DOUBLE AS a, f_mean AS b, v AS y FROM s1 JOIN s2 USING (date) WHERE e AND v IS NOT NULL),
fit AS (SELECT gap_id, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) * count(*) + 1 AS saa, var_pop(b) * count(*) + 1 AS sbb, covar_pop(a, b) * count(*) AS sab,
  covar_pop(a, y) * count(*) AS say, covar_pop(b, y) * count(*) AS sby FROM pool JOIN tr ON tr.x NOT BETWEEN a0 AND a1 GROUP BY 1)
SELECT gap_id, h.x, floor((CASE WHEN fit.n >= 10 THEN my + (f_count - ma) * (say * sbb - sby * sab) / (saa * sbb - sab * sab) + (f_mean - mb) * (sby * saa - say * sab) / (saa * sbb - sab * sab) END) * 1e3 + 0.5003) / 1e3 AS prediction
FROM hidden h JOIN s1 USING (x) JOIN s2 USING (date) JOIN fit USING (gap_id)""")
def ml9_external_models(spark, d):
    daily, pool = _both(spark, d)
    out = models.ridge_outside(daily.withColumn("y", F.col("value")), series.feature_series(spark, d), pool, ["f_count", "f_mean"])
    return _round_to(out.select("gap_id", "x", "prediction"), 3, "prediction")


@query(f"""WITH {POOL}, {S2}, ft AS (SELECT x, date FROM s1 JOIN s2 USING (date)), tr AS (SELECT x FROM ft JOIN known USING (x)),
c AS (SELECT gap_id, (SELECT count(*) FROM ft WHERE ft.x BETWEEN a0 AND a1) AS n_days, (SELECT count(*) FROM tr WHERE tr.x NOT BETWEEN a0 AND a1) AS n_train FROM pool)
SELECT gap_id, n_days, n_train, CASE WHEN n_days = 0 THEN 'no days to predict' ELSE 'too few training rows' END AS warning FROM c WHERE n_days = 0 OR n_train < 1830""")
def ml6_fit_warnings(spark, d):
    """Gaps that a learner which asks for 1,830 training days can't predict."""
    daily, pool = _both(spark, d)
    test, train = models.external_rows(daily.withColumn("y", F.col("value")), series.feature_series(spark, d), pool)
    return models.fit_warnings(pool, test, train, "y", least=1830)


@query()
def ml10_gaussian_process(spark, d):
    daily, pool = _both(spark, d)
    return models.gp_gaps(daily.withColumn("y", F.when(F.col("eligible"), S.guarded_log10(F.col("value")))), pool, fixed=False)


@query()
def ml12_fixed_gaussian_process(spark, d):
    daily, pool = _both(spark, d)
    return models.gp_gaps(daily.withColumn("y", F.when(F.col("eligible"), S.guarded_log10(F.col("value")))), pool)


@query()
def ml14_kalman_parameters(spark, d):
    return models.kalman_parameters(series.model_series(series.main_series(spark, d)))


@query()
def ml15_kalman_gaps(spark, d):
    daily, pool = _both(spark, d)
    y = series.model_series(daily)
    return models.kalman_gaps(y, pool, models.kalman_parameters(y))


@query()
def ml17_engineered_hybrid(spark, d):
    daily, pool = _both(spark, d)
    y = daily.withColumn("y", F.when(F.col("eligible"), S.guarded_log10(F.col("value"))))
    routed = pool.withColumn("method", S.route(F.col("gap_length"), "C"))
    own = lambda m: pool.join(routed.where(F.col("method") == m).select("gap_id"), "gap_id", "left_semi")
    z = series.model_series(daily)
    table = edges.edge_table(daily, pool)  # every gap can train
    keep = [*edges.predictors(), "residual_log", "anchor_log"]
    held = own("gap_edge")
    test = table.join(held.select("gap_id"), "gap_id", "left_semi").select("series_id", "gap_id", "x", *keep)
    edge = models.leave_one_gap_out(test, masking.admissible(table, held).select("held_out", "x", *keep), edges.predictors(), "residual_log", "extra_trees", anchor="anchor_log", trees=500)
    kalman = models.kalman_gaps(z, own("kalman"), models.kalman_parameters(z))
    return models.hybrid(routed, {"gaussian_process": models.gp_gaps(y, own("gaussian_process"), fixed=False), "kalman": kalman, "gap_edge": edge})


# --- paired statistics and tails --------------------------------------------------------------------------


@query(f"WITH {PREDICTED} SELECT gap_id, count(*) AS n_common, 0::BIGINT AS n_only_a, 0::BIGINT AS n_only_b, 0::BIGINT AS n_repeated FROM scored WHERE method = 'linear' GROUP BY 1")
def ps3_pairing_report(spark, d):
    return paired.pairing(_scored(spark, d), "linear", "climatology")


@query(f"""WITH {PREDICTED}, pr AS (SELECT gap_id, a.a AS ea, b.a AS eb FROM scored a JOIN scored b USING (gap_id, x) WHERE a.method = 'linear' AND b.method = 'climatology' AND a.a IS NOT NULL AND b.a IS NOT NULL),
g AS (SELECT gap_id, count(*) AS n, sum(ea) AS sa, sum(eb) AS sb FROM pr GROUP BY 1), num AS (SELECT *, row_number() OVER (ORDER BY gap_id) - 1 AS i FROM g), sz AS (SELECT count(*) AS c FROM g),
dr AS (SELECT r, ('0x' || substr(md5('42|' || r || '|' || s), 1, 8))::BIGINT % c AS i FROM sz, generate_series(0, 1999) a(r), LATERAL (SELECT unnest(generate_series(0, c - 1)) AS s) q),
rp AS (SELECT r, (sum(sa) - sum(sb)) / sum(n) AS dd, avg((sa - sb) / n) AS gd FROM dr JOIN num USING (i) GROUP BY r),
pt AS (SELECT count(*) AS n_gaps, (sum(sa) - sum(sb)) / sum(n) AS day_delta, avg((sa - sb) / n) AS gap_delta FROM g),
ci AS (SELECT quantile_cont(dd, 0.025) AS day_lo, quantile_cont(dd, 0.975) AS day_hi, quantile_cont(gd, 0.025) AS gap_lo, quantile_cont(gd, 0.975) AS gap_hi FROM rp)
SELECT n_gaps, {r6('day_delta', 'day_delta')}, {r6('gap_delta', 'gap_delta')}, {r6('day_lo', 'day_lo')}, {r6('day_hi', 'day_hi')}, {r6('gap_lo', 'gap_lo')}, {r6('gap_hi', 'gap_hi')},
 CASE WHEN n_gaps < 10 THEN 'insufficient' WHEN gap_lo < 0 AND gap_hi < 0 THEN 'improvement' WHEN gap_lo > 0 AND gap_hi > 0 THEN 'degradation' WHEN abs(gap_delta) < 1e-6 THEN 'indistinguishable' ELSE 'directional' END AS interpretation FROM pt, ci""")
def ps2_paired_bootstrap(spark, d):
    days = paired.check_pairs(_scored(spark, d), "linear", "climatology", "intersection")
    return _round(paired.bootstrap(days, 2000), "day_delta", "gap_delta", "day_lo", "day_hi", "gap_lo", "gap_hi")


@query()
def ps2_exact_bootstrap(spark, d):
    return paired.exact_bootstrap(paired.check_pairs(_scored(spark, d), "linear", "climatology", "intersection"), 2000)


_Q = "qs AS (SELECT quantile_cont(v, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q FROM known)"
_BAND = "CASE WHEN {v} >= q[5] THEN 'above_p90' WHEN {v} >= q[4] THEN 'p75_to_p90' WHEN {v} >= q[3] THEN 'p50_to_p75' WHEN {v} >= q[2] THEN 'p25_to_p50' WHEN {v} >= q[1] THEN 'p10_to_p25' ELSE 'below_p10' END"


@query(f"WITH {S1}, {_Q} SELECT date, {_BAND.format(v='v')} AS band FROM known, qs")
def td1_quantile_bands(spark, d):
    return tails.banded(series.main_series(spark, d)).select("date", "band")


@query(f"WITH {S1}, {_Q} SELECT date, v <= q[1] AS low, v >= q[5] AS high FROM known, qs")
def td2_tail_days(spark, d):
    return tails.tail_days(series.main_series(spark, d)).select("date", "low", "high")


@query(f"""WITH {S1}, {_Q}, t AS (SELECT 'low' AS tail, x FROM known, qs WHERE v <= q[1] UNION ALL SELECT 'high', x FROM known, qs WHERE v >= q[5]),
r AS (SELECT tail, min(x) AS x0, max(x) AS x1, count(*) AS length FROM (SELECT tail, x, x - row_number() OVER (PARTITION BY tail ORDER BY x) AS g FROM t) GROUP BY tail, g)
SELECT tail, {DAY.format('x0')} AS start, {DAY.format('x1')} AS "end", length, CASE WHEN length = 1 THEN 'isolated' WHEN length <= 6 THEN 'short' ELSE 'persistent' END AS persistence FROM r""")
def td3_tail_runs(spark, d):
    return tails.tail_runs(series.main_series(spark, d)).drop("series_id")


@query(f"WITH {PREDICTED}, {_Q} SELECT method, {_BAND.format(v='truth')} AS band, count(*) AS n_days, {r6('avg(a)', 'mae')} FROM scored, qs WHERE a IS NOT NULL GROUP BY 1, 2")
def td4_errors_by_band(spark, d):
    return _round(tails.errors_by_band(_scored(spark, d), series.main_series(spark, d)), "mae")


# --- covariates -------------------------------------------------------------------------------------------


@query(f"WITH {S2}, r AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS c FROM s2) SELECT a.date, b.f_count, b.f_mean FROM r a JOIN r b ON a.i = (b.i + 90) % b.c")
def cv1_wrong_lag(spark, d):
    return covariates.placebo(series.feature_series(spark, d), ["f_count", "f_mean"], "wrong_lag").select("date", "f_count", "f_mean")


@query(f"""WITH {S2}, r AS (SELECT *, month(date) AS m, row_number() OVER (PARTITION BY month(date) ORDER BY date) AS k, row_number() OVER (PARTITION BY month(date) ORDER BY md5('42|' || date_diff('day', DATE '1970-01-01', date))) AS j FROM s2)
SELECT a.date, b.f_count, b.f_mean FROM r a JOIN r b ON a.m = b.m AND a.k = b.j""")
def cv1_season_shuffled(spark, d):
    return covariates.placebo(series.feature_series(spark, d), ["f_count", "f_mean"], "season_shuffled").select("date", "f_count", "f_mean")


# --- runs, routing, assembly ------------------------------------------------------------------------------


def _ledgers(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A run's records made from the pool: by md5 some keys succeed (some twice), fail, or are malformed."""
    _, pool = _both(spark, d)
    grid = covariates.call_grid(pool.where("gap_length >= 7"), ["full_series"], ["none"])
    h = F.conv(F.substring(F.md5("key"), 1, 2), 16, 10).cast("int")
    rows = grid.withColumn("h", h)
    times = F.when(F.col("h") < 100, 1).when(F.col("h") < 140, 2).otherwise(0)
    ok = rows.select("key", "h", F.explode(F.when(times > 0, F.sequence(F.lit(1), times))).alias("seq"))
    day = F.array(F.lit("2020-01-01"))
    ok = ok.select("key", "seq", day.alias("date"), F.when(F.col("h") < 20, F.array(F.lit(None).cast("double"))).otherwise(F.array(F.lit(1.0))).alias("pred_log10"))
    bad = rows.where("h >= 90 and h < 220").select("key", F.explode(F.sequence(F.lit(1), F.pmod("h", F.lit(4)) + 1)).alias("seq"), F.concat(F.lit("error "), F.col("h").cast("string")).alias("error"))
    return grid, ok, bad


_LEDGER = f"""{POOL}, grid AS (SELECT gap_id || '|full_series|none' AS key FROM pool WHERE gap_length >= 7), hh AS (SELECT key, ('0x' || substr(md5(key), 1, 2))::INT AS h FROM grid),
st AS (SELECT key, h, CASE WHEN h >= 20 AND h < 100 THEN 1 WHEN h >= 100 AND h < 140 THEN 2 ELSE 0 END AS n_valid, CASE WHEN h < 20 THEN 1 ELSE 0 END AS n_malformed, CASE WHEN h >= 90 AND h < 220 THEN h % 4 + 1 ELSE 0 END AS attempts FROM hh WHERE h < 220),
stt AS (SELECT *, CASE WHEN n_valid > 0 THEN 'successful' WHEN attempts > 0 THEN 'failed' ELSE 'malformed' END AS status FROM st)"""


@query(f"WITH {_LEDGER} SELECT key, n_valid::BIGINT AS n_valid, n_malformed::BIGINT AS n_malformed, attempts::BIGINT AS attempts, CASE WHEN attempts > 0 THEN 'error ' || h END AS last_error, status, n_valid > 1 AS is_duplicate FROM stt")
def rs1_run_state(spark, d):
    _, ok, bad = _ledgers(spark, d)
    return ledger.state(ok, bad)


@query(f"WITH {_LEDGER} SELECT key FROM grid WHERE key NOT IN (SELECT key FROM stt WHERE status = 'successful' OR attempts >= 3)")
def rs2_outstanding_calls(spark, d):
    grid, ok, bad = _ledgers(spark, d)
    return ledger.outstanding(grid.select("key"), ledger.state(ok, bad))


@query(f"""WITH {_LEDGER}, c AS (SELECT (SELECT count(*) FROM grid) AS n_expected, count(*) FILTER (status = 'successful') AS n_successful, count(*) FILTER (status <> 'successful' AND attempts >= 3) AS n_exhausted, count(*) FILTER (n_valid > 1) AS n_duplicate FROM stt)
SELECT *, CASE WHEN n_successful = n_expected THEN 'COMPLETE' WHEN n_exhausted > 0 THEN 'FAILED' ELSE 'PARTIAL' END AS run_status FROM c""")
def rs3_run_status(spark, d):
    grid, ok, bad = _ledgers(spark, d)
    return ledger.classify(grid, ledger.state(ok, bad))


@query(f"""WITH {POOL}, f AS (SELECT gap_id, gap_length, x, CASE WHEN x % 11 = 0 THEN 'nan'::DOUBLE ELSE 1 END AS p FROM hidden WHERE md5(gap_id) >= '2'),
r AS (SELECT * FROM f UNION ALL SELECT * FROM f WHERE x % 7 = 0)
SELECT 'missing_gaps' AS "check", (SELECT count(*) FROM pool WHERE md5(gap_id) < '2') AS n UNION ALL SELECT 'repeated_rows', (SELECT count(*) FROM f WHERE x % 7 = 0)
UNION ALL SELECT 'row_difference', (SELECT count(*) FROM r) - (SELECT sum(gap_length) FROM pool)::BIGINT UNION ALL SELECT 'not_finite', (SELECT count(*) FROM r WHERE isnan(p))""")
def rs7_integrity(spark, d):
    """Predictions with planted faults: gaps left out, days twice, values that aren't numbers."""
    daily, pool = _both(spark, d)
    rows = baselines.linear(daily, pool).where(F.md5("gap_id") >= "2").withColumn("prediction", F.when(F.col("x") % 11 == 0, F.lit(float("nan"))).otherwise(F.lit(1.0)))
    return assembly.integrity(rows.unionByName(rows.where("x % 7 = 0")), pool)


@query(f"WITH {RUNS} SELECT {DAY.format('x0')} AS start, len AS length, CASE WHEN x1 < (SELECT max(x) FROM s1) AND EXISTS (SELECT 1 FROM s1 WHERE e AND x BETWEEN gaps.x1 + 1 AND gaps.x1 + 14) THEN CASE WHEN len <= 3 THEN 'gaussian_process' WHEN len <= 29 THEN 'kalman' ELSE 'gap_edge' END END AS method FROM gaps")
def rt1_route_real_gaps(spark, d):
    return assembly.route(intervals.real_gaps(series.main_series(spark, d))).select("start", "length", "method")


def _candidates(spark, d):
    daily = series.main_series(spark, d)
    gaps = intervals.real_gaps(daily)
    filled = baselines.fill_real_gaps(daily).join(gaps.select(F.col("gap_id").alias("real_id"), "start", "end"), F.col("date").between(F.col("start"), F.col("end"))).select(F.col("real_id").alias("gap_id"), "date", "x", "prediction")
    hyb = filled.where("x % 3 <> 0").select("gap_id", "date", F.lit(True).alias("is_reconstructed"), F.col("prediction").alias("final_value"), F.when(F.col("x") % 2 == 0, "kalman").otherwise("gap_edge").alias("method"))
    seq = filled.where("x % 5 <> 0").select("gap_id", "date", (F.col("prediction") * 1.1).alias("pred"), F.array(F.col("prediction"), F.col("prediction") * 1.2).alias("quantiles"))
    return daily, gaps, assembly.assemble(assembly.hybrid_candidates(hyb), assembly.sequence_candidates(seq))


_FILL = f"""{RUNS}, nr AS (SELECT s1.x, max(k.x) OVER (ORDER BY s1.x) AS px, min(k.x) OVER (ORDER BY s1.x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qx FROM s1 LEFT JOIN known k ON k.x = s1.x),
fill AS (SELECT g.x0, s1.x, s1.date, p.v + (s1.x - px)::DOUBLE / (qx - px) * (q.v - p.v) AS f FROM s1 JOIN gaps g ON s1.x BETWEEN g.x0 AND g.x1 JOIN nr ON nr.x = s1.x LEFT JOIN known p ON p.x = px LEFT JOIN known q ON q.x = qx),
cand AS (SELECT x0, x, date, CASE WHEN x % 3 <> 0 THEN f END AS h, CASE WHEN x % 5 <> 0 THEN f * 1.1 END AS s, CASE WHEN x % 3 <> 0 THEN CASE WHEN x % 2 = 0 THEN 'kalman' ELSE 'gap_edge' END END AS c FROM fill WHERE x % 3 <> 0 OR x % 5 <> 0)"""


@query(f"WITH {_FILL} SELECT date, {r6('h', 'hybrid_pred')}, {r6('s', 'sequence_pred')}, c AS component_method FROM cand")
def rt2_assemble_candidates(spark, d):
    _, _, days = _candidates(spark, d)
    return _round(days.select("date", "hybrid_pred", "sequence_pred", "component_method"), "hybrid_pred", "sequence_pred")


@query(f"""WITH {_FILL}, a AS (SELECT x0, count(*) AS n_days, bool_or(h IS NOT NULL) AS has_hybrid, bool_or(s IS NOT NULL) AS has_sequence, avg(h) AS hm, avg(s) AS sm, arg_min(c, x) FILTER (c IS NOT NULL) AS component_method FROM cand GROUP BY x0)
SELECT {DAY.format('g.x0')} AS start, len AS length, coalesce(n_days, 0) AS n_days, {r6('hm', 'hybrid_mean')}, {r6('sm', 'sequence_mean')}, component_method,
 CASE WHEN has_hybrid AND has_sequence THEN 'both candidates' WHEN has_hybrid THEN 'hybrid only' WHEN has_sequence THEN 'sequence only' ELSE 'no candidate' END AS support_note FROM gaps g LEFT JOIN a USING (x0)""")
def ag15_gap_level_candidates(spark, d):
    _, gaps, days = _candidates(spark, d)
    out = assembly.gap_level(days, gaps).join(gaps.select("gap_id", "start"), "gap_id")
    return _round(out.select("start", "length", "n_days", "hybrid_mean", "sequence_mean", "component_method", "support_note"), "hybrid_mean", "sequence_mean")


@query(f"WITH {_FILL} SELECT s1.date, CASE WHEN e AND v IS NOT NULL THEN 'observed' WHEN coalesce(h, s) IS NOT NULL THEN 'candidate' ELSE 'missing' END AS evidence_label FROM s1 LEFT JOIN cand USING (x)")
def rt6_evidence_labels(spark, d):
    daily, _, days = _candidates(spark, d)
    return assembly.labelled(daily, days).select("date", "evidence_label")


@query(f"WITH {_FILL} SELECT date, {r6('abs(h - s)', 'gap')} FROM cand WHERE h IS NOT NULL AND s IS NOT NULL ORDER BY abs(h - s) DESC, date LIMIT 10")
def so6_largest_divergence(spark, d):
    _, _, days = _candidates(spark, d)
    return _round(assembly.divergence(days).select("date", "gap"), "gap")


@query(f"""WITH {_FILL} SELECT * FROM (VALUES
 ('not_finite', (SELECT count(*) FROM cand WHERE x % 23 = 0 AND h IS NOT NULL)), ('quantiles_fall', (SELECT count(*) FROM cand WHERE x % 19 = 0 AND s IS NOT NULL)),
 ('unknown_gap', (SELECT count(*) FROM cand WHERE x % 29 = 0)), ('outside_gap', (SELECT count(*) FROM cand JOIN gaps USING (x0) WHERE x % 29 <> 0 AND x % 31 = 0)), ('repeated_day', 0::BIGINT)) t(rule, n)""")
def vf4_candidate_violations(spark, d):
    """Candidates with planted faults: infinite values, falling quantiles, unknown gaps, days years away from their gap."""
    _, gaps, days = _candidates(spark, d)
    x = F.unix_date("date")
    days = days.withColumn("hybrid_pred", F.when((x % 23 == 0) & F.col("hybrid_pred").isNotNull(), F.lit(float("inf"))).otherwise(F.col("hybrid_pred")))
    days = days.withColumn("quantiles", F.when(x % 19 == 0, F.reverse("quantiles")).otherwise(F.col("quantiles")))
    days = days.withColumn("gap_id", F.when(x % 29 == 0, F.concat(F.lit("NONE_"), x.cast("string"))).otherwise(F.col("gap_id")))
    return assembly.violations(days.withColumn("date", F.when(x % 31 == 0, F.date_add("date", 20_000)).otherwise(F.col("date"))), gaps)


_FROZEN = f"""{PREDICTED}, s AS (SELECT method, gap_length, avg(a) AS mae, avg(e) AS bias FROM scored WHERE e IS NOT NULL GROUP BY 1, 2), u AS (SELECT method, gap_length, 'mae' AS metric, mae AS v FROM s UNION ALL SELECT method, gap_length, 'bias', bias FROM s),
fz AS (SELECT *, CASE WHEN gap_length < 14 THEN CASE WHEN method = 'climatology' THEN v ELSE floor(v * 10) / 10 END END AS fv FROM u),
ck AS (SELECT method, gap_length, metric, CASE WHEN fv IS NULL THEN 'unavailable' WHEN v = fv THEN 'exact' WHEN abs(v - fv) < 1e-9 THEN 'numerically_equal' WHEN abs(v - fv) < CASE WHEN method = 'linear' THEN 0.06 ELSE 0.03 END THEN 'within_tolerance' ELSE 'mismatched' END AS status FROM fz)"""


def _verified(spark, d):
    """Our scores beside frozen ones that were cut to one decimal, and lack a length; how far they agree isn't known beforehand."""
    s = scoring.by_length(_scored(spark, d)).select("method", "gap_length", F.col("day_weighted_mae").alias("mae"), "bias")
    s = _round(s, "mae", "bias")  # both sides come from runs of their own, whose sums may differ in the last digit
    cut = lambda c: F.when(F.col("method") == "climatology", F.col(c)).otherwise(F.floor(F.col(c) * 10) / 10)
    frozen = s.where("gap_length < 14").withColumns({"mae": cut("mae"), "bias": cut("bias")})
    return assembly.verify(s, frozen, ["method", "gap_length"], ["mae", "bias"], {"linear": 0.06}, 0.03)


@query(f"WITH {_FROZEN} SELECT method, gap_length::BIGINT AS gap_length, metric, status FROM ck")
def vf1_verify_scores(spark, d):
    return _verified(spark, d).drop("ours", "frozen")


@query(f"""WITH {_FROZEN} SELECT method, count(*) AS n, CASE WHEN count(*) FILTER (status <> 'unavailable') = 0 THEN 'not_applicable' WHEN count(*) FILTER (status IN ('exact', 'numerically_equal', 'within_tolerance')) = count(*) THEN 'reproduced'
 WHEN count(*) FILTER (status = 'mismatched') = 0 THEN 'partial' ELSE 'mismatched' END AS overall FROM ck GROUP BY 1""")
def ag20_verification_rollup(spark, d):
    return assembly.overall(_verified(spark, d)).select("method", "n", "overall")


@query(f"""WITH {EDGES} SELECT count(*) FILTER (x % 13 = 0) AS n_unpaired, 0.0000001::DOUBLE AS max_difference, count(*) FILTER (x % 13 = 0 OR x % 17 = 0) AS n_unequal, 'not_repeatable' AS verdict FROM hidden""")
def vf3_repeatability(spark, d):
    """Two runs of which the second lacks days and differs on others."""
    daily, pool = _both(spark, d)
    a = baselines.persistence(daily, pool).select(F.col("gap_id").alias("key"), "date", "x", F.lit(0.5).alias("prediction"))
    b = a.where("x % 13 <> 0").withColumn("prediction", F.when(F.col("x") % 17 == 0, F.lit(0.5 + 1e-7)).otherwise(F.col("prediction")))
    return _round_to(assembly.repeatability(a.drop("x"), b.drop("x")), 9, "max_difference")


@query(f"""WITH {POOL}, kn AS (SELECT x, log10(v)::FLOAT::DOUBLE AS y FROM known WHERE v > 1e-4), lim AS (SELECT min(x) AS lo, max(x) AS hi FROM s1),
win AS (SELECT gap_id, a0, a1, greatest(a0 - 90, lo) AS w0, least(a1 + 90, hi) AS w1 FROM pool, lim),
pre AS (SELECT gap_id, max(x) AS px FROM win JOIN kn ON kn.x BETWEEN w0 AND a0 - 1 GROUP BY 1), post AS (SELECT gap_id, min(x) AS qx FROM win JOIN kn ON kn.x BETWEEN a1 + 1 AND w1 GROUP BY 1),
val AS (SELECT h.gap_id, h.x, w1 - w0 + 1 AS n_context, CASE WHEN px IS NULL THEN b.y WHEN qx IS NULL THEN a.y ELSE a.y + (h.x - px) * (b.y - a.y) / (qx - px) END AS p,
  0.05 * sqrt(CASE WHEN px IS NULL THEN qx - h.x WHEN qx IS NULL THEN h.x - px ELSE least(h.x - px, qx - h.x) END) AS w
  FROM hidden h JOIN win USING (gap_id) LEFT JOIN pre USING (gap_id) LEFT JOIN post USING (gap_id) LEFT JOIN kn a ON a.x = px LEFT JOIN kn b ON b.x = qx)
SELECT gap_id, x, n_context, p IS NULL AS failed, floor(p * 1e5 + 0.5003) / 1e5 AS prediction, floor((p - 1.645 * w) * 1e5 + 0.5003) / 1e5 AS q05, floor((p + 1.645 * w) * 1e5 + 0.5003) / 1e5 AS q95 FROM val""")
def fm5_sequence_inference(spark, d):
    daily, pool = _both(spark, d)
    out = backends.infer(series.model_series(daily), pool, backends.Stand())
    out = out.select("gap_id", "x", "n_context", F.col("error").isNotNull().alias("failed"), "prediction", F.get("quantiles", F.lit(0)).alias("q05"), F.get("quantiles", F.lit(6)).alias("q95"))
    return _round_to(out, 5, "prediction", "q05", "q95")


# --- more aggregates and set operations -------------------------------------------------------------------


@query(f"""WITH {PREDICTED} SELECT method, count(DISTINCT gap_id) AS n_gaps, count(*) AS n_days, {r6('avg(a)', 'day_weighted_mae')}, {r6('sqrt(avg(e * e))', 'rmse')} FROM scored GROUP BY 1""")
def ag10_scores_counted_before(spark, d):
    s = scoring.scores(_scored(spark, d), "method", counted_before=True)
    return _round(s.select("method", "n_gaps", "n_days", "day_weighted_mae", "rmse"), "day_weighted_mae", "rmse")


@query(f"""WITH {PREDICTED}, s AS (SELECT method, count(*) AS n_gaps, avg(m) AS gw FROM (SELECT method, gap_id, avg(a) AS m FROM scored WHERE e IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT method, n_gaps, CASE WHEN method = 'climatology' THEN 'unavailable' WHEN abs(gw - floor(gw * 10) / 10) <= 0.05 THEN 'reproduced' ELSE 'mismatched' END AS status FROM s""")
def ag17_against_frozen(spark, d):
    rows = _scored(spark, d)
    s = scoring.scores(rows, "method").where("method <> 'climatology'")
    return scoring.against_frozen(rows, s.select("method", (F.floor(F.col("gap_weighted_mae") * 10) / 10).alias("frozen_mae")), 0.05).select("method", "n_gaps", "status")


@query(f"{_LABELS} SELECT gap_id, season AS majority FROM se")
def ag21_majority_season(spark, d):
    _, pool = _both(spark, d)
    return intervals.majority(intervals.hidden_days(pool), "gap_id", S.season(F.col("date")), "x")


@query("""WITH h AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS date, count(DISTINCT hour(ts)) AS k FROM events GROUP BY 1, 2),
c AS (SELECT series_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM h GROUP BY 1)
SELECT series_id, count(*) AS n_days, count(*) FILTER (k >= 22) AS n_eligible, min(date) AS first_day, max(date) AS last_day FROM c LEFT JOIN h USING (series_id, date) GROUP BY 1""")
def ag23_coverage_by_series(spark, d):
    days = covariates.daily_from_hours(series.hourly(spark, d)).select("series_id", "date", F.col("mean").alias("value"), F.col("eligible_ge_22").alias("eligible"))
    return intervals.coverage(intervals.densify(days)).select("series_id", "n_days", "n_eligible", "first_day", "last_day")


@query(f"WITH {_METRICS} SELECT method, {r6('100 * (avg(mae) / (SELECT avg(mae) FROM gm WHERE method = \'linear\') - 1)', 'change_pct')} FROM gm WHERE mae IS NOT NULL GROUP BY 1")
def ag24_improvement(spark, d):
    return _round(scoring.improvement(_scored(spark, d), "linear").select("method", "change_pct"), "change_pct")


@query(f"""WITH {_METRICS}, g AS (SELECT gap_id, mae AS v, row_number() OVER (ORDER BY gap_id) - 1 AS i FROM gm WHERE method = 'linear' AND mae IS NOT NULL), sz AS (SELECT count(*) AS c FROM g),
dr AS (SELECT r, ('0x' || substr(md5('42|' || r || '|' || s), 1, 8))::BIGINT % c AS i FROM sz, generate_series(0, 1999) a(r), LATERAL (SELECT unnest(generate_series(0, c - 1)) AS s) q),
rp AS (SELECT r, avg(v) AS m FROM dr JOIN g USING (i) GROUP BY r)
SELECT {r6('(SELECT avg(v) FROM g)', 'mean')}, {r6('quantile_cont(m, 0.025)', 'lo')}, {r6('quantile_cont(m, 0.975)', 'hi')} FROM rp""")
def ps1_cluster_interval(spark, d):
    m = scoring.gap_metrics(_scored(spark, d).where("method = 'linear'"), digits=9)
    return _round(paired.cluster_interval(m, "mae", 2000), "mean", "lo", "hi")


@query(f"WITH {POOL} SELECT gap_id, start FROM pool ORDER BY start, gap_id LIMIT 10")
def so4_first_gaps(spark, d):
    _, pool = _both(spark, d)
    return pool.orderBy("start", "gap_id").limit(10).select("gap_id", "start")


@query(f"WITH {POOL} SELECT gap_length::BIGINT AS gap_length, count(*) AS n FROM (SELECT gap_length, gap_id FROM pool UNION ALL SELECT gap_length, gap_id FROM pool WHERE gap_length > 1) GROUP BY 1")
def st1_union_all(spark, d):
    _, pool = _both(spark, d)
    return pool.unionByName(pool.where("gap_length > 1")).groupBy("gap_length").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {POOL}, again AS (SELECT gap_length, arg_min(sx, md5('43|' || gap_length || '|' || sx)) AS sx FROM blk GROUP BY gap_length, b),
both_ AS (SELECT gap_length, a0 AS sx FROM pool UNION ALL SELECT gap_length, sx FROM again)
SELECT 'L' || lpad(gap_length::VARCHAR, 2, '0') || '_' || strftime(DATE '1970-01-01' + sx::INT, '%Y%m%d') AS gap_id, count(*) AS n FROM both_ GROUP BY gap_length, sx HAVING count(*) > 1""")
def st5_repeated_gaps(spark, d):
    """Gaps that two samples with different seeds have in common."""
    daily, pool = _both(spark, d)
    again = intervals.block_sample(intervals.candidate_starts(intervals.eligible_runs(daily), LENGTHS), "43")
    return pool.unionByName(again).groupBy("gap_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"""WITH {POOL} SELECT gap_id, count(*) AS n_rows, count(*) FILTER (x BETWEEN a0 AND a1) AS n_leaked, 0::BIGINT AS n_leaked_visible FROM pool JOIN known ON x BETWEEN a0 - 30 AND a1 + 30 GROUP BY gap_id""")
def lk5_no_leak(spark, d):
    """Rows around each gap with the gap's own days left in, which must all be found, and the visible rows, with none."""
    daily, pool = _both(spark, d)
    near = pool.select("gap_id", F.explode(F.sequence(F.date_sub("start", 30), F.date_add("end", 30))).alias("date"))
    rows = daily.where(baselines.seen()).join(near, "date")
    count = lambda df, n: df.groupBy("gap_id").agg(F.count(F.lit(1)).alias(n))
    out = count(rows, "n_rows").join(count(masking.leaked(rows, pool), "n_leaked"), "gap_id", "left")
    return out.join(count(masking.leaked(masking.visible(daily, pool, 30, 30), pool), "n_leaked_visible"), "gap_id", "left").fillna(0)


@query()
def ml4_external_reference(spark, d):
    daily, pool = _both(spark, d)
    table = edges.edge_table(daily, pool).join(series.feature_series(spark, d).drop("x"), "date", "left")
    f = ["f_count", "f_mean", *edges.meta()]
    train = masking.admissible(table, pool).select("held_out", "x", *f, "truth_log")
    return models.leave_one_gap_out(table.select("series_id", "gap_id", "x", *f, "truth_log"), train, f, "truth_log", "hist_boosted")
