"""Sources and sinks. A daily series is keyed: (series_id, date, x, value, eligible), x the day's number."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import guarded_log10, rounded
from ..operators.intervals import densify

DAILY = T.StructType([T.StructField("date", T.DateType()), T.StructField("value", T.DoubleType()), T.StructField("eligible", T.BooleanType())])


def not_nan(c: str) -> Column:
    """Missing is NULL everywhere; NaN ends here."""
    return F.when(~F.isnan(c), F.col(c))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV scan with an explicit schema (nothing is inferred, so nothing is read twice)."""
    return spark.read.csv(path, header=True, schema=schema)


def read_daily(spark: SparkSession, path: str, date: str = "date", value: str = "value", eligible: str = "eligible", series: str = "main") -> DataFrame:
    fields = {date: "date", value: "double", eligible: "boolean"}
    names = spark.read.csv(path, header=True).columns
    rows = read_csv(spark, path, ", ".join(f"`{n}` {fields.get(n, 'string')}" for n in names))
    return rows.select(
        F.lit(series).alias("series_id"), F.col(date).alias("date"), F.unix_date(date).alias("x"), not_nan(value).alias("value"),
        F.coalesce(F.col(eligible), F.lit(False)).alias("eligible"),
    )


def daily_counts(rows: DataFrame, ts: str, value: str, series: str) -> DataFrame:
    """Events by day: (series_id, date, n, value), value the day's mean."""
    return rows.groupBy(F.to_date(ts).alias("date")).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(value), 4).alias("value")).withColumn("series_id", F.lit(series))


def by_coverage(days: DataFrame, share: float = 0.25) -> DataFrame:
    """A dense series; a day is eligible if its count reaches the share's quantile of all days' counts."""
    dense = densify(days).withColumn("n", F.coalesce("n", F.lit(0)))
    level = dense.groupBy("series_id").agg(F.expr(f"percentile(n, {share})").alias("level"))
    return dense.join(level, "series_id").select("series_id", "date", "x", "n", "value", (F.col("n") >= F.col("level")).alias("eligible"))


def main_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_coverage(daily_counts(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_shipdate", "l_extendedprice", "S1"))


def feature_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second daily table for features: (date, x, f_count, f_mean)."""
    days = daily_counts(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderdate", "o_totalprice", "S2")
    return days.select("date", F.unix_date("date").alias("x"), F.col("n").alias("f_count"), F.col("value").alias("f_mean"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("series_id"), "ts", "value")


def model_series(daily: DataFrame, log: bool = True) -> DataFrame:
    """Single-precision model input: the value (or its logarithm) where eligible, NULL elsewhere."""
    v = F.when(F.col("eligible"), F.col("value"))
    return daily.select("series_id", "date", "x", (guarded_log10(v) if log else v).cast("float").alias("y"))


def gap_specs(pool: DataFrame) -> DataFrame:
    return pool.select("gap_id", F.struct("start", "end", "length").alias("spec"))


def pool_by_role(pool: DataFrame, role: str) -> DataFrame:
    if role not in ("primary", "exploratory_extended", "all"):
        raise ValueError(f"unknown role {role!r}")
    return pool if role == "all" else pool.where(F.col("support_role") == role)


def matched_support(pool: DataFrame, ids: DataFrame, expected: int | None = None) -> DataFrame:
    """The pool's gaps that the list names; an unexpected number is an error."""
    out = pool.join(ids.select("gap_id"), "gap_id", "left_semi")
    if expected is not None and (n := out.count()) != expected:
        raise ValueError(f"{n} gaps match; {expected} were expected")
    return out


LEDGER = (
    "key string, gap_id string, context_mode string, arm string, placebo_transform string, gap_length int, n_context int, date array<string>, "
    "pred_log10 array<double>, true_log10 array<double>, quantile_levels array<double>, quantiles_log10 array<array<double>>, error_type string, error string"
)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).json(path)


def flatten_ledger(ledger: DataFrame) -> DataFrame:
    """One row per predicted day; the error is NULL if either side is."""
    rows = ledger.select("gap_id", "gap_length", F.concat(F.lit("seq_"), "arm", F.lit("__"), F.coalesce("context_mode", F.lit("full_series"))).alias("method_id"), F.inline(F.arrays_zip("date", "pred_log10", "true_log10")))
    return rows.withColumn("date", F.to_date("date")).withColumn("abs_error", F.abs(F.col("pred_log10") - F.col("true_log10")))


# --- sinks ------------------------------------------------------------------------------------------------

EXPORT = ("gap_id", "date", "method", "truth", "prediction", "q05", "q95", "abs_error", "covariates", "runtime_s")


def export_table(rows: DataFrame) -> DataFrame:
    """The mandatory columns in order; a missing one is an error."""
    missing = [c for c in EXPORT if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return rows.select(*EXPORT)


def write_report(df: DataFrame, path: str) -> None:
    """A small table as one CSV file; large results go to Parquet."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_marker(path: str, **state) -> None:
    Path(path).write_text(json.dumps(state, sort_keys=True, indent=1))


def checksum(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of the raw bytes of files in any store."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def demo_window(daily: DataFrame, features: DataFrame, gap: tuple[str, str], reach: int = 75) -> DataFrame:
    """The series joined with features within reach days of a gap, its rows labelled."""
    start, end = (F.to_date(F.lit(g)) for g in gap)
    near = daily.where(F.col("date").between(F.date_sub(start, reach), F.date_add(end, reach)))
    return near.join(features.drop("x"), "date", "left").withColumn("in_gap", F.col("date").between(start, end))


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """A gap pool: identifiers, lengths, dates and roles, other columns as text."""
    kinds = {"gap_length": "int", "start_date": "date", "end_date": "date", "n_hidden_days": "int", "year": "int"}
    names = spark.read.csv(path, header=True).columns
    return read_csv(spark, path, ", ".join(f"`{n}` {kinds.get(n, 'string')}" for n in names))


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """A real-gap inventory: dates, lengths and flags, other columns as text."""
    kinds = {"length_days": "int", "start_date": "date", "end_date": "date", "pre_edge_available": "boolean", "post_edge_available": "boolean"}
    names = spark.read.csv(path, header=True).columns
    return read_csv(spark, path, ", ".join(f"`{n}` {kinds.get(n, 'string')}" for n in names))


def classical_inputs(daily: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(target, features) of the classical methods: unique days of each, or an error."""
    for df, keys in ((daily, ["series_id", "date"]), (features, ["date"])):
        if df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1):
            raise ValueError(f"repeated {keys}")
    return daily, features
