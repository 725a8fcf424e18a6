"""Resumable runs: state rebuilt from append-only ledgers, identities, manifests and caches."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ManifestMismatch(ValueError):
    """A run's manifest is another run's."""


def valid_rows(ledger: DataFrame) -> DataFrame:
    """A success has a key and parallel arrays without NULLs (a NaN passes, as finiteness is checked elsewhere)."""
    same = (F.size("date") == F.size("pred_log10")) & (F.size("date") > 0)
    return ledger.withColumn("is_valid", F.coalesce(F.col("key").isNotNull() & same & F.forall("pred_log10", lambda v: v.isNotNull()), F.lit(False)))


def state(success: DataFrame, failures: DataFrame) -> DataFrame:
    """(key, n_valid, n_malformed, attempts, last_error, status): a later success outdoes failures. Rows carry seq, their order."""
    good = valid_rows(success).groupBy("key").agg(F.count_if("is_valid").alias("n_valid"), F.count_if(~F.col("is_valid")).alias("n_malformed"))
    bad = failures.groupBy("key").agg(F.count(F.lit(1)).alias("attempts"), F.max_by("error", "seq").alias("last_error"))
    out = good.join(bad, "key", "full").fillna(0, ["n_valid", "n_malformed", "attempts"])
    return out.withColumn("status", F.when(F.col("n_valid") > 0, "successful").when(F.col("attempts") > 0, "failed").otherwise("malformed")).withColumn("is_duplicate", F.col("n_valid") > 1)


def latest(success: DataFrame) -> DataFrame:
    """The last valid record of each key."""
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy(F.desc("seq"))
    return valid_rows(success).where("is_valid").withColumn("k", F.row_number().over(w)).where("k = 1").drop("k", "is_valid")


def outstanding(expected: DataFrame, now: DataFrame, most_attempts: int = 3) -> DataFrame:
    done = now.where((F.col("status") == "successful") | (F.col("attempts") >= most_attempts)).select("key")
    return expected.join(done, "key", "left_anti")


def classify(expected: DataFrame, now: DataFrame, most_attempts: int = 3) -> DataFrame:
    rows = expected.select("key").join(now, "key", "left")
    out = rows.agg(
        F.count(F.lit(1)).alias("n_expected"), F.count_if(F.col("status") == "successful").alias("n_successful"),
        F.count_if(F.coalesce(F.col("status") != "successful", F.lit(False)) & (F.col("attempts") >= most_attempts)).alias("n_exhausted"), F.count_if(F.coalesce("n_valid", F.lit(0)) > 1).alias("n_duplicate"),
    )
    said = F.when(F.col("n_successful") == F.col("n_expected"), "COMPLETE").when(F.col("n_exhausted") > 0, "FAILED").otherwise("PARTIAL")
    return out.withColumn("run_status", said)


def identity(**fields) -> str:
    """SHA-256 of the canonical JSON of a run's settings; lists of names don't depend on their order."""
    plain = {k: sorted(v) if isinstance(v, (list, tuple, set)) else v for k, v in fields.items()}
    return hashlib.sha256(json.dumps(plain, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def guard_manifest(path: str, **fields) -> str:
    """Writes the manifest once; another run's is an error and stays as it is."""
    p, own = Path(path), identity(**fields)
    if p.exists():
        if json.loads(p.read_text())["identity"] != own:
            raise ManifestMismatch(path)
    else:
        p.write_text(json.dumps({"identity": own} | {k: sorted(v) if isinstance(v, (list, tuple, set)) else v for k, v in fields.items()}, sort_keys=True))
    return own


def signature(ids: list[str], config: dict, inputs: dict[str, str]) -> dict[str, str]:
    h = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True).encode()).hexdigest()
    return {"ids": h(sorted(ids)), "n": str(len(ids)), "config": h(config), "inputs": h(inputs), "version": "1"}


def cached(spark, folder: str, sign: dict[str, str], columns: list[str], n_rows: int, compute) -> DataFrame:
    """A method's predictions as Parquet beside their signature; used again only if everything agrees."""
    side = Path(folder) / "signature.json"
    data = str(Path(folder) / "data")
    if side.exists() and json.loads(side.read_text()) == sign:
        old = spark.read.parquet(data)
        if set(columns) <= set(old.columns) and old.count() == n_rows and old.dropDuplicates(["gap_id", "date"]).count() == n_rows:
            return old
    Path(folder).mkdir(parents=True, exist_ok=True)
    side.unlink(missing_ok=True)
    compute().write.mode("overwrite").parquet(data)
    side.write_text(json.dumps(sign))
    return spark.read.parquet(data)
