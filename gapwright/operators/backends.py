"""Pluggable sequence models: the call's contract, and a deterministic stand-in. No weights are shipped."""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import spread

#: Levels of a call's quantiles, and what part of the series a call sees (fixed values).
QUANTILES = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)
MODES = ("full_series", "local_window", "edge_balanced")


class BackendError(RuntimeError):
    """A backend isn't there or breaks its contract."""


class InputError(BackendError):
    """A call is asked for what the contract doesn't allow."""


class ProvenanceError(BackendError):
    """A backend was loaded, but it isn't the pinned one."""


class Backend(Protocol):
    name: str
    max_context: int

    def impute(self, series: np.ndarray, covariates: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Mean (T,) and quantiles (T, 7) of a series with NaN where it is masked. Covariates: None or (1, T, C), NaN allowed."""


@dataclass
class Stand:
    """Interpolates; the spread grows with the distance to the nearest known day."""

    name: str = "stand-in"
    max_context: int = 4096

    def impute(self, series, covariates):
        x, known = np.arange(len(series)), ~np.isnan(series)
        if not known.any():
            raise BackendError("nothing is known")
        mean = np.interp(x, x[known], series[known])
        far = np.abs(x[:, None] - x[known][None, :]).min(1)
        z = np.array([-1.645, -1.282, -0.674, 0.0, 0.674, 1.282, 1.645])
        return mean, mean[:, None] + 0.05 * np.sqrt(far)[:, None] * z


@dataclass
class LoadStatus:
    live: bool
    backend: Backend | None
    error: str | None = None


def load(make) -> LoadStatus:
    """Never raises."""
    try:
        return LoadStatus(True, make())
    except Exception as e:  # noqa: BLE001 - the status tells
        return LoadStatus(False, None, f"{type(e).__name__}: {e}")


@dataclass(frozen=True)
class Pin:
    """What a reproducible run may load. What is None isn't checked."""

    version: str | None = None
    revision: str | None = None
    sha256: str | None = None
    max_context: int | None = None


def provenance(backend: Backend, pin: Pin) -> dict:
    """Facts of a loaded backend, equal to the pin's, for a run's metadata; where its weights lie isn't one of them.

    version, revision and weights (a file) are attributes of the backend; one that is pinned and lacking is an error too.
    """
    if not isinstance(getattr(backend, "max_context", None), int):
        raise ProvenanceError("the backend doesn't tell its longest context")
    digest = None
    if weights := getattr(backend, "weights", None):
        try:
            with open(weights, "rb") as f:
                digest = hashlib.file_digest(f, "sha256").hexdigest()
        except OSError as e:
            raise ProvenanceError(f"the weights can't be read: {type(e).__name__}") from e
    facts = {"version": getattr(backend, "version", None), "revision": getattr(backend, "revision", None), "sha256": digest, "max_context": backend.max_context}
    for name, wanted in asdict(pin).items():
        if wanted is not None and facts[name] != wanted:
            raise ProvenanceError(f"{name} is {facts[name]!r}, not {wanted!r}")
    return {"name": getattr(backend, "name", None), **facts, "dtype": "float32"}


def require(make, pin: Pin | None = None) -> Backend:
    """The loaded backend, or an error; with a pin, the pinned one and no other."""
    status = load(make)
    if not status.live:
        raise BackendError(status.error)
    if pin is not None:
        provenance(status.backend, pin)
    return status.backend


def covariate_batch(block: np.ndarray | None) -> np.ndarray | None:
    """(T, C) to (1, T, C)."""
    if block is None:
        return None
    if block.ndim != 2:
        raise BackendError(f"covariates must have two dimensions, not {block.ndim}")
    return block.astype(np.float32)[None]


def checked(mean: np.ndarray, quantiles: np.ndarray, n: int) -> None:
    if mean.shape != (n,) or quantiles.shape != (n, len(QUANTILES)):
        raise BackendError(f"shapes {mean.shape} and {quantiles.shape}")
    if not (np.isfinite(mean).all() and np.isfinite(quantiles).all()):
        raise BackendError("values aren't finite")
    if (np.diff(quantiles, axis=1) < -1e-9).any():
        raise BackendError("quantiles fall")


CALL = "gap_id string, x int, prediction double, quantiles array<double>, error string, n_context int"


def context_days(daily: DataFrame, pool: DataFrame, mode: str, window: int, most: int) -> DataFrame:
    """Per gap the days lo to hi that its call sees: of the series' calendar, at most `most`, cut evenly but never into the gap."""
    if mode not in MODES:
        raise InputError(f"unknown mode {mode!r}")
    ends = daily.groupBy("series_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    out = pool.select("series_id", "gap_id", F.unix_date("start").alias("a"), F.unix_date("end").alias("b")).join(ends, "series_id")
    if mode != "full_series":
        out = out.withColumns({"lo": F.greatest("lo", F.col("a") - window // 2), "hi": F.least("hi", F.col("b") + window // 2)})
    extra = F.greatest(F.lit(0), F.col("hi") - F.col("lo") + 1 - most)
    left = F.least(F.greatest(F.floor(extra / 2), extra - F.greatest(F.lit(0), F.col("hi") - F.col("b"))), F.greatest(F.lit(0), F.col("a") - F.col("lo"))).cast("int")
    out = out.withColumn("left", left).withColumn("right", (extra - F.col("left")).cast("int"))
    return out.select("series_id", "gap_id", "a", "b", (F.col("lo") + F.col("left")).alias("lo"), (F.col("hi") - F.col("right")).alias("hi"))


def infer(daily: DataFrame, pool: DataFrame, backend: Backend, window: int = 180, strict: bool = True, mode: str = "local_window", covariates: tuple[str, ...] = ()) -> DataFrame:
    """Slice, mask, call and check, one gap at a time; a failure is a row with its error, other gaps go on.

    The gap's days are masked in the plan, before any model sees them, whatever the backend does. Covariates are columns
    of daily; their missing days reach the backend as NaN. A gap's rows are bounded by the backend's longest context.
    """
    if lost := [c for c in covariates if c not in daily.columns]:
        raise InputError(f"no such covariates: {lost}")
    names = [f"_covariate_{i}" for i in range(len(covariates))]
    near = context_days(daily, pool, mode, window, backend.max_context).select("series_id", "gap_id", "a", "b", F.explode(F.sequence("lo", "hi")).alias("x"))
    hidden = F.col("x").between(F.col("a"), F.col("b"))
    blocks = [F.col(c).cast("float").alias(n) for c, n in zip(covariates, names)]
    rows = daily.select("series_id", "x", "y", *blocks).join(near, ["series_id", "x"]).select("gap_id", "x", F.when(~hidden, F.col("y")).alias("y"), hidden.alias("hidden"), *names)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = pdf.sort_values("x")
        own = part["hidden"].to_numpy()
        out = part.loc[own, ["gap_id", "x"]].assign(n_context=len(part))
        try:
            block = covariate_batch(part[names].to_numpy(np.float32)) if names else None
            mean, q = backend.impute(part["y"].to_numpy(np.float32).astype(float), block)
            if strict:
                checked(mean, q, len(part))
            return out.assign(prediction=mean[own], quantiles=[list(map(float, r)) for r in q[own]], error=None)
        except Exception as e:  # noqa: BLE001 - recorded
            return out.assign(prediction=np.nan, quantiles=None, error=f"{type(e).__name__}: {e}")

    return spread(rows, "gap_id").groupBy("gap_id").applyInPandas(run, CALL)
