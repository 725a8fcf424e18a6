"""Learned reconstructions: Kalman smoothers, Gaussian processes, linear models and tree ensembles.

Each fits in numpy inside a grouped pandas function; the parallel axis is the gap (or the series). A group is one
gap's context or training rows, which calendars and pools bound.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREDICTION = "series_id string, gap_id string, x int, prediction double, spread double"


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows by key over as many tasks as a shuffle has. Fits cost time, not bytes, and by bytes adaptive execution would put them in a few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


# --- local level ------------------------------------------------------------------------------------------


def kalman(y: np.ndarray, sigma_q: float, sigma_r: float) -> tuple[np.ndarray, np.ndarray]:
    """Local-level filter and backward smoother; missing days are predicted only, the first is never updated."""
    n = len(y)
    known = np.flatnonzero(~np.isnan(y))
    m, p, mp, pp = (np.zeros(n) for _ in range(4))
    m[0], p[0] = (y[known[0]] if len(known) else 0.0), sigma_r * 10
    for t in range(1, n):
        mp[t], pp[t] = m[t - 1], p[t - 1] + sigma_q**2
        if np.isnan(y[t]):
            m[t], p[t] = mp[t], pp[t]
        else:
            k = pp[t] / (pp[t] + sigma_r**2) if pp[t] + sigma_r**2 > 0 else 1.0
            m[t], p[t] = mp[t] + k * (y[t] - mp[t]), (1 - k) * pp[t]
    s, v = m.copy(), p.copy()
    for t in range(n - 2, -1, -1):
        g = p[t] / pp[t + 1] if pp[t + 1] > 0 else 0.0
        s[t] += g * (s[t + 1] - mp[t + 1])
        v[t] += g * g * (v[t + 1] - pp[t + 1])
    return s, np.sqrt(np.maximum(v, 0))


def log_likelihood(y: np.ndarray, sigma_q: float, sigma_r: float) -> float:
    """Of a local level that begins at the first known value, with the filter's first variance; every known day counts."""
    known = y[~np.isnan(y)]
    m, p, total = (known[0] if len(known) else 0.0), sigma_r * 10, 0.0
    for v in y:
        if v == v:
            s = p + sigma_r**2
            e = v - m
            total -= 0.5 * (np.log(2 * np.pi * s) + e * e / s)
            k = p / s
            m, p = m + k * e, (1 - k) * p
        p += sigma_q**2
    return float(total)


def nelder_mead(f: Callable, x0: np.ndarray, rounds: int = 500, tol: float = 1e-4) -> np.ndarray:
    pts = [np.array(x0, float)] + [np.array(x0, float) + np.eye(len(x0))[i] * (0.05 * x0[i] or 0.00025) for i in range(len(x0))]
    val = [f(p) for p in pts]
    for _ in range(rounds):
        o = np.argsort(val, kind="stable")
        pts, val = [pts[i] for i in o], [val[i] for i in o]
        if max(np.abs(np.array(pts[1:]) - pts[0]).max(), max(abs(v - val[0]) for v in val[1:])) <= tol:
            break
        mid = np.mean(pts[:-1], axis=0)
        r = mid + (mid - pts[-1])
        fr = f(r)
        if fr < val[0]:
            e = mid + 2 * (mid - pts[-1])
            fe = f(e)
            pts[-1], val[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < val[-2]:
            pts[-1], val[-1] = r, fr
        else:
            c = mid + 0.5 * ((r if fr < val[-1] else pts[-1]) - mid)
            fc = f(c)
            if fc < min(fr, val[-1]):
                pts[-1], val[-1] = c, fc
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                val = [val[0]] + [f(p) for p in pts[1:]]
    return pts[int(np.argmin(val))]


def fit_kalman(y: np.ndarray) -> tuple[float, float]:
    """(sigma_q, sigma_r) by maximum likelihood on the series without its missing days."""
    y = y[~np.isnan(y)]
    r = float(np.std(np.diff(y))) / np.sqrt(2) if len(y) > 2 else 0.3
    q, r = max(0.1 * r, 1e-5), max(r, 1e-4)
    if not len(y):
        return q, r
    best = nelder_mead(lambda p: -log_likelihood(y, np.exp(p[0]), np.exp(p[1])), np.log([q, r]))
    return float(np.exp(best[0])), float(np.exp(best[1]))


def kalman_parameters(daily: DataFrame) -> DataFrame:
    """Per series (y column): the parameters and whether the observation noise vanished."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, r = fit_kalman(pdf.sort_values("x")["y"].to_numpy(float))
        return pd.DataFrame({"series_id": [pdf["series_id"].iloc[0]], "sigma_q": [q], "sigma_r": [r], "degenerate": [r < 1e-10]})

    return daily.select("series_id", "x", "y").groupBy("series_id").applyInPandas(run, "series_id string, sigma_q double, sigma_r double, degenerate boolean")


def kalman_gaps(daily: DataFrame, pool: DataFrame, parameters: DataFrame) -> DataFrame:
    """Smoothed values of hidden days; each gap sees its whole series but for its own days."""
    rows = daily.join(pool.select("series_id", "gap_id", "start", "end"), "series_id").join(parameters, "series_id")
    a, b = F.unix_date("start"), F.unix_date("end")
    rows = rows.select("series_id", "gap_id", "x", F.when(~F.col("x").between(a, b), F.col("y")).alias("y"), F.col("x").between(a, b).alias("hidden"), "sigma_q", "sigma_r")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        s, v = kalman(pdf["y"].to_numpy(float), pdf["sigma_q"].iloc[0], pdf["sigma_r"].iloc[0])
        return pdf.assign(prediction=s, spread=v).loc[pdf["hidden"].to_numpy(), ["series_id", "gap_id", "x", "prediction", "spread"]]

    return spread(rows, "gap_id").groupBy("gap_id").applyInPandas(run, PREDICTION)


# --- Gaussian process -------------------------------------------------------------------------------------


def matern32(a: np.ndarray, b: np.ndarray, scale: np.ndarray) -> np.ndarray:
    d = np.sqrt((((a[:, None, :] - b[None, :, :]) / scale) ** 2).sum(-1)) * np.sqrt(3)
    return (1 + d) * np.exp(-d)


def gp_predict(x, y, z, amplitude, scale, noise, jitter=1e-6):
    """Mean and deviation at z, and the log marginal likelihood, of a centred and scaled y."""
    mean, std = y.mean(), y.std() or 1.0
    t = (y - mean) / std
    k = amplitude * matern32(x, x, scale) + (noise + jitter) * np.eye(len(x))
    low = np.linalg.cholesky(k)
    w = np.linalg.solve(low.T, np.linalg.solve(low, t))
    ks = amplitude * matern32(z, x, scale)
    v = np.linalg.solve(low, ks.T)
    var = amplitude + noise - (v**2).sum(0)
    like = -0.5 * t @ w - np.log(np.diag(low)).sum() - 0.5 * len(t) * np.log(2 * np.pi)
    return ks @ w * std + mean, np.sqrt(np.maximum(var, 0)) * std, like


def gp_fixed(x, y, z, scale: float = 10.0, noise: float = 0.05):
    """Fixed hyperparameters: unit amplitude, one length scale in days; y is only centred and scaled."""
    m, s, _ = gp_predict(x[:, None].astype(float), y, z[:, None].astype(float), 1.0, np.array([scale]), noise, jitter=1e-10)
    return m, s


def gp_fit(x: np.ndarray, y: np.ndarray, z: np.ndarray, seed: int = 42, restarts: int = 3):
    """Amplitude, a length scale per input and noise by likelihood, from several starts. None with under five points."""
    if len(y) < 5:
        return None
    fill = np.nanmedian(x, axis=0)
    fill = np.where(np.isnan(fill), 0.0, fill)
    x, z = np.where(np.isnan(x), fill, x), np.where(np.isnan(z), fill, z)
    mean, std = x.mean(0), x.std(0)
    std[std == 0] = 1
    x, z = (x - mean) / std, (z - mean) / std
    rng = np.random.default_rng(seed)
    d = x.shape[1]

    # Bounds and first starts of amplitude, length scales (the first one's is wide) and noise.
    low, high = np.log(np.array([1e-3, *[0.1] * d, 1e-5])), np.log(np.array([10.0, *[1e3] * d, 1.0]))
    first = np.log(np.array([1.0, 10.0, *[1.0] * (d - 1), 0.1]))

    def cost(p):
        p = np.clip(p, low, high)
        try:
            return -gp_predict(x, y, x[:1], np.exp(p[0]), np.exp(p[1 : 1 + d]), np.exp(p[-1]))[2]
        except np.linalg.LinAlgError:
            return 1e12

    starts = [first] + [rng.uniform(low, high) for _ in range(restarts)]
    best = min((nelder_mead(cost, s + 1e-3, 200) for s in starts), key=cost)
    best = np.clip(best, low, high)
    try:
        m, s, _ = gp_predict(x, y, z, np.exp(best[0]), np.exp(best[1 : 1 + d]), np.exp(best[-1]))
    except np.linalg.LinAlgError:
        return None
    return m, s


def gp_gaps(daily: DataFrame, pool: DataFrame, fixed: bool = True, reach: int = 30) -> DataFrame:
    """Hidden days from known ones within reach days. The gap's own days never enter: they are split off first."""
    a, b = F.unix_date("start"), F.unix_date("end")
    near = pool.select("series_id", "gap_id", "gap_length", "start", "end", F.explode(F.sequence(a - reach, b + reach)).alias("x"))
    rows = daily.join(near, ["series_id", "x"])
    hidden = F.col("x").between(a, b)
    rows = rows.withColumn("hidden", hidden).withColumn("y", F.when(~hidden, F.col("y")))
    angle = 2 * np.pi * F.dayofyear("date") / 365.25
    half = F.col("gap_length") / 2.0
    rel = F.floor(F.col("x") - (a + half)) / F.greatest(half, F.lit(1.0))
    rows = rows.select("series_id", "gap_id", "x", "y", "hidden", rel.alias("rel"), F.sin(angle).alias("s"), F.cos(angle).alias("c"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        hid = pdf["hidden"].to_numpy()
        obs = pdf[~hid & pdf["y"].notna().to_numpy()]
        out = pdf.loc[hid, ["series_id", "gap_id", "x"]].assign(prediction=np.nan, spread=np.nan)
        assert not obs["hidden"].any()
        if len(obs) >= 5 and len(out):
            if fixed:
                got = gp_fixed(obs["x"].to_numpy(float), obs["y"].to_numpy(float), out["x"].to_numpy(float))
            else:
                f = ["rel", "s", "c"]
                got = gp_fit(obs[f].to_numpy(float), obs["y"].to_numpy(float), pdf.loc[hid, f].to_numpy(float))
            if got is not None:
                out["prediction"], out["spread"] = got
        return out

    return spread(rows, "gap_id").groupBy("gap_id").applyInPandas(run, PREDICTION)


def interval(mean, spread, z: float = 1.645):
    """q05 and q95 on the value's scale, from a mean and deviation of logarithms."""
    return F.pow(F.lit(10.0), mean - z * spread), F.pow(F.lit(10.0), mean + z * spread)


# --- regressors -------------------------------------------------------------------------------------------


def impute(train: np.ndarray, test: np.ndarray, how: Callable = np.nanmean) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(all="ignore"):
        import warnings

        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            fill = how(train, axis=0)
    fill = np.where(np.isnan(fill), 0.0, fill)
    return np.where(np.isnan(train), fill, train), np.where(np.isnan(test), fill, test)


def ridge(x, y, z, alpha: float = 1.0):
    mx, my = x.mean(0), y.mean()
    w = np.linalg.solve((x - mx).T @ (x - mx) + alpha * np.eye(x.shape[1]), (x - mx).T @ (y - my))
    return (z - mx) @ w + my


def elastic_net(x, y, z, alpha: float = 0.05, ratio: float = 0.5, rounds: int = 500):
    mx, my = x.mean(0), y.mean()
    xc, r = x - mx, y - my
    n, w, sq = len(y), np.zeros(x.shape[1]), ((x - mx) ** 2).sum(0) / len(y)
    for _ in range(rounds):
        most = 0.0
        for j in range(len(w)):
            if sq[j] == 0:
                continue
            rho = xc[:, j] @ r / n + sq[j] * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha * ratio, 0) / (sq[j] + alpha * (1 - ratio))
            if new != w[j]:
                r -= xc[:, j] * (new - w[j])
                most = max(most, abs(new - w[j]))
                w[j] = new
        if most < 1e-6:
            break
    return (z - mx) @ w + my


def _tree(x, y, z, rows, cols, rng, least: int, random_cut: bool, out, weight, k):
    if len(rows) < 2 * least or len(cols) == 0 or np.ptp(y[rows]) == 0:
        out[cols] += weight * y[rows].mean()
        return
    best = None
    for j in rng.permutation(x.shape[1])[:k]:
        v = x[rows, j]
        lo, hi = v.min(), v.max()
        if lo == hi:
            continue
        cuts = [rng.uniform(lo, hi)] if random_cut else np.unique(np.quantile(v, np.linspace(0.1, 0.9, 9)))
        for c in cuts:
            left = v <= c
            n = left.sum()
            if least <= n <= len(rows) - least:
                gain = y[rows][left].sum() ** 2 / n + y[rows][~left].sum() ** 2 / (len(rows) - n)
                if best is None or gain > best[0]:
                    best = (gain, j, c)
    if best is None:
        out[cols] += weight * y[rows].mean()
        return
    _, j, c = best
    side, zs = x[rows, j] <= c, z[cols, j] <= c
    _tree(x, y, z, rows[side], cols[zs], rng, least, random_cut, out, weight, k)
    _tree(x, y, z, rows[~side], cols[~zs], rng, least, random_cut, out, weight, k)


def extra_trees(x, y, z, trees: int = 500, least: int = 1, seed: int = 42, together: int = 20):
    """Random cuts of every column, all rows for each tree. Trees grow level by level, some together, in numpy."""
    rng, out = np.random.default_rng(seed), np.zeros(len(z))
    for lo in range(0, trees, together):
        out += _level_trees(x, y, z, min(together, trees - lo), least, rng)
    return out / trees


def _level_trees(x, y, z, c, least, rng):
    """Sum of c trees' predictions for z. A node is (tree, path); rows lie sorted by node."""
    n, f = x.shape
    rows, node = np.tile(np.arange(n), c), np.repeat(np.arange(c), n)
    cols, at = np.tile(np.arange(len(z)), c), np.repeat(np.arange(c), len(z))
    out = np.zeros(len(z))
    while len(rows):
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        size = np.diff(np.append(first, len(rows)))
        own, t = x[rows], y[rows]
        total = np.add.reduceat(t, first)
        same = np.maximum.reduceat(t, first) == np.minimum.reduceat(t, first)
        lo, hi = np.minimum.reduceat(own, first), np.maximum.reduceat(own, first)
        cut = lo + (hi - lo) * rng.random(lo.shape)
        place = np.repeat(np.arange(len(first)), size)
        left = own <= cut[place]
        nl = np.add.reduceat(left, first, dtype=np.int64)
        sl = np.add.reduceat(left * t[:, None], first)
        nr = size[:, None] - nl
        ok = (nl >= least) & (nr >= least) & (lo < hi) & ~same[:, None] & (size[:, None] >= 2 * least)
        gain = np.where(ok, sl**2 / np.maximum(nl, 1) + (total[:, None] - sl) ** 2 / np.maximum(nr, 1), -np.inf)
        best = gain.argmax(1)
        split = ok[np.arange(len(first)), best]
        names = node[first]
        seat = np.searchsorted(names, at)
        done = ~split[seat]
        np.add.at(out, cols[done], (total / size)[seat[done]])
        cols, seat = cols[~done], seat[~done]
        edge = cut[np.arange(len(first)), best]
        at = 2 * (np.cumsum(split) - 1)[seat] + (z[cols, best[seat]] > edge[seat])
        keep = split[place]
        rows, place = rows[keep], place[keep]
        node = 2 * (np.cumsum(split) - 1)[place] + (x[rows, best[place]] > edge[place])
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]
    return out


def random_forest(x, y, z, trees: int = 100, least: int = 3, seed: int = 42):
    rng, out = np.random.default_rng(seed), np.zeros(len(z))
    for _ in range(trees):
        _tree(x, y, z, rng.integers(0, len(y), len(y)), np.arange(len(z)), rng, least, False, out, 1 / trees, x.shape[1])
    return out


def boosted(x, y, z, rounds: int = 100, rate: float = 0.1, least: int = 10, seed: int = 0):
    """Boosted shallow trees: each fits what the ones before left over."""
    rng = np.random.default_rng(seed)
    both = np.vstack([x, z])
    score = np.full(len(both), y.mean())
    for _ in range(rounds):
        step = np.zeros(len(both))
        _tree(x, y - score[: len(y)], both, np.arange(len(y)), np.arange(len(both)), rng, max(least, len(y) // 8), False, step, 1.0, x.shape[1])
        score += rate * step
    return score[len(y) :]


def _coded(m: np.ndarray, cuts: list[np.ndarray], missing: int) -> np.ndarray:
    return np.stack([np.where(np.isnan(m[:, j]), missing, np.searchsorted(c, m[:, j])) for j, c in enumerate(cuts)], axis=1)


def _cuts(v: np.ndarray, bins: int) -> np.ndarray:
    """Midpoints of a column's distinct values, or of its quantiles where there are more than bins."""
    v = np.unique(v[~np.isnan(v)])
    if len(v) > bins:
        return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1]))
    return (v[1:] + v[:-1]) / 2


def _best_split(codes, rest, width: int, least: int, l2: float):
    """(gain, column, last code to the left, do missing values go left) of one node, or None."""
    n, f = codes.shape
    if n < 2 * least:
        return None
    at = (codes + np.arange(f) * width).ravel()
    count = np.bincount(at, minlength=f * width).reshape(f, width)
    total = np.bincount(at, np.repeat(rest, f), f * width).reshape(f, width)
    whole, best = rest.sum(), None
    left, part = np.cumsum(count[:, :-1], axis=1), np.cumsum(total[:, :-1], axis=1)
    for lost_left in (False, True) if count[:, -1].any() else (False,):
        nl, sl = (left + count[:, -1:], part + total[:, -1:]) if lost_left else (left, part)
        nr = n - nl
        ok = (nl >= least) & (nr >= least)
        gain = np.where(ok, sl**2 / np.maximum(nl + l2, 1) + (whole - sl) ** 2 / np.maximum(nr + l2, 1), -np.inf)
        j, k = np.unravel_index(gain.argmax(), gain.shape)
        if ok[j, k] and (best is None or gain[j, k] > best[0]):
            best = gain[j, k], j, k, lost_left if count[j, -1] else bool(nl[j, k] >= nr[j, k])
    if best is None or (gain := best[0] - whole**2 / (n + l2)) <= 0:
        return None
    return gain, *best[1:]


def _best_first(codes, rest, others, width: int, leaves: int, least: int, l2: float):
    """One tree's values for the rows it is grown on and for others: the leaf that gains most is divided next."""
    near, far = np.zeros(len(codes)), np.zeros(len(others))
    queue, done, order = [], [], 0

    def put(rows, cols):
        nonlocal order
        order += 1
        split = _best_split(codes[rows], rest[rows], width, least, l2)
        if split is None:
            done.append((rows, cols))
        else:
            heapq.heappush(queue, (-split[0], order, rows, cols, split))

    put(np.arange(len(codes)), np.arange(len(others)))
    while queue and len(queue) + len(done) < leaves:
        _, _, rows, cols, (_, j, k, lost_left) = heapq.heappop(queue)
        a, b = ((m[i, j] <= k) | (lost_left & (m[i, j] == width - 1)) for m, i in ((codes, rows), (others, cols)))
        put(rows[a], cols[b])
        put(rows[~a], cols[~b])
    for rows, cols in [*done, *(q[2:4] for q in queue)]:
        near[rows] = far[cols] = rest[rows].sum() / (len(rows) + l2)
    return near, far


def hist_boosted(x, y, z, rounds: int = 1000, rate: float = 0.05, leaves: int = 31, leaf_rows: int = 20, l2: float = 0.0, share: float = 0.1, patience: int = 20, seed: int = 42, bins: int = 255):
    """Boosted best-first trees on binned columns (squared error). Missing values are a bin that goes to the better side.

    A share of the rows, drawn by seed, is held back: when none of the last `patience` rounds lowers its error, no more
    follow. A share of 0 runs all rounds.
    """
    held = np.zeros(len(y), bool)
    held[np.random.default_rng(seed).permutation(len(y))[: int(np.ceil(share * len(y)))]] = share > 0
    cuts = [_cuts(x[~held, j], bins) for j in range(x.shape[1])]
    missing = max((len(c) for c in cuts), default=0) + 1
    codes, others = _coded(x[~held], cuts, missing), _coded(np.vstack([x[held], z]), cuts, missing)
    own, aside, n = y[~held], y[held], int(held.sum())
    near, far = np.full(len(own), own.mean()), np.full(len(others), own.mean())
    errors = [((aside - far[:n]) ** 2).mean() if n else 0.0]
    for _ in range(rounds):
        a, b = _best_first(codes, own - near, others, missing + 1, leaves, leaf_rows, l2)
        near, far = near + rate * a, far + rate * b
        if n:
            errors.append(((aside - far[:n]) ** 2).mean())
            if len(errors) > patience and min(errors[-patience:]) >= errors[-patience - 1] - 1e-7:
                break
    return far[n:]


LEARNERS: dict[str, Callable] = {
    "ridge": ridge, "elastic_net": elastic_net, "extra_trees": extra_trees, "random_forest": random_forest, "boosted": boosted, "hist_boosted": hist_boosted,
}
#: What stands for a missing feature; learners that take missing values as they are get them so by default.
FILLS: dict[str, Callable] = {"mean": np.nanmean, "median": np.nanmedian}
TAKES_MISSING = ("hist_boosted",)


def learner(name: str) -> Callable:
    if name not in LEARNERS:
        raise ValueError(f"unknown learner {name!r}")
    return LEARNERS[name]


def leave_one_gap_out(table: DataFrame, admitted: DataFrame, features: list[str], target: str, name: str, anchor: str | None = None, least: int = 30, fill: str | None = None, **options) -> DataFrame:
    """Predictions of every gap's days by a model that its admissible rows train.

    table: (series_id, gap_id, x, features, target); admitted: (held_out, the same columns) of training rows. The two
    meet by gap: one group holds one gap's training rows. Too few training rows: NULLs; fit_warnings() tells which.
    fill: "mean" or "median" of the training rows for missing features; None: the mean, or nothing where the learner
    takes missing values.
    """
    fit = learner(name)
    if fill is not None and fill not in FILLS:
        raise ValueError(f"unknown fill {fill!r}")
    how = FILLS[fill or "mean"] if fill or name not in TAKES_MISSING else None
    cols = ["series_id", "gap_id", "x", *features, target, *([anchor] if anchor and anchor not in features else [])]
    train = admitted.select("held_out", *[c for c in cols if c not in ("series_id", "gap_id")])
    test = table.select(F.col("gap_id").alias("held_out"), *[F.col(c).alias(c) for c in cols])  # own names: both sides may share lineage

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = b[["series_id", "gap_id", "x"]].assign(prediction=np.nan, spread=np.nan)
        a = a[a[target].notna()].sort_values(["x", *features[:1]], kind="stable")
        if len(a) >= least and len(b):
            x, z = a[features].to_numpy(float), b[features].to_numpy(float)
            x, z = impute(x, z, how) if how else (x, z)
            p = fit(x, a[target].to_numpy(float), z, **options)
            out["prediction"] = p + (b[anchor].to_numpy(float) if anchor else 0.0)
        return out

    return spread(train, "held_out").groupBy("held_out").cogroup(spread(test, "held_out").groupBy("held_out")).applyInPandas(run, PREDICTION)


def fit_warnings(pool: DataFrame, table: DataFrame, admitted: DataFrame, target: str, least: int = 30) -> DataFrame:
    """(gap_id, n_days, n_train, warning) of the gaps that leave_one_gap_out() can't predict, and why."""
    days = table.groupBy("gap_id").agg(F.count(F.lit(1)).alias("n_days"))
    train = admitted.where(F.col(target).isNotNull()).groupBy(F.col("held_out").alias("gap_id")).agg(F.count(F.lit(1)).alias("n_train"))
    out = pool.select("gap_id").join(days, "gap_id", "left").join(train, "gap_id", "left").fillna(0, ["n_days", "n_train"])
    said = F.when(F.col("n_days") == 0, "no days to predict").when(F.col("n_train") < least, "too few training rows")
    return out.withColumn("warning", said).where("warning is not null")


def external_rows(daily: DataFrame, features: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(test days, training days) for models on a day's features alone: every eligible day outside the hidden window trains."""
    rows = daily.join(features.drop("x"), "date")
    test = rows.join(pool.select("series_id", "gap_id", "start", "end"), "series_id").where(F.col("date").between(F.col("start"), F.col("end"))).drop("start", "end")
    train = rows.where(F.col("eligible") & F.col("y").isNotNull()).join(pool.select("series_id", F.col("gap_id").alias("held_out"), "start", "end"), "series_id")
    return test, train.where(~F.col("date").between(F.col("start"), F.col("end"))).drop("start", "end")


def ridge_outside(daily: DataFrame, features: DataFrame, pool: DataFrame, columns: list[str], alpha: float = 1.0, least: int = 10) -> DataFrame:
    """Ridge on a day's features for every gap, trained by all eligible days outside it: as leave_one_gap_out() on
    external_rows() with "ridge", but from moments.

    The series' sums of products less the gap's own are the moments of a gap's training days, so no day is repeated for a
    gap; sums are of values centred on the series' means. Missing features count as their mean. Too few days: NULL.
    """
    k = len(columns)
    days = daily.join(features.drop("x"), "date")
    train = days.where(F.col("eligible") & F.col("y").isNotNull())
    mid = train.groupBy("series_id").agg(F.avg("y").alias("cy"), *[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(f"c{i}") for i, c in enumerate(columns)])
    own = [(F.nanvl(F.col(c).cast("double"), F.lit(None)) - F.coalesce(f"c{i}", F.lit(0.0))).alias(f"v{i}") for i, c in enumerate(columns)]
    centred = lambda rows, *more: rows.join(mid, "series_id").select("series_id", "x", *more, (F.col("y") - F.col("cy")).alias("vy"), "cy", *own, *[f"c{i}" for i in range(k)])

    def moments() -> F.Column:
        y, v = F.col("vy"), [F.col(f"v{i}") for i in range(k)]
        sums = [F.lit(1.0), y]
        for i in range(k):
            known = v[i].isNotNull().cast("double")
            sums += [known, v[i], known * y, v[i] * y]
        for i in range(k):
            for j in range(i, k):
                both = (v[i].isNotNull() & v[j].isNotNull()).cast("double")
                sums += [both, both * v[i], both * v[j], v[i] * v[j]]
        return F.array(*[F.coalesce(F.sum(s), F.lit(0.0)) for s in sums])

    a, b = F.unix_date("start"), F.unix_date("end")
    hidden = pool.select("series_id", "gap_id", F.explode(F.sequence(a, b)).alias("x"))
    whole = centred(train).groupBy("series_id").agg(moments().alias("whole"))
    part = centred(train).join(hidden, ["series_id", "x"]).groupBy("gap_id").agg(moments().alias("part"))

    @F.pandas_udf("weights array<double>, means array<double>, level double")
    def solve(all_days: pd.Series) -> pd.DataFrame:
        out = []
        for m in all_days:
            n, sy = m[0], m[1]
            if n < max(least, 1):
                out.append((None, None, None))
                continue
            level = sy / n
            one = np.reshape(m[2 : 2 + 4 * k], (k, 4))
            mean = np.where(one[:, 0] > 0, one[:, 1] / np.maximum(one[:, 0], 1), 0.0)
            with_y = one[:, 3] - mean * one[:, 2] - level * one[:, 1] + level * mean * one[:, 0]
            two, at = np.zeros((k, k)), 2 + 4 * k
            for i in range(k):
                for j in range(i, k):
                    c, u, v, q = m[at : at + 4]
                    two[i, j] = two[j, i] = q - mean[i] * v - mean[j] * u + mean[i] * mean[j] * c
                    at += 4
            out.append((np.linalg.solve(two + alpha * np.eye(k), with_y).tolist(), mean.tolist(), level))
        return pd.DataFrame(out, columns=["weights", "means", "level"])

    left = F.when(F.col("part").isNull(), F.col("whole")).otherwise(F.zip_with("whole", "part", lambda p, q: p - q))
    fits = pool.select("series_id", "gap_id").join(whole, "series_id").join(part, "gap_id", "left").select("gap_id", solve(left).alias("fit"))
    test = centred(days).join(hidden, ["series_id", "x"]).join(fits, "gap_id")
    value = F.col("fit.level") + F.col("cy")
    for i in range(k):
        value = value + F.col("fit.weights")[i] * F.coalesce(F.col(f"v{i}") - F.col("fit.means")[i], F.lit(0.0))
    return test.select("series_id", "gap_id", "x", value.alias("prediction"), F.lit(None).cast("double").alias("spread"))


def hybrid(routed: DataFrame, predictions: dict[str, DataFrame]) -> DataFrame:
    """Each gap's predictions by the method it is routed to: (gap_id, x, prediction, method)."""
    out = None
    for name, rows in predictions.items():
        own = rows.join(routed.where(F.col("method") == name).select("gap_id"), "gap_id", "left_semi").withColumn("method", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out
