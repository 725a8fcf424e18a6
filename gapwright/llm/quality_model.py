"""Quality classifier: a sparse rule ensemble.

Statistics of whole texts are computed once. On a bounded sample of labelled rows small boosted
trees are grown; every path from a root to a node becomes a conjunctive rule; a lasso logistic
regression keeps few of them; and the kept rules are compiled into one Spark column expression,
which scores all documents in the JVM.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, binary

#: Labelled rows that the model is fitted on: at most this many, by the order of a hash of doc_id.
MAX_TRAIN = 12_000
STATS = (
    "n_words", "word_length", "longest_word", "distinct_share", "top_word_share", "same_next_share", "repeat3_share",
    "upper_share", "digit_share", "symbol_share", "bang_share", "bar_share", "stop_share", "comma_share", "line_words",
    "dup_line_share", "high_byte_share", "title_share", "short_share",
)
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = b"#*$%&<>@^~_=+\\/{}[]"


def text_stats(t: bytes) -> tuple[float, ...]:
    """Statistics of a UTF-8 text; all zero without words."""
    words = t.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATS)
    size = len(t)
    inked = sum(map(len, words))
    count = Counter(words)
    upper = size - len(t.translate(None, _UPPER))
    digits = size - len(t.translate(None, _DIGITS))
    symbols = size - len(t.translate(None, _SYMBOLS))
    same = sum(map(bytes.__eq__, words, words[1:]))
    threes = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = sum(v for v in threes.values() if v > 1)
    lines = [x for x in t.split(b"\n") if x.strip()]
    high = len(t.translate(None, bytes(range(128))))
    title = sum(map(bytes.istitle, words))
    short = sum(v for w, v in count.items() if len(w) <= 3)
    return (
        float(n), inked / n, float(max(map(len, count))), len(count) / n, max(count.values()) / n, same / n, repeated / n,
        upper / inked, digits / inked, symbols / inked, t.count(b"!") / inked, t.count(b"|") / n, t.count(b".") / n, t.count(b",") / n, n / max(1, len(lines)),
        (len(lines) - len(set(lines))) / max(1, len(lines)), high / inked, title / n, short / n,
    )


#: Statistics as columns: a prefix that no table of documents has.
_S = "_gapwright_s_"


def statistics(docs: DataFrame, whole: bool = False) -> DataFrame:
    """docs' columns with text replaced by the statistics of the whole text; whole: the text stays, too."""
    text = docs.columns.index("text")
    keep = [f for i, f in enumerate(docs.schema.fields) if whole or i != text]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in keep] + [T.StructField(_S + s, T.DoubleType(), True) for s in STATS])

    def run(batches):
        for b in batches:
            rows = np.array([text_stats(t.as_buffer().to_pybytes()) for t in binary(b.column(text))]).reshape(-1, len(STATS))
            cols = [c for i, c in enumerate(b.columns) if whole or i != text] + [pa.array(rows[:, j]) for j in range(len(STATS))]
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return docs.mapInArrow(run, schema)


def _edges(x: np.ndarray, bins: int = 24) -> list[np.ndarray]:
    """Cut points of each statistic, between quantiles of the sample; zero is one of them."""
    out = []
    for j in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
        out.append(np.unique(np.append(q, 0.0)))
    return out


class Trees:
    """Gradient boosting with shallow trees over binned statistics."""

    def __init__(self, depth: int = 3, trees: int = 24, rate: float = 0.4, least: int = 20):
        self.depth, self.trees, self.rate, self.least = depth, trees, rate, least

    def rules(self, x: np.ndarray, y: np.ndarray) -> list[tuple[tuple[int, float, bool], ...]]:
        """Paths to every node: conjunctions of (statistic, cut, is it above)."""
        edges = _edges(x)
        codes = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        base = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        score = np.full(len(y), math.log(base / (1 - base)))
        found: dict[tuple, None] = {}
        rng = np.random.default_rng(7)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            own = rng.choice(x.shape[1], max(4, x.shape[1] * 2 // 3), replace=False)
            self._grow(codes, edges, g, h, np.arange(len(y)), (), own, score, found)
        return list(found)

    def _grow(self, codes, edges, g, h, rows, path, own, score, found) -> None:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if len(path) < self.depth and len(rows) >= 2 * self.least:
            for j in own:
                k = len(edges[j]) + 1
                c = codes[rows, j]
                sg, sh, n = (np.cumsum(np.bincount(c, w, k))[:-1] for w in (g[rows], h[rows], None))
                ok = (n >= self.least) & (len(rows) - n >= self.least)
                if ok.any():
                    gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
                    gain[~ok] = -1
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (gain[i], (j, i))
        if best[1] is None:
            score[rows] += self.rate * total_g / (total_h + 1)
            return
        j, i = best[1]
        low = codes[rows, j] <= i
        for above, part in ((False, rows[low]), (True, rows[~low])):
            step = (*path, (int(j), float(edges[j][i]), above))
            found.setdefault(_simple(step))
            self._grow(codes, edges, g, h, part, step, own, score, found)


def _simple(path: tuple) -> tuple:
    """One bound per statistic and side."""
    tight: dict[tuple[int, bool], float] = {}
    for j, cut, above in path:
        old = tight.get((j, above))
        tight[j, above] = cut if old is None else (max if above else min)(old, cut)
    return tuple(sorted((j, c, a) for (j, a), c in tight.items()))


def holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, cut, above in rule:
        out &= x[:, j] > cut if above else x[:, j] <= cut
    return out


def lasso(m: np.ndarray, y: np.ndarray, penalty: float = 2e-3, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient steps."""
    n, k = m.shape
    scale = m.std(0) + 1e-6
    m = (m / scale).astype(np.float32)
    v = np.ones(k, np.float32)
    for _ in range(12):  # largest eigenvalue, for the step
        v = m.T @ (m @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (0.25 * float(np.linalg.norm(m @ v) ** 2) / n + 0.25 + 1e-6)
    w, b = np.zeros(k, np.float32), 0.0
    zw, zb, t = w, b, 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-np.clip(m @ zw + zb, -30, 30))) - y
        nw = zw - step * (m.T @ r / n).astype(np.float32)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = zb - step * float(r.mean())
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        zw, zb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return (w / scale).astype(float), float(b)


class RuleModel:
    """Kept rules with their weights."""

    def __init__(self, rules: list[tuple], weights: np.ndarray, bias: float):
        self.rules, self.weights, self.bias = rules, weights, bias

    def column(self) -> Column:
        """The score as one expression over the statistics' columns."""
        z = F.lit(float(self.bias))
        for rule, w in zip(self.rules, self.weights, strict=True):
            hit = F.lit(True)
            for j, cut, above in rule:
                c = F.col(_S + STATS[j])
                hit &= (c > cut) if above else (c <= cut)
            z = z + F.when(hit, F.lit(float(w))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-z))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.bias + sum((w * holds(r, x) for r, w in zip(self.rules, self.weights, strict=True)), np.zeros(len(x)))
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """With labels of one class only (or none), or too few rows for a rule, the model is a constant."""
    rules = Trees().rules(x, y) if len(y) and y.min() < y.max() else []
    m = np.stack([holds(r, x) for r in rules], 1).astype(np.float32) if rules else np.zeros((len(y), 0), np.float32)
    share = m.mean(0) if len(y) else np.zeros(0)
    own = np.flatnonzero((share > 0) & (share < 1))
    if not len(own):
        p = min(max(float(y.mean()) if len(y) else 1.0, 1e-3), 1 - 1e-3)
        return RuleModel([], np.zeros(0), math.log(p / (1 - p)))
    _, first = np.unique(np.packbits(m[:, own] > 0, axis=0), axis=1, return_index=True)  # rules that hold for the same rows count once
    own = own[np.sort(first)]
    w, b = lasso(m[:, own], y)
    kept = np.abs(w) > 1e-3
    return RuleModel([rules[i] for i in own[kept]], w[kept], b)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def train(stats: DataFrame, labels: DataFrame) -> RuleModel:
    """Fits on labelled rows that aren't held out; a document with several labels has their majority."""
    one = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_label_of")).agg((F.avg("quality") >= 0.5).cast("double").alias("_y"))
    rows = stats.select("doc_id", *[_S + s for s in STATS]).where(~held_out()).join(one, F.col("doc_id") == F.col("_label_of")).select("doc_id", "_y", *[_S + s for s in STATS])
    # Only about MAX_TRAIN rows pass before the limit, so tasks together send no more than that, however many they are.
    order = F.shiftrightunsigned(F.xxhash64("doc_id"), 44)
    share = min(1.0, 1.1 * MAX_TRAIN / max(1, rows.count()))
    rows = rows.where(order < int(share * (1 << 20))) if share < 1 else rows
    rows = rows.orderBy(order, "doc_id", _S + "n_words", _S + "word_length").limit(MAX_TRAIN).toPandas()
    return fit(rows[[_S + s for s in STATS]].to_numpy(float).reshape(-1, len(STATS)), rows["_y"].to_numpy(float))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document.

    Null or empty text: all statistics are 0, and the rules score that. A null doc_id counts as held
    out (it has no remainder). Repeated rows stay. An empty table gives no rows; without labels the score is constant.
    """
    scratch = Scratch(docs.sparkSession, "op2")
    stats = scratch.save(statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "stats")
    score = train(stats, labels).column()
    out = stats.select("doc_id", F.coalesce(held_out(), F.lit(True)).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs' rows and columns, without those that the classifier rejects.

    Statistics are computed once and kept beside the rows; the compiled rules judge every row. Null and empty texts
    have the score of a text without words; without labels all rows stay; repeated rows stay or go together; an empty
    table has no rows. Columns of any names are safe.
    """
    scratch = Scratch(docs.sparkSession, "op2")
    whole = scratch.save(statistics(docs, whole=True), "whole")
    model = train(whole.withColumn("doc_id", F.col("doc_id").cast("long")), labels)
    return whole.where(model.column() >= threshold).select(*docs.columns)
