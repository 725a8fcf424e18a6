"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

Everything is a DataFrame or SQL expression. A sketch is a histogram over geometric buckets: two
sketches merge by adding counts, and a quantile read from one is within `gamma` of the true value.
The sketch of a (lang, source) is blended with the sketch that all groups merge into, which weighs PRIOR documents, so
a group's own shape counts the more the larger it is, by one rule for all sizes. Fences of each statistic are read
from the blend, relative to the group's median and outer deciles, and joined to the documents.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Statistic to (SQL expression, least distance of a fence from the median, is there a lower fence). The least distance
#: acts where nearly all documents of a group have one value, as no symbols at all.
METRICS = {
    "word_length": ("word_chars / n_words", 0.5, True),
    "symbol_share": ("n_symbols / word_chars", 0.02, False),
    "dup_line_share": ("n_dup_lines / n_words", 0.015, False),
    "repeat_share": ("n_repeat_words / n_words", 0.1, False),
}
GAMMA = 1.02
#: Fence: a decile and this many distances between decile and median beyond it.
REACH = 2.0
#: Documents that the merged sketch weighs in each group's blend.
PRIOR = 100

_WHITE = "\\t\\n\\u000b\\u000c\\r"


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """Base counts of whole texts (null: none). Words are `[^\\x20\\x09-\\x0D]+`.

    Word windows are sorted by (64-bit hash, place), so equal ones are neighbours, and neighbours of one hash are
    compared word by word. Texts of any length are treated alike.
    """
    d = docs.select(*keep, F.expr("coalesce(text, '')").alias("text"))
    d = d.withColumn("flat", F.expr(f"translate(text, '{_WHITE}', '     ')"))
    d = d.withColumn("words", F.expr("array_remove(split(flat, ' ', -1), '')"))
    d = d.withColumn("lines", F.expr(r"filter(split(text, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    d = d.select(
        *keep, "words",
        F.expr("cast(size(words) as bigint)").alias("n_words"),
        F.expr("cast(char_length(replace(flat, ' ', '')) as bigint)").alias("word_chars"),
        F.expr("cast(char_length(text) - char_length(translate(text, '#*$%&|<>', '')) as bigint)").alias("n_symbols"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as bigint)").alias("n_dup_lines"),
    )
    window = "struct(xxhash64(get(words, i), get(words, i + 1), get(words, i + 2)) as h, i as i)"
    d = d.withColumn("s", F.expr(f"if(n_words < 4, cast(array() as array<struct<h: bigint, i: int>>), sort_array(transform(sequence(0, cast(greatest(n_words, 3) - 3 as int)), i -> {window})))"))
    alike = " and ".join(f"get(words, x.i + {k}) = get(words, get(s, {{0}}).i + {k})" for k in range(3))
    same = " or ".join(f"(x.h = get(s, {j}).h and {alike.format(j)})" for j in ("j + 1", "j - 1"))
    d = d.withColumn("f", F.expr(f"sort_array(array_compact(transform(s, (x, j) -> case when {same} then x.i end)))")).drop("s", "words")
    return d.withColumn(
        "n_repeat_words", F.expr("aggregate(transform(f, (x, j) -> cast(least(3, x - coalesce(get(f, j - 1), -3)) as bigint)), 0L, (a, x) -> a + x)")
    ).drop("f")


def _metrics(stats: DataFrame) -> DataFrame:
    return stats.withColumns({k: F.expr(f"coalesce(try_divide(cast({e.split(' / ')[0]} as double), {e.split(' / ')[1]}), 0D)") for k, (e, _, _) in METRICS.items()})


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): bucket null holds zeros. Counts are combined before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("x")) for k in METRICS])
    rows = stats.select("lang", "source", F.explode(pairs).alias("p")).select("lang", "source", "p.*")
    bucket = F.when(F.col("x") > 0, F.ceil(F.log("x") / math.log(GAMMA)).cast("int"))
    return rows.groupBy("lang", "source", "metric", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, *by: str, shares: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """q0, q1, ... of each (by, metric), for shares in per mille steps: the upper end of the first bucket that reaches the rank.

    sketch: (by, metric, bucket, n) with whole weights n.
    """
    merged = sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").cast("decimal(38,0)").alias("n"))
    over = Window.partitionBy(*by, "metric")
    reached = merged.withColumn("reached", F.sum("n").over(over.orderBy(F.col("bucket").asc_nulls_first()))).withColumn("all", F.sum("n").over(over))
    value = F.coalesce(F.pow(F.lit(GAMMA), "bucket"), F.lit(0.0))
    q = lambda p: F.min(F.when(F.col("reached") * 1000 >= F.col("all") * round(1000 * p), value))
    return reached.groupBy(*by, "metric").agg(*[q(p).alias(f"q{k}") for k, p in enumerate(shares)])


def blended(sketch: DataFrame) -> DataFrame:
    """Each group's sketch with the merged one of all groups, which weighs PRIOR documents. Weights are whole numbers:
    own counts times the number of all documents, and the merged counts times PRIOR."""
    own = sketch.groupBy("lang", "source", "metric", "bucket").agg(F.sum("n").cast("decimal(38,0)").alias("n"))
    whole = sketch.groupBy("metric", "bucket").agg(F.sum("n").cast("decimal(38,0)").alias("n"))
    total = whole.groupBy("metric").agg(F.sum("n").alias("total"))
    weighed = own.join(total, "metric").select("lang", "source", "metric", "bucket", (F.col("n") * F.col("total")).cast("decimal(38,0)").alias("n"))
    groups = own.select("lang", "source", "metric").distinct()
    prior = groups.join(whole, "metric").select("lang", "source", "metric", "bucket", (F.col("n") * PRIOR).cast("decimal(38,0)").alias("n"))
    return weighed.unionByName(prior)


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source) with low_ and high_ of each metric."""
    both = quantiles(blended(sketch), "lang", "source")
    cols = []
    for k, (_, least, lower) in METRICS.items():
        mine = F.col("metric") == k
        high = F.greatest(F.col("q2") + REACH * (F.col("q2") - F.col("q1")), F.col("q1") + least)
        low = F.least(F.col("q0") - REACH * (F.col("q1") - F.col("q0")), F.col("q1") - least)
        cols.append(F.max(F.when(mine, high)).alias(f"high_{k}"))
        cols.append(F.max(F.when(mine, low if lower else F.lit(-1.0))).alias(f"low_{k}"))
    return both.groupBy("lang", "source").agg(*cols)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Base counts, base_failed and kept for each document (doc_id, text, lang, source).

    base_failed: fewer than 50 words, or over half of the words in repeated 3-word windows. kept: not
    base_failed, and every statistic within the fences of the document's language and source.
    Null or empty text: no words, base_failed. Null lang or source: groups of their own. Repeated rows stay. Empty
    table: no rows. Very long texts are judged whole.
    """
    scratch = Scratch(docs.sparkSession, "op8")
    stats = scratch.save(_metrics(statistics(docs, "doc_id", "lang", "source")), "stats")
    fences = thresholds(sketches(stats))
    fences = fences.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[c for c in fences.columns if c not in ("lang", "source")])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    within = F.lit(True)
    for k in METRICS:
        within &= F.col(k).between(F.col(f"low_{k}"), F.col(f"high_{k}"))
    joined = stats.join(fences, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.coalesce(within, F.lit(True))).alias("kept"),
    )
