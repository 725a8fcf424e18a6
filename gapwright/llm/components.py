"""Connected components of an edge table, by large-star and small-star steps on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0)).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame, scratch: Scratch, name: str, most: int = 60) -> DataFrame:
    """(node, component): every node of an edge with the least node that it is linked to.

    edges: (a, b), any direction, repeats allowed. Each round is written to the shared folder. A node's
    neighbours are never gathered: rounds use minima (combined before the shuffle) and equi-joins.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = scratch.save(e, f"{name}-0")
    was = _state(e)
    for k in range(1, most):
        if not was[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, both.a == least.n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select(F.col("a").alias("n"), "m")
        small = large.join(low, large.a == low.n).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("p")).select("p.*")
        e = scratch.save(small.where("a <> b").distinct(), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        now = _state(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components didn't settle in {most} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
