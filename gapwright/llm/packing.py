"""Best-fit packing by large-item matching.

A sequence holds `capacity` tokens. Full pieces fill a sequence alone. Pieces above a third of
the capacity go at most two to a sequence: each, longest first, is matched with the longest other
large piece that still fits. Smaller pieces, longest first, then go to the smallest gap that holds them.

Lengths are integers up to the capacity, so the plan is made on the histogram of lengths: its
size is bounded by the capacity whatever the number of documents. Pieces of one length are
interchangeable; they find their place by their rank within the length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import Scratch, binary

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, key long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences from its end, the rest first."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int) -> DataFrame:
    """One row for each piece of every whole text; key spreads rows of a length, those of one (or no) doc_id too."""

    def run(batches):
        enc, tail, seen = bpe.encoder(tokenizer), int(end).to_bytes(4, "little"), 0
        for b in batches:
            texts = binary(b.column("text")).to_pylist()
            names = b.column("doc_id").to_pylist()
            for lo, hi in bpe.batches(texts):
                rows = []
                seen += hi - lo
                for doc, ids in zip(names[lo:hi], enc.encode(texts[lo:hi]), strict=True):
                    ids += tail
                    for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                        crc = zlib.crc32(ids[4 * s : 4 * (s + n)])
                        rows.append((doc, k, s, n, crc, zlib.crc32(b"%d:%d:%d:%d" % (doc or 0, k, crc, seen + len(rows))) & 0xFFFF))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32()] + [pa.int64()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "key"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, pieces, first sequence, offset): pieces of a length from that rank
    go to sequences that follow each other, all at that offset."""
    out: list[tuple[int, int, int, int, int]] = []
    left = {k: v for k, v in counts.items() if v and k > 0}
    taken = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap to [first sequence, sequences]
    sequences = 0

    def take(length: int, n: int, first: int, offset: int) -> None:
        out.append((length, taken[length], n, first, offset))
        taken[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]

    def leave(gap: int, first: int, n: int) -> None:
        if gap:
            gaps.setdefault(gap, []).append((first, n))

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        top = large[-1]
        mate = bisect_left(large, capacity - top + 1) - 1
        if mate < 0:
            n = left[top]
            take(top, n, sequences, 0)
            leave(capacity - top, sequences, n)
        else:
            low = large[mate]
            n = min(left[top], left[low]) if low != top else left[top] // 2
            if n:
                take(top, n, sequences, 0)
                take(low, n, sequences, top)
                leave(capacity - top - low, sequences, n)
            else:  # one of its length is left over: the next shorter one is its mate
                low = large[mate - 1] if mate else None
                n = 1
                take(top, 1, sequences, 0)
                if low is not None:
                    take(low, 1, sequences, top)
                leave(capacity - top - (low or 0), sequences, 1)
        sequences += n
        large = [k for k in large if k in left]

    order = sorted(gaps)
    for size in sorted((k for k in left), reverse=True):
        while size in left:
            at = bisect_left(order, size)
            if at == len(order):
                many = capacity // size
                full, rest = divmod(left[size], many)
                for n, each in ((full, many), (1 if rest else 0, rest)):
                    if n:
                        for k in range(each):
                            take(size, n, sequences, k * size)
                        gap = capacity - each * size
                        if gap and gap not in gaps:
                            insort(order, gap)
                        leave(gap, sequences, n)
                        sequences += n
                break
            gap = order[at]
            first, n = gaps[gap].pop()
            use = min(n, left[size])
            if use < n:
                gaps[gap].append((first + use, n - use))
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            take(size, use, first, capacity - gap)
            if gap > size:
                if gap - size not in gaps:
                    insort(order, gap - size)
                leave(gap - size, first, use)
    return out


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to rows with (length, key).

    The histogram (at most `capacity` rows) and the plan are on the driver; pieces never are.
    Ranks within a length are made per (length, key bucket), so no length lies in one task.
    """
    spark = pieces.sparkSession
    n = pieces.count()
    buckets = max(8, min(4096, -(-n // 20_000)))
    # A third of the rows may have one length: only that many rows, divided by the buckets, meet in a task.
    rows = pieces.withColumn("bucket", F.col("key") % buckets)
    cells = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    by_length = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(by_length), F.lit(0))).select("length", "bucket", "before")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    steps = plan(counts, capacity)
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = rows.withColumn("local", F.row_number().over(order) - 1).join(cells, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("local"))

    # The steps of a length, by first rank; a piece's step is found by binary search.
    table: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    by: dict[int, list[tuple[int, int, int, int, int]]] = {}
    for s in steps:
        by.setdefault(s[0], []).append(s)
    for length, own in by.items():
        own.sort(key=lambda s: s[1])
        table[length] = tuple(np.array([s[i] for s in own], np.int64) for i in (1, 3, 4))
    shared = spark.sparkContext.broadcast(table)

    def run(batches):
        for b in batches:
            length, rank = (b.column(x).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for v in np.unique(length):
                own = length == v
                first, sequence, offset = shared.value[int(v)]
                k = np.searchsorted(first, rank[own], "right") - 1
                seq[own] = sequence[k] + rank[own] - first[k]
                off[own] = offset[k]
            kept = [b.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, fields)


def pack(docs: DataFrame, tokenizer: str, end: int = 0, capacity: int = 2048) -> DataFrame:
    """Packs every document into sequences of at most `capacity` tokens.

    Null text: empty, which is the end id alone. Repeated rows are packed as often as they occur.
    A null doc_id stays null. An empty table gives no rows. Other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "op4")
    pieces = scratch.save(token_pieces(docs.select("doc_id", "text"), tokenizer, end, capacity), "pieces")
    return place(pieces, capacity)
