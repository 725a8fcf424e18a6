"""Arrays between tasks: rows of packed binary columns, one row for each bucket that a flush of a task fills.

A bucket's rows meet in one task and are worked on bucket by bucket, so a task holds one bucket at a time. What a
task sends on is pooled over its buckets, so it makes a row for each target and FLUSH entries, not one for each pair
of buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import concat_ranges, partitions

#: Buckets for each shuffle partition.
BUCKETS_EACH = 4
#: Entries that a task gathers before it sends them on.
FLUSH = 1_000_000


def buckets(df: DataFrame) -> int:
    return BUCKETS_EACH * partitions(df.sparkSession)


def coarse(df: DataFrame) -> int:
    """Buckets of what is small beside the input, as answers: one for each shuffle partition."""
    return partitions(df.sparkSession)


def schema_of(names: list[str]) -> str:
    return "bucket int, kind int, " + ", ".join(f"{n} binary" for n in names)


def packed(x: np.ndarray) -> bytes:
    """The array's bytes by significance: high bytes of small numbers lie together, where the shuffle's compression takes them."""
    if not len(x):
        return b""
    x = np.ascontiguousarray(x)
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes() if x.itemsize > 1 else x.tobytes()


def unpacked(b: bytes, kind: str) -> np.ndarray:
    if kind == CODED:
        return decoded(b) if b else np.zeros(0, np.uint64)
    t = np.dtype(kind)
    if t.itemsize == 1 or not b:
        return np.frombuffer(b, t)
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(t.itemsize, -1).T).view(t).reshape(-1)


def coded(x: np.ndarray) -> bytes:
    """Bytes as they are; 64-bit values that repeat as their distinct values, in order, and small numbers into these."""
    if x.itemsize == 1:
        return x.tobytes()
    values, place = np.unique(x, return_inverse=True)
    wide = "<u1" if len(values) <= 1 << 8 else "<u2" if len(values) <= 1 << 16 else "<u4"
    head = np.array([len(values), np.dtype(wide).itemsize], "<u4").tobytes()
    return head + packed(values) + packed(place.astype(wide))


def decoded(b: bytes) -> np.ndarray:
    """64-bit values that `coded` wrote."""
    n, wide = np.frombuffer(b, "<u4", 2).tolist()
    return unpacked(b[8 : 8 + 8 * n], "<u8")[unpacked(b[8 + 8 * n :], f"<u{wide}")]


#: Type name of a column that `ragged` wrote with 64-bit values.
CODED = "coded"


def blobs(bucket: np.ndarray, kind: int, names: list[str], **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each bucket; columns that aren't given stay empty."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    first = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    ends = np.append(first[1:], len(b))
    cols = [pa.array(b[first].astype(np.int32)), pa.array(np.full(len(first), kind, np.int32))]
    for n in names:
        if n in columns:
            x = np.ascontiguousarray(columns[n][order])
            cols.append(pa.array([packed(x[i:j]) for i, j in zip(first, ends, strict=True)], pa.binary()))
        else:
            cols.append(pa.array([b""] * len(first), pa.binary()))
    yield pa.RecordBatch.from_arrays(cols, ["bucket", "kind", *names])


def ragged(bucket: np.ndarray, kind: int, names: list[str], data: str, flat: np.ndarray, begin: np.ndarray, many: np.ndarray, /, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """As blobs, with a column `data` of which entry i has many[i] values from flat[begin[i]] on (see `coded`)."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    first, ends = by_key(b)
    cols = [pa.array(b[first].astype(np.int32)), pa.array(np.full(len(first), kind, np.int32))]
    for n in names:
        if n == data:
            cols.append(pa.array([coded(flat[concat_ranges(begin[order[i:j]], many[order[i:j]])]) for i, j in zip(first, ends, strict=True)], pa.binary()))
        elif n in columns:
            x = np.ascontiguousarray(columns[n][order])
            cols.append(pa.array([packed(x[i:j]) for i, j in zip(first, ends, strict=True)], pa.binary()))
        else:
            cols.append(pa.array([b""] * len(first), pa.binary()))
    yield pa.RecordBatch.from_arrays(cols, ["bucket", "kind", *names])


class Pool:
    """Entries for other tasks, kept until there are FLUSH of them."""

    def __init__(self, names: list[str]):
        self.names, self.held, self.size = names, {}, 0

    def add(self, bucket: np.ndarray, kind: int, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(bucket):
            self.held.setdefault(kind, []).append((bucket, columns))
            self.size += len(bucket)
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        held, self.held, self.size = self.held, {}, 0
        for kind, own in held.items():
            yield from blobs(np.concatenate([b for b, _ in own]), kind, self.names, **{n: np.concatenate([c[n] for _, c in own]) for n in own[0][1]})


def gather(df: DataFrame, types: dict[str, str], work: Callable, out: str, send: list[str] | None = None) -> DataFrame:
    """Brings each bucket's rows together and gives work(kind, arrays) for each of its kinds.

    work yields record batches of the schema `out`; with `send` it yields (bucket, kind, columns) for the next
    exchange instead, which are pooled over all buckets of the task.
    """

    def run(batches):
        now, held = None, {}
        pool = Pool(send or [])

        def flush():
            for kind in sorted(held):
                given = work(kind, {n: np.concatenate([unpacked(x, t) for x in held[kind][n]]) for n, t in types.items()})
                if send is None:
                    yield from given
                    continue
                for bucket, k, columns in given:
                    yield from pool.add(bucket, k, **columns)

        for b in batches:
            cols = {n: b.column(n) for n in types}
            for i, (bucket, kind) in enumerate(zip(b.column("bucket").to_pylist(), b.column("kind").to_pylist(), strict=True)):
                if bucket != now:
                    yield from flush()
                    now, held = bucket, {}
                own = held.setdefault(kind, {n: [] for n in types})
                for n in types:
                    own[n].append(cols[n][i].as_py())
        yield from flush()
        yield from pool.flush()

    n = partitions(df.sparkSession)  # buckets go round the partitions, so each has as many
    return df.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(run, out)


def by_key(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and end of each run of equal values in a sorted array."""
    if not len(t):
        e = np.zeros(0, np.int64)
        return e, e
    first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    return first, np.append(first[1:], len(t))
