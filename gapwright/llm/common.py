"""Shared plumbing: input tables, the shared scratch folder, word hashing over Arrow buffers."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in pieces of about this many bytes, so numpy's temporaries stay small.
PIECE_BYTES = 1 << 21
#: Within a piece (one text can be longer) bytes are hashed in blocks of about this many.
BLOCK_BYTES = 1 << 21

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


class Scratch:
    """A folder of this call's own below spark.checkpoint.dir, for tables and files that cut lineage.

    The setting is read from the session. Where it is unset, a session in local mode (as in tests) gets a folder
    of its own, and any other is refused. Folders are removed when the interpreter ends, and single tables as soon
    as the caller drops them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not f"{spark.sparkContext.master}[".startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = _fallback()
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def mkdirs(self, name: str) -> str:
        fs, p = self._fs(self.path(name))
        fs.mkdirs(p)
        return self.path(name)

    def save(self, df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
        """Write df as Parquet and read it back: the lineage above is cut, and lost executors cost one stage.

        tidy: let Spark's cleaner drop the shuffle files of what is written now, instead of whenever the driver
        happens to collect its garbage.
        """
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        if tidy:
            self.tidy()
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def tidy(self) -> None:
        """Lets Spark's cleaner see that shuffles whose data frames are gone can go."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def keep(self, *names: str) -> None:
        """Drops every table but these."""
        fs, p = self._fs(self.root)
        for entry in fs.listStatus(p) if fs.exists(p) else []:
            if entry.getPath().getName() not in names:
                fs.delete(entry.getPath(), True)

    def drop(self, name: str = "") -> None:
        try:
            fs, p = self._fs(self.path(name) if name else self.root)
            fs.delete(p, True)
        except Exception:  # noqa: BLE001 - the JVM may have gone at exit
            pass


_LOCAL: list[str] = []


def _fallback() -> str:
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="gapwright-"))
    return "file://" + _LOCAL[0]


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def binary(column) -> pa.Array:
    """An Arrow string column as large_binary without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).fill_null(b"")


def pieces(column: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cuts a large_binary column between rows into (first row, bytes, row offsets) of about `size` bytes."""
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        hi = min(n, hi)
        yield lo, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


#: One random 64-bit value per byte, from the finaliser.
_BYTE = mix((np.arange(1, 257, dtype=np.uint64) * _ODD))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_P = 0xD6E8FEB86659FD93
_P_INV = pow(_P, -1, 1 << 64)
_POW: list[np.ndarray] = [_powers(1024, _P), _powers(1024, _P_INV)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size = 1 << (n - 1).bit_length()
        _POW[0], _POW[1] = _powers(size, _P), _powers(size, _P_INV)
    return _POW[0][:n], _POW[1][:n]


def words(raw: np.ndarray, off: np.ndarray, lower: bool, space: np.ndarray = _SPACE, parts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of rows that lie one behind the other in raw.

    Returns (64-bit hash, start byte, end byte) of each word and, for each row, the
    index of its first word (one more entry than rows). Words never cross rows.
    space: for each byte value, does it part words (ASCII white space by default); parts: the same for each byte of raw.
    """
    n = len(raw)
    if not n:
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e, np.zeros(len(off), np.int64)
    flag = np.zeros(n + 1, np.int8)
    np.logical_not(space[raw] if parts is None else parts, out=flag[:n].view(bool))
    step = np.empty(n + 1, np.int8)
    step[0] = flag[0]
    np.subtract(flag[1:], flag[:-1], out=step[1:])
    inner = off[(off > 0) & (off < n)]
    starts = step == 1
    ends = step == -1
    glued = inner[(flag[inner] == 1) & (flag[inner - 1] == 1)]
    starts[glued] = True
    ends[glued] = True
    s, e = np.flatnonzero(starts), np.flatnonzero(ends)
    h = np.empty(len(s), np.uint64)
    i = 0
    while i < len(s):  # some words at a time: the sums below take 40 bytes for each byte of text
        j = max(i + 1, int(np.searchsorted(e, s[i] + BLOCK_BYTES, "right")))
        a, b = int(s[i]), int(e[j - 1])
        up, down = _pow(b - a)
        own = raw[a:b]
        with np.errstate(over="ignore"):
            acc = np.empty(b - a + 1, np.uint64)
            acc[0] = 0
            np.cumsum(_BYTE[_LOWER[own] if lower else own] * up, out=acc[1:])
            h[i:j] = mix((acc[e[i:j] - a] - acc[s[i:j] - a]) * down[s[i:j] - a] + (e[i:j] - s[i:j]).astype(np.uint64) * _ODD)
        i = j
    return h, s, e, np.searchsorted(s, off)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words; entry i is for words i to i + k - 1 (rows are not looked at)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * _ODD + h[j : j + n]
    return mix(out)


def runs(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges half-open intervals that are sorted by lo; touching ones become one."""
    if not len(lo):
        return lo, hi
    top = np.maximum.accumulate(hi)
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > top[:-1]
    first = np.flatnonzero(new)
    return lo[first], top[np.append(first[1:] - 1, len(lo) - 1)]


def concat_ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, ... for n[0] numbers, then the next range."""
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    return first + np.arange(total)


def sizes_of(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
