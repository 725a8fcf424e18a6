"""Token-ID output as sorted-string-table shards.

Documents, keyed by identifier, lie in prefix-compressed blocks; a shard ends with a sparse
block index, a Bloom filter and a footer, so one document is found by binary search.

Shard layout (integers little-endian, `v` = unsigned LEB128):
  block*   zstd frame of entries: v(shared key bytes) v(other key bytes) v(first id) v(ids) key-rest ids
  index    one JSON object: blocks [[first key hex, offset, length]], bloom [offset, length, hashes],
           rows, tokens, first and last key
  footer   u64 index offset, u64 index length, u32 crc32 of the index, 8 bytes MAGIC
Ids are unsigned 32-bit in memory and 16-bit on disk where all of a shard's ids fit.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import Scratch, binary, mix, partitions

_FIRST = -(1 << 63)
MAGIC = b"GWSST\x00\x01\n"
BLOCK_BYTES = 1 << 17
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: A shard is closed beyond this many bytes of ids, so that any shard can be read back whole.
SHARD_BYTES = 16 << 20
MANIFEST = "shard long, sub long, part long, name string, rows long, tokens long"


def encode_key(doc_id: int | None) -> bytes:
    """Sorts as the ids do, null first."""
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def decode_key(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _v(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _unv(b: bytes, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[i]
        n |= (x & 127) << shift
        i += 1
        if x < 128:
            return n, i
        shift += 7


def _hashes(key: bytes, bits: int) -> list[int]:
    k = np.array([zlib.crc32(key), zlib.crc32(key, 0x5BD1E995)], dtype=np.uint64)
    a, b = (int(x) for x in mix(k + np.uint64(len(key))))
    return [(a + i * (b | 1)) % bits for i in range(BLOOM_HASHES)]


def narrow(ids: np.ndarray) -> tuple[bool, bytes]:
    """Are 32 bits needed, and the bytes: 16 bits an id where all fit."""
    wide = bool(len(ids)) and int(ids.max()) > 65535
    return wide, ids.astype("<u4" if wide else "<u2", copy=False).tobytes()


class ShardWriter:
    """Entries come in ascending key order; `bytes()` ends the shard."""

    def __init__(self) -> None:
        import zstandard

        self.zstd = zstandard.ZstdCompressor(level=1)
        self.out: list[bytes] = []
        self.size = self.tokens = self.rows = self.raw = 0
        self.blocks: list[list] = []
        self.block: list[bytes] = []
        self.block_size = 0
        self.keys: list[bytes] = []
        self.last = b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.keys and key < self.last:
            raise ValueError("keys must not descend")
        shared = 0 if not self.block else len(os.path.commonprefix([key, self.last]))
        if not self.block:
            self.blocks.append([key.hex(), self.size, 0])
        wide, body = narrow(ids)
        self.block += [_v(shared), _v(len(key) - shared), _v(self.tokens), _v(len(ids) * 2 + wide), key[shared:], body]
        self.block_size += len(body) + 12
        self.raw += len(body)
        self.keys.append(key)
        self.last = key
        self.rows += 1
        self.tokens += len(ids)
        if self.block_size >= BLOCK_BYTES:
            self._close()

    def _close(self) -> None:
        if self.block:
            frame = self.zstd.compress(b"".join(self.block))
            self.blocks[-1][2] = len(frame)
            self.out.append(frame)
            self.size += len(frame)
            self.block, self.block_size = [], 0

    def bytes(self) -> bytes:
        self._close()
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for k in set(self.keys):
            for x in _hashes(k, bits):
                bloom[x >> 3] |= 1 << (x & 7)
        index = {
            "blocks": self.blocks, "bloom": [self.size, len(bloom), bits], "rows": self.rows, "tokens": self.tokens,
            "first": self.keys[0].hex() if self.keys else "", "last": self.last.hex(),
        }
        text = json.dumps(index).encode()
        return b"".join([*self.out, bytes(bloom), text, struct.pack("<QQI", self.size + len(bloom), len(text), zlib.crc32(text)), MAGIC])


class Shard:
    """Reads one shard from its bytes."""

    def __init__(self, data: bytes):
        import zstandard

        if data[-8:] != MAGIC:
            raise ValueError("not a shard")
        at, n, crc = struct.unpack("<QQI", data[-28:-8])
        if zlib.crc32(data[at : at + n]) != crc:
            raise ValueError("the index is damaged")
        self.data, self.index = data, json.loads(data[at : at + n])
        self.first = [bytes.fromhex(b[0]) for b in self.index["blocks"]]
        self.zstd = zstandard.ZstdDecompressor()

    def _entries(self, block: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        _, at, n = self.index["blocks"][block]
        b, i, key = self.zstd.decompress(self.data[at : at + n]), 0, b""
        while i < len(b):
            shared, i = _unv(b, i)
            rest, i = _unv(b, i)
            start, i = _unv(b, i)
            count, i = _unv(b, i)
            key = key[:shared] + b[i : i + rest]
            i += rest
            wide, count = count & 1, count >> 1
            ids = np.frombuffer(b, "<u4" if wide else "<u2", count, i)
            i += count * (4 if wide else 2)
            yield key, start, ids.astype("<u4")

    def __iter__(self) -> Iterator[tuple[bytes, int, np.ndarray]]:
        for k in range(len(self.first)):
            yield from self._entries(k)

    def may_hold(self, key: bytes) -> bool:
        at, n, bits = self.index["bloom"]
        return all(self.data[at + (x >> 3)] >> (x & 7) & 1 for x in _hashes(key, bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every entry with this identifier (none if it is absent)."""
        key = encode_key(doc_id)
        if not self.first or not self.may_hold(key):
            return []
        k, found = max(0, bisect_right(self.first, key) - 1), []
        while k > 0 and self.first[k] == key:  # repeated keys can begin in an earlier block
            k -= 1
        while k < len(self.first) and self.first[k] <= key:
            found += [ids for x, _, ids in self._entries(k) if x == key]
            k += 1
        return found


def _put(folder: str, name: str, data: bytes) -> None:
    """Writes under a name of this attempt, then renames: a task that runs again replaces equal bytes."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    try:
        store.move(part, f"{path}/{name}")
    except OSError:  # some stores don't rename onto a file that an earlier attempt left
        store.delete_file(f"{path}/{name}")
        store.move(part, f"{path}/{name}")


def bounds(docs: DataFrame, rows_per_shard: int, most: int = 20_000) -> list[int]:
    """Identifiers that cut documents into shards of about rows_per_shard rows; at most 2 * `most` of them. One that
    several quantiles fall on is cut off from its neighbours, so that its rows are shards of their own."""
    n = docs.count()
    k = min(most, n // max(1, rows_per_shard))
    if k < 1:
        return []
    ids = docs.where("doc_id is not null")
    found = [int(x) for x in ids.approxQuantile("doc_id", [i / (k + 1) for i in range(1, k + 1)], min(0.01, 0.2 / (k + 1)))]
    hot = {a for a, b in zip(found, found[1:], strict=False) if a == b}
    return sorted({*found, *(x + 1 for x in hot if x < (1 << 63) - 1)})


def write(docs: DataFrame, folder: str, tokenizer: str, end: int, rows_per_shard: int = 4096) -> DataFrame:
    """Writes the shards and returns one row for each: (shard, sub, part, name, rows, tokens).

    Null identifiers are shard 0. Shards are dealt out in turn, so no task has more than its share of them; a shard of
    more than two shards' rows (one identifier's, see `bounds`) is dealt in subs, by a hash of its ids.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    where = np.array(bounds(docs.select("doc_id"), rows_per_shard), dtype=np.int64)

    def numbers(doc_ids):
        return np.where(doc_ids.is_null().to_numpy(zero_copy_only=False), 0, 1 + np.searchsorted(where, doc_ids.fill_null(_FIRST).to_numpy(zero_copy_only=False), "right"))

    def count(batches):
        for b in batches:
            v, n = np.unique(numbers(b.column("doc_id")), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)), pa.array(n.astype(np.int64))], ["shard", "n"])

    rows = docs.select("doc_id").mapInArrow(count, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n")).collect()  # one for each shard
    subs = np.ones(len(where) + 2, np.int64)
    for r in rows:
        if r["n"] > 2 * rows_per_shard and (r["shard"] == 0 or (r["shard"] >= 2 and r["shard"] <= len(where) - 1 and where[r["shard"] - 2] + 1 == where[r["shard"] - 1])):
            subs[r["shard"]] = -(-r["n"] // rows_per_shard)
    before = np.cumsum(subs) - subs
    n = int(max(1, min(subs.sum(), 8 * partitions(spark))))

    def tokenize(batches):
        enc, tail = bpe.encoder(tokenizer), struct.pack("<I", end)
        for b in batches:
            doc_ids = b.column("doc_id")
            shard = numbers(doc_ids)
            texts = binary(b.column("text")).to_pylist()
            for lo, hi in bpe.batches(texts):
                ids = [narrow(np.frombuffer(x + tail, "<u4")) for x in enc.encode(texts[lo:hi])]
                own = shard[lo:hi]
                # equal rows can go to one sub: they differ in nothing that is asked for later
                sub = np.array([zlib.crc32(x) for _, x in ids], np.int64) % subs[own]
                cols = [pa.array(((before[own] + sub) % n).astype(np.int32)), pa.array(own, pa.int64()), pa.array(sub), doc_ids[lo:hi], pa.array([w for w, _ in ids]), pa.array([x for _, x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["slot", "shard", "sub", "doc_id", "wide", "ids"])

    def run(batches):
        now, w, part = None, None, 0

        def close():
            name = f"shard-{now[0]:08d}-{now[1]:06d}-{part:04d}.sst"
            _put(folder, name, w.bytes())
            return pa.RecordBatch.from_pydict({"shard": [now[0]], "sub": [now[1]], "part": [part], "name": [name], "rows": [w.rows], "tokens": [w.tokens]})

        for b in batches:
            for shard, sub, doc_id, wide, ids in zip(*(b.column(x).to_pylist() for x in ("shard", "sub", "doc_id", "wide")), b.column("ids"), strict=True):
                if w is not None and ((shard, sub) != now or w.raw >= SHARD_BYTES):
                    yield close()
                    part, w = (part + 1 if (shard, sub) == now else 0), None
                if w is None:
                    now, w = (shard, sub), ShardWriter()
                w.add(encode_key(doc_id), np.frombuffer(ids.as_buffer(), "<u4" if wide else "<u2"))
        if w is not None:
            yield close()

    ids = docs.mapInArrow(tokenize, "slot int, shard long, sub long, doc_id long, wide boolean, ids binary")
    placed = ids.repartitionById(n, F.col("slot")).sortWithinPartitions("shard", "sub", "doc_id", "wide", "ids")
    return placed.mapInArrow(run, MANIFEST)


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Every document of the shards: (doc_id, start, n_tokens, ids_crc32). The manifest has a row for each shard."""
    from pyspark.sql import Window

    # Two levels: shards within a thousand, then thousands, so no task numbers all files.
    block = F.floor(F.col("shard") / 1000)
    inner = Window.partitionBy(block).orderBy("shard", "sub", "part").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = manifest.groupBy(block.alias("block")).agg(F.sum("tokens").alias("tokens")).select("block", F.coalesce(F.sum("tokens").over(outer), F.lit(0)).alias("ahead"))
    base = manifest.select(block.alias("block"), "name", F.coalesce(F.sum("tokens").over(inner), F.lit(0)).alias("own")).join(blocks, "block")
    base = base.select("name", (F.col("ahead") + F.col("own")).alias("base"))

    def run(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows = [(decode_key(k), s, len(i), zlib.crc32(i.tobytes())) for k, s, i in Shard(content.as_py())]
                ids, start, n, crc = ([list(x) for x in zip(*rows, strict=True)] if rows else [[], [], [], []])
                name = path.rsplit("/", 1)[-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(rows), pa.string()), *(pa.array(x, pa.int64()) for x in (ids, start, n, crc))],
                    ["name", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(folder).select("path", "content")
    rows = files.mapInArrow(run, "name string, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(base, "name").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", F.col("name").alias("shard"))


def token_shards(docs: DataFrame, tokenizer: str, end: int, folder: str | None = None, rows_per_shard: int = 4096) -> DataFrame:
    """Encodes documents, writes shards in ascending doc_id order, and reads them back.

    Null text: empty (the end id only). Null doc_id: first. Repeated doc_ids: all are kept, ordered
    by their ids within a sub of their shard. An empty table writes no shard and gives no rows. Other columns are not
    looked at. A shard is closed at SHARD_BYTES, so very long texts and many rows of one identifier make more files.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "op10")
    folder = folder or scratch.mkdirs("shards")
    schema = T.StructType.fromDDL(MANIFEST)
    manifest = scratch.save(write(docs.select("doc_id", "text"), folder, tokenizer, end, rows_per_shard), "manifest")
    if not manifest.take(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")
    return read(spark, folder, spark.read.schema(schema).parquet(scratch.path("manifest")))
