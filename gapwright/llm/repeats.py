"""Repeated passages of byte strings (op5) and of word windows (op7).

Both run in the same three steps.

1. Anchors. Of every window of the fixed length, the k-gram with the least hash (leftmost on ties)
   is its anchor, so equal windows have equal anchors, and few places are anchors. Only anchors are
   exchanged; those that occur in one place only are done with.
2. Windows whose anchor repeats are compared in whole, by the operator's own method.
3. Marked places go back to their texts.

Equal whole texts (by two 64-bit hashes) are one text with a count: copies never meet as pairs.
Whatever a task sees more than once it settles itself and sends on once, so a passage that a third
of all documents share reaches any other task as often as there are tasks, not documents.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import Scratch, binary, concat_ranges, grams, mix, pieces, runs, words
from .common import _BYTE, _ODD, _pow
from .exchange import FLUSH

EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_LEAST = -(1 << 63)


def least_places(g: np.ndarray, w: int) -> np.ndarray:
    """Place of the least of every w values that follow each other, leftmost on ties (by all but the low bits)."""
    bits = np.uint64(max(1, int(len(g)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    cur = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        cur = np.minimum(cur[:-span], cur[span:])
        span *= 2
    if w > span:
        cur = np.minimum(cur[: -(w - span)], cur[w - span :])
    return (cur & low).astype(np.int64)


def anchor_runs(g: np.ndarray, first: np.ndarray, window: int, w: int) -> tuple[np.ndarray, ...]:
    """(row, place, first window, last window) of each anchor; rows' units are first[r] to first[r + 1]."""
    n = np.maximum(first[1:] - first[:-1] - window + 1, 0)
    if not n.sum():
        return (np.zeros(0, np.int64),) * 4
    starts = concat_ranges(first[:-1], n)
    rows = np.repeat(np.arange(len(n)), n)
    place = least_places(g, w)[starts]
    new = np.append(True, (place[1:] != place[:-1]) | (rows[1:] != rows[:-1]))
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(starts)) - 1
    return rows[at], place[at], starts[at], starts[last]


def byte_grams(raw: np.ndarray, k: int) -> np.ndarray:
    n = len(raw)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _pow(n)
    with np.errstate(over="ignore"):
        acc = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * up, out=acc[1:])
        return mix((acc[k:] - acc[: n - k + 1]) * down[: n - k + 1])


class Bytes:
    """200-byte windows, 32-byte anchors."""

    window, k, piece = 200, 32, 1 << 20

    def anchors(self, raw, off):
        """(codes, rows, places, first windows, last windows) of all anchors; long texts in overlapping parts."""
        size, found = 1 << 20, []
        for lo in range(0, max(1, len(raw) - self.window + 1), size):
            own = raw[lo : lo + size + self.window - 1]
            g = byte_grams(own, self.k)
            rows, place, w0, w1 = anchor_runs(g, np.clip(off - lo, 0, len(own)), self.window, self.window - self.k + 1) if len(own) >= self.window else (np.zeros(0, np.int64),) * 4
            found.append((g[place], rows, place + lo, w0 + lo, w1 + lo))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Words:
    """13-word windows, 5-word anchors. An anchor's code begins with 16 bits of its first word and 16 of its second, so
    sorted codes are sorted by these, and a range of codes is a set of word prefixes."""

    window, k, piece = 13, 5, 1 << 21

    def hashed(self, raw, off):
        h, _, _, first = words(raw, off, lower=False)
        g = grams(h, self.k)
        if not len(g):
            return h, first, (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 4)
        rows, place, w0, w1 = anchor_runs(g, first, self.window, self.window - self.k + 1)
        top = np.uint64(0xFFFF << 48)
        code = (h[place] & top) | ((h[place + 1] & top) >> np.uint64(16)) | (g[place] >> np.uint64(32))
        return h, first, (code, rows, place, w0, w1)

    def anchors(self, raw, off):
        return self.hashed(raw, off)[2]


def tid(t: bytes) -> int:
    n = xxhash.xxh64_intdigest(t, 42)
    return n - (1 << 64) if n >> 63 else n


def _to(t: np.ndarray, nb: int) -> np.ndarray:
    return (mix(t.view(np.uint64)) % np.uint64(nb)).astype(np.int64)


def repeated_anchors(docs: DataFrame, kind, alone: bool) -> DataFrame:
    """(tid, anchors): for each text, its anchors that another text has too (or, if alone, that it has twice)."""
    nb, few = exchange.buckets(docs), exchange.coarse(docs)
    names = ["h", "t"]

    def settle(h, t):
        """Sorted distinct (h, t); for each whether its h is settled as repeated."""
        order = np.lexsort((t, h))
        h, t = h[order], t[order]
        new = np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))
        at = np.flatnonzero(new)
        twice = np.diff(np.append(at, len(h))) > 1
        h, t = h[at], t[at]
        first, end = exchange.by_key(h)
        many = end - first > 1
        if alone:
            many |= np.logical_or.reduceat(twice, first)
        return h, t, first, np.repeat(many, end - first)

    def emit(batches):
        hs, ts, size = [], [], 0

        def flush():
            h, t, first, many = settle(np.concatenate(hs), np.concatenate(ts))
            yield from exchange.blobs(_to(t[many], few), 1, names, h=h[many], t=t[many])
            h, t = h[first], t[first]
            yield from exchange.blobs((mix(h) % np.uint64(nb)).astype(np.int64), 0, names, h=h, t=t)

        for b in batches:
            col = binary(b.column("text"))
            for lo, raw, off in pieces(col, kind.piece):
                code, rows, *_ = kind.anchors(raw, off)
                if len(code):
                    own = np.array([tid(raw[off[r] : off[r + 1]].tobytes()) for r in range(len(off) - 1)], np.int64)
                    hs.append(code)
                    ts.append(own[rows])
                    size += len(code)
                if size >= FLUSH:
                    yield from flush()
                    hs, ts, size = [], [], 0
        if size:
            yield from flush()

    def meet(k, x):
        h, t = x["h"], x["t"]
        if k == 0 and len(h):
            order = np.lexsort((t, h))
            h, t = h[order], t[order]
            new = np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))
            h, t = h[new], t[new]
            first, end = exchange.by_key(h)
            many = np.repeat(end - first > 1, end - first)
            h, t = h[many], t[many]
        yield _to(t, few), 0, {"h": h, "t": t}

    def collect(_, x):
        order = np.lexsort((x["h"], x["t"]))
        h, t = x["h"][order], x["t"][order]
        if len(h):
            new = np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))
            h, t = h[new], t[new]
            first, end = exchange.by_key(t)
            yield pa.RecordBatch.from_arrays([pa.array(t[first]), pa.array([h[i:j].tobytes() for i, j in zip(first, end, strict=True)], pa.binary())], ["tid", "anchors"])

    types = {"h": "<u8", "t": "<i8"}
    sent = docs.select("text").mapInArrow(emit, exchange.schema_of(names))
    met = exchange.gather(sent, types, meet, exchange.schema_of(names), names)
    return exchange.gather(met, types, collect, "tid long, anchors binary")


def known_anchors(rows: np.ndarray, code: np.ndarray, own: list[np.ndarray]) -> np.ndarray:
    """Is each anchor (row, code) among its row's repeated ones?"""
    hit = np.zeros(len(code), bool)
    cut = np.searchsorted(rows, np.arange(len(own) + 1))
    for r, known in enumerate(own):
        i, j = cut[r], cut[r + 1]
        if i < j:
            x = np.minimum(np.searchsorted(known, code[i:j]), len(known) - 1)
            hit[i:j] = known[x] == code[i:j]
    return hit


def marks(t: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marked ranges of texts, those that overlap or touch made one."""
    if not len(t):
        return t, lo, hi
    names, n = np.unique(t, return_inverse=True)
    order = np.lexsort((lo, n))
    far = n[order].astype(np.int64) << 40
    a, b = runs(far + lo[order], far + hi[order])
    low = (1 << 40) - 1
    return names[a >> 40], a & low, b & low


def places(found: DataFrame, types: dict[str, str]) -> DataFrame:
    """(node, a, b): the marked ranges of each text, as packed arrays."""

    def collect(_, x):
        t, a, b = marks(x["t"], x["a"], x["b"])
        first, end = exchange.by_key(t)
        if len(t):
            yield pa.RecordBatch.from_arrays([pa.array(t[first]), *(pa.array([v[i:j].tobytes() for i, j in zip(first, end, strict=True)], pa.binary()) for v in (a, b))], ["node", "a", "b"])

    return exchange.gather(found, types, collect, "node long, a binary, b binary")


def _identified(docs: DataFrame) -> DataFrame:
    """A text is known by two 64-bit hashes, `tid` and `check`."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tid"), F.xxhash64(F.lit(1), text).alias("check"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("rank"),
    )


class _Run:
    """The steps that both operators share."""

    def __init__(self, docs: DataFrame, kind, name: str, alone: bool):
        self.docs, self.kind = _identified(docs), kind
        self.scratch = Scratch(docs.sparkSession, name)
        found = self.scratch.save(repeated_anchors(docs, kind, alone), "anchors", tidy=True)
        self.found = found
        first = self.docs.groupBy("tid", "check").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("copies"))
        self.classes = self.scratch.save(first.withColumn("node", F.monotonically_increasing_id()), "classes")
        # Both sides grow with the corpus, so neither is to be broadcast, whatever its size here.
        own = found.hint("merge").join(self.classes, "tid").select("tid", "check", F.col("first").alias("rank"), "node", "anchors")
        # (tid, check, rank) spreads the copies of a text, and only its first document passes: once, though its row be repeated.
        key = ["tid", "check", "rank"]
        texts = self.docs.select(*key, "text").hint("merge").join(own, key).dropDuplicates(key)
        self.texts = self.scratch.save(texts.select("node", "rank", "text", "anchors"), "texts", tidy=True)

    def drop_anchors(self) -> None:
        self.found = None
        self.scratch.drop("anchors")
        self.scratch.tidy()

    def marked(self, sent: DataFrame, types: dict[str, str], work) -> DataFrame:
        """Texts with the ranges that work marks: it yields (bucket, 1, {t, a, b})."""
        back = ["t", "a", "b"]
        met = exchange.gather(sent, types, work, exchange.schema_of(back), back)
        found = self.scratch.save(places(met, {"t": "<i8", "a": "<i8", "b": "<i8"}), "places")
        return self.texts.select("node", "text").hint("merge").join(found, "node")

    def joined(self, every: DataFrame, result: DataFrame) -> DataFrame:
        """every document with its class and its text's result, if any."""
        return every.hint("merge").join(self.classes.hint("merge").join(result, "node", "left"), ["tid", "check"])


# --- 200-byte strings -------------------------------------------------------------------------------------


def columnwise(strings: list[np.ndarray] | np.ndarray, start: np.ndarray, size: np.ndarray, width: int, window: int) -> np.ndarray:
    """Inserts one symbol of every string each round, last column first, and marks whole repeated windows.

    strings: all bytes, one string behind the other; string i takes columns start[i] to start[i] + size[i].
    Each round keeps the order of all suffixes that begin at its column (the column of the collection's
    Burrows-Wheeler transform follows from it) and, between neighbours, the column where they part.
    A new order is a stable sort of the old one by one symbol; a new common prefix is the least of the
    old ones between its two suffixes. Returns marks[column, string]: the window that begins there is
    also the beginning of a neighbour's suffix.
    """
    m = len(start)
    cells = np.zeros((width, m), np.uint8)
    total = concat_ranges(start, size)
    cells[total, np.repeat(np.arange(m), size)] = strings
    end = start + size
    marks = np.zeros((width - window + 1, m), bool)
    order = np.arange(m)
    part = np.full(m, width, np.int16)  # part[i]: first column in which i - 1 and i differ
    levels = max(1, m.bit_length())
    table = np.empty((levels, m), np.int16)
    log = np.zeros(m + 1, np.int8)
    if m:
        log[1:] = np.floor(np.log2(np.arange(1, m + 1))).astype(np.int8)
    for c in range(width - 1, -1, -1):
        symbol = cells[c][order]
        table[0] = part
        for k in range(1, levels):
            half = 1 << (k - 1)
            table[k, : m - half] = np.minimum(table[k - 1, : m - half], table[k - 1, half:])
            table[k, m - half :] = table[k - 1, m - half :]
        move = np.argsort(symbol, kind="stable")
        order = order[move]
        symbol = symbol[move]
        inside = (c >= start[order]) & (c < end[order])
        lo, hi = move[:-1] + 1, move[1:]
        same = (symbol[1:] == symbol[:-1]) & inside[1:] & inside[:-1]
        part = np.full(m, c, np.int16)
        if m > 1:
            at = np.flatnonzero(same)
            a, b = lo[at], hi[at]
            k = log[b - a + 1]
            part[1:][at] = np.minimum(table[k, a], table[k, b - (1 << k.astype(np.int64)) + 1])
        if c < len(marks):
            long = part - c >= window
            long[:1] = False
            marks[c, order] = long | np.append(long[1:], False)
    return marks


#: Strings that are sorted together. An anchor with more of them is divided by the bytes around it.
TOGETHER = 40_000


def divided(begin: np.ndarray, size: np.ndarray, at: np.ndarray, data: np.ndarray, k: int, window: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts (string, first byte, size) of one anchor's strings that settle all its windows, none across two parts.

    A window holds the anchor and window - k bytes around it, so at least half of these lie on one side. Windows with
    the first half or more of them to the right meet by the bytes right of the anchor; all others by those to its left.
    """
    half = (window - k) // 2
    after, out = k + half, []
    low = at + after - window  # windows from here on have `half` bytes to the right
    for right in (True, False):
        a = np.maximum(low, 0) if right else np.zeros(len(at), np.int64)
        z = size if right else np.minimum(size, low - 1 + window)
        own = np.flatnonzero(z - a >= window)
        if not len(own):
            continue
        side = np.stack([data[begin[own] + at[own] + (k + i if right else i - half)] for i in range(half)], 1)
        # a string of the left parts has its half of bytes there, since its windows begin before low
        code = np.array([xxhash.xxh3_64_intdigest(r.tobytes()) for r in side], np.uint64)
        order = np.argsort(code, kind="stable")
        first, end = exchange.by_key(code[order])
        out += [(own[order[i:j]], a[own[order[i:j]]], (z - a)[own[order[i:j]]]) for i, j in zip(first, end, strict=True) if j - i > 1]
    return out


def byte_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): each byte that is covered by a 200-byte string
    which starts in another place too is removed; strings are judged on the input.

    Texts are UTF-8 bytes (null: empty). A text with a copy is removed whole if it has 200 bytes. Repeated
    rows are copies. Rows with a null doc_id are documents like others. An empty table gives no rows.
    """
    kind, nb, few = Bytes(), exchange.buckets(docs), exchange.coarse(docs)
    run = _Run(docs, kind, "op5", alone=True)
    run.drop_anchors()
    window, left = kind.window, kind.window - kind.k
    width = left + window
    names = ["t", "g", "place", "size", "at", "data", "a", "b"]

    def emit(batches):
        held, size = [], 0

        def flush():
            raw, t, g, place, n, at = (np.concatenate([x[i] for x in held]) for i in range(6))
            begin = np.cumsum(n) - n
            text = raw.tobytes()
            key = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[i : i + j], 7) for i, j in zip(begin.tolist(), n.tolist(), strict=True)), "<u8").reshape(-1, 2)
            order = np.lexsort((key[:, 1], key[:, 0], at))
            k0, k1, by = key[order, 0], key[order, 1], at[order]
            new = np.append(True, (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1]) | (by[1:] != by[:-1]))
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(order)))
            many = np.zeros(len(order), bool)
            many[order] = np.repeat(count > 1, count)
            # equal strings: all their windows repeat
            mt, ma, mb = marks(t[many], place[many], place[many] + n[many])
            yield from exchange.blobs(_to(mt, few), 1, names, t=mt, a=ma, b=mb)
            one = np.sort(order[first])
            yield from exchange.ragged((mix(g[one]) % np.uint64(nb)).astype(np.int64), 0, names, "data", raw, begin[one], n[one], t=t[one], g=g[one], place=place[one], size=n[one], at=at[one])

        for b in batches:
            col, ids = binary(b.column("text")), b.column("node").to_numpy(zero_copy_only=False)
            own = [np.frombuffer(x, "<u8") for x in b.column("anchors").to_pylist()]
            for lo, raw, off in pieces(col, kind.piece):
                code, rows, place, w0, w1 = kind.anchors(raw, off)
                hit = known_anchors(rows, code, own[lo : lo + len(off) - 1])
                if not hit.any():
                    continue
                code, rows, place, w0, w1 = (x[hit] for x in (code, rows, place, w0, w1))
                n = w1 - w0 + window
                held.append((raw[concat_ranges(w0, n)], ids[lo + rows], code, w0 - off[rows], n, place - w0))
                size += int(n.sum())
                if size >= 24 * FLUSH:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    def work(k, x):
        if k == 1:
            yield _to(x["t"], few), 0, {n: x[n] for n in ("t", "a", "b")}
            return
        order = np.argsort(x["g"], kind="stable")
        begin = np.cumsum(x["size"]) - x["size"]
        first, end = exchange.by_key(x["g"][order])
        many = end - first > 1
        parts = []  # (strings, first byte, size) that are sorted together
        for i, j in zip(first[many].tolist(), end[many].tolist(), strict=True):
            own = order[i:j]
            if j - i <= TOGETHER:
                parts.append((own, np.zeros(j - i, np.int64), x["size"][own]))
            else:
                parts += [(own[s], a, n) for s, a, n in divided(begin[own], x["size"][own], x["at"][own], x["data"], kind.k, window)]
        i = 0
        while i < len(parts):
            j, total = i + 1, len(parts[i][0])
            while j < len(parts) and total + len(parts[j][0]) <= TOGETHER:
                total += len(parts[j][0])
                j += 1
            own, a, n = (np.concatenate([p[c] for p in parts[i:j]]) for c in range(3))
            start = left - x["at"][own] + a
            found = columnwise(x["data"][concat_ranges(begin[own] + a, n)], start, n, width, window)
            o, c = np.nonzero(found.T)
            if len(o):
                far = o.astype(np.int64) << 32
                lo, hi = runs(far + c, far + c + window)
                s = lo >> 32
                shift = x["place"][own][s] + a[s] - start[s]
                t, lo, hi = marks(x["t"][own][s], (lo & 0xFFFFFFFF) + shift, (hi & 0xFFFFFFFF) + shift)
                yield _to(t, few), 0, {"t": t, "a": lo, "b": hi}
            i = j

    sent = run.texts.select("node", "text", "anchors").mapInArrow(emit, exchange.schema_of(names))
    types = {"t": "<i8", "g": "<u8", "place": "<i8", "size": "<i8", "at": "<i8", "data": "u1", "a": "<i8", "b": "<i8"}
    marked = run.marked(sent, types, work)

    def finish(batches):
        for b in batches:
            out = []
            for t, text, lo, hi in zip(b.column("node").to_pylist(), binary(b.column("text")).to_pylist(), b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                lo, hi = np.frombuffer(lo, "<i8").tolist(), np.frombuffer(hi, "<i8").tolist()
                kept = hashlib.sha256()
                at = 0
                for s, e in zip(lo, hi, strict=True):
                    kept.update(text[at:s])
                    at = e
                kept.update(text[at:])
                out.append((t, sum(hi) - sum(lo), len(lo), kept.hexdigest()))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["node", "r_n", "r_spans", "r_sha"])

    result = run.scratch.save(marked.mapInArrow(finish, "node long, r_n long, r_spans long, r_sha string"), "result", tidy=True)
    run.scratch.keep("result", "classes")
    whole = run.docs.select("doc_id", "tid", "check", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    all_ = run.joined(whole, result)
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= window)
    return all_.select(
        "doc_id", "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("r_n", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("r_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.lit(EMPTY_SHA)).otherwise(F.coalesce("r_sha", "sha")).alias("kept_sha256"),
    )


# --- 13-word windows --------------------------------------------------------------------------------------


def prefix_cuts(counts: dict[int, int], groups: int, pairs: dict[tuple[int, int], int] | None = None) -> np.ndarray:
    """Bounds of groups of suffixes, as 64-bit codes (16 bits of the first word, 16 of the second, 32 of five words).

    A short prefix, one word, does while groups hold little; a word with more than a group's share is divided by its
    second word; and a pair of words with more than a share (`pairs` has those with a sixteenth or more) by five.
    """
    share = max(1, -(-sum(counts.values()) // max(1, groups)))
    heavy: dict[int, list[tuple[int, int]]] = {}
    for (a, b), n in sorted((pairs or {}).items()):
        if n > share:
            heavy.setdefault(a, []).append((b, n))
    cuts, held = [], 0
    for code in sorted(counts):
        n, base = counts[code], code << 48
        if held and held + n > share:
            cuts.append(base)
            held = 0
        if n <= share:
            held += n
            continue
        rest = n - sum(m for _, m in heavy.get(code, []))
        parts = max(1, -(-rest // share))
        cuts += [base] + [base + ((i << 48) // parts) for i in range(1, parts)]
        for b, m in heavy.get(code, []):
            inner = -(-m // share)
            cuts += [base + (b << 32) + ((i << 32) // inner) for i in range(inner)] + [base + ((b + 1) << 32)]
        cuts.append((code + 1) << 48)
        held = 0
    return np.unique(np.array([c for c in cuts if c < 1 << 64], np.uint64))


def sorted_suffixes(flat: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes that begin at `at`, by their first `depth` words, and the number of words (at most depth)
    that each has in common with the one before it in that order."""
    _, code = np.unique(flat, return_inverse=True)
    bits = max(1, int(code.max(initial=0)).bit_length())
    each = 63 // bits
    keys = []
    for c in range(0, depth, each):
        key = np.zeros(len(at), np.uint64)
        for j in range(c, min(depth, c + each)):
            key = (key << np.uint64(bits)) | code[at + j].astype(np.uint64)
        keys.append(key)
    order = np.lexsort(keys[::-1])
    own = at[order]
    common = np.zeros(len(at), np.int64)
    same = np.ones(max(0, len(at) - 1), bool)
    for j in range(depth):
        word = code[own + j]
        same &= word[1:] == word[:-1]
        common[1:] += same
    return order, common


def subtree(flat, size, r, depth):
    """Windows of segments (size words each, one behind the other in flat; r: rank of their document).

    Gives for each window its segment, its place in the segment, whether it lies beyond its node's least document, and
    whether it is the first of its node. A node is an inner node of the group's suffix tree at the depth of a window:
    neighbours in suffix order that have `depth` words in common.
    """
    begin, n = np.cumsum(size) - size, size - depth + 1
    segment = np.repeat(np.arange(len(size)), n)
    at = concat_ranges(begin, n)
    order, common = sorted_suffixes(flat, at, depth)
    first = np.flatnonzero(common < depth)
    rank = r[segment][order]
    least = np.minimum.reduceat(rank, first) if len(first) else rank
    count = np.diff(np.append(first, len(order)))
    beyond, head = np.zeros(len(at), bool), np.zeros(len(at), bool)
    beyond[order] = rank > np.repeat(least, count)
    head[order[first]] = True
    return segment, at - begin[segment], beyond, head


def word_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): each word covered by a 13-word window whose words also start in
    a document with a smaller doc_id is removed; windows are judged on the input.

    Suffixes that can repeat are divided into groups of bounded size by variable-length prefixes, read from their
    window's anchor on, so that neighbours travel as one segment of at most 21 words. A group's suffixes are sorted
    word by word; with the common prefixes of neighbours, that is the group's suffix tree, of which the inner nodes at
    a depth of 13 words or more are the repeats. Of each node the occurrences beyond its least document are marked,
    and marked neighbours join into maximal repeats. A null doc_id is smaller than all others. Null or empty text: no
    words. Repeated rows with one doc_id don't remove each other. An empty table gives no rows. Very long texts are
    worked on whole, in blocks.
    """
    kind, few = Words(), exchange.coarse(docs)
    run = _Run(docs, kind, "op7", alone=False)
    names = ["size", "r", "t", "a", "words", "b"]

    def prefix_counts(batches):
        for b in batches:
            code = np.concatenate([np.zeros(0, np.uint64)] + [np.frombuffer(x, "<u8") for x in b.column("anchors").to_pylist()]) >> np.uint64(32)
            v, n = np.unique(code.astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(n.astype(np.int64))], ["code", "n"])

    # At most 65,536 counts of first words, and of word pairs those with a sixteenth of a group's share: 16 for each group at most.
    counts = run.found.select("anchors").mapInArrow(prefix_counts, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = run.scratch.save(counts, "prefixes")
    first = {r["c"]: r["n"] for r in counts.groupBy(F.shiftright("code", 16).alias("c")).agg(F.sum("n").alias("n")).collect()}
    groups = exchange.buckets(docs)
    pairs = {(r["code"] >> 16, r["code"] & 0xFFFF): r["n"] for r in counts.where(F.col("n") * 16 * groups >= sum(first.values())).collect()}
    cuts = prefix_cuts(first, groups, pairs)
    run.scratch.drop("prefixes")
    run.drop_anchors()

    def marked(t, a, segment, place, beyond):
        s, lo = segment[beyond], a[segment[beyond]] + place[beyond]
        return marks(t[s], lo, lo + kind.window)

    def emit(batches):
        held, size = [], 0

        def flush():
            flat, n, code, r, t, a = (np.concatenate([x[i] for x in held]) for i in range(6))
            begin = np.cumsum(n) - n
            segment, place, beyond, head = subtree(flat, n, r, kind.window)
            mt, ma, mb = marked(t, a, segment, place, beyond)
            yield from exchange.blobs(_to(mt, few), 1, names, t=mt, a=ma, b=mb)
            # What goes on: windows of a node's least document; nothing is smaller than a null doc_id, so of these one is enough.
            on = ~beyond & (head | (r[segment] != _LEAST))
            segment, place = segment[on], place[on]
            if not len(segment):
                return
            new = np.append(True, (segment[1:] != segment[:-1]) | (place[1:] != place[:-1] + 1))
            i = np.flatnonzero(new)
            s, p = segment[i], place[i]
            many = np.diff(np.append(i, len(segment))) + kind.window - 1
            group = np.searchsorted(cuts, code[s], "right")
            yield from exchange.ragged(group, 0, names, "words", flat, begin[s] + p, many, size=many.astype(np.uint8), r=r[s], t=t[s], a=a[s] + p)

        for b in batches:
            col = binary(b.column("text"))
            ids, rank = (b.column(n).to_numpy(zero_copy_only=False) for n in ("node", "rank"))
            own = [np.frombuffer(x, "<u8") for x in b.column("anchors").to_pylist()]
            for lo, raw, off in pieces(col, kind.piece):
                h, first, (code, rows, place, w0, w1) = kind.hashed(raw, off)
                hit = known_anchors(rows, code, own[lo : lo + len(off) - 1])
                if not hit.any():
                    continue
                code, rows, place, w0, w1 = (x[hit] for x in (code, rows, place, w0, w1))
                n = w1 - w0 + kind.window
                held.append((h[concat_ranges(w0, n)], n, code, rank[lo + rows], ids[lo + rows], w0 - first[rows]))
                size += int((w1 - w0 + 1).sum())
                if 2 * size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    def work(k, x):
        if k == 1:
            yield _to(x["t"], few), 0, {n: x[n] for n in ("t", "a", "b")}
            return
        segment, place, beyond, _ = subtree(x["words"], x["size"].astype(np.int64), x["r"], kind.window)
        t, a, b = marked(x["t"], x["a"], segment, place, beyond)
        yield _to(t, few), 0, {"t": t, "a": a, "b": b}

    sent = run.texts.select("node", "rank", "text", "anchors").mapInArrow(emit, exchange.schema_of(names))
    types = {"size": "u1", "r": "<i8", "t": "<i8", "a": "<i8", "words": exchange.CODED, "b": "<i8"}
    found = run.marked(sent, types, work)

    def finish(batches):
        for b in batches:
            out = []
            for t, text, lo, hi in zip(b.column("node").to_pylist(), binary(b.column("text")).to_pylist(), b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                w, at, kept = text.split(), 0, []
                for s, e in zip(np.frombuffer(lo, "<i8").tolist(), np.frombuffer(hi, "<i8").tolist(), strict=True):
                    kept += w[at:s]
                    at = e
                kept += w[at:]
                out.append((t, len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["node", "r_n", "r_sha"])

    def whole(batches):
        for b in batches:
            w = [x.split() for x in binary(b.column("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("tid"), b.column("check"), b.column("rank"), pa.array([len(x) for x in w], pa.int64()), pa.array([hashlib.sha256(b" ".join(x)).hexdigest() for x in w], pa.string())],
                ["doc_id", "tid", "check", "rank", "n_words", "sha"],
            )

    result = run.scratch.save(found.mapInArrow(finish, "node long, r_n long, r_sha string"), "result", tidy=True)
    run.scratch.keep("result", "classes")
    every = run.docs.select("doc_id", "text", "tid", "check", "rank").mapInArrow(whole, "doc_id long, tid long, check long, rank long, n_words long, sha string")
    all_ = run.joined(every, result)
    copied = (F.col("rank") > F.col("first")) & (F.col("n_words") >= kind.window)
    return all_.select(
        "doc_id", "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("r_n", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.lit(EMPTY_SHA)).otherwise(F.coalesce("r_sha", "sha")).alias("kept_sha256"),
    )
