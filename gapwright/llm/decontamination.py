"""Benchmark decontamination: rare word-pair seeds, then Smith-Waterman alignment.

Words are runs of letters, digits and non-ASCII bytes, lower-cased in A-Z, so punctuation and layout don't
matter. A test item's seeds are its word pairs; a document hits one with two words that are neighbours or have
one word between. An alignment that reaches the threshold keeps a least number of seeds within a greatest number
of words (see `bounds`). So an item's seeds are ordered by their document frequency in the corpus, the commonest are
left out as far as any copy must still keep one of the others, and only documents that hold one of these rare seeds
are joined to the item. Places with enough hits are then aligned with the item, and the local alignment's score
against that of a whole match decides: no copy is lost on the way (the tests compare with exhaustive alignment).

Items shorter than LEAST_WORDS are found only in documents that are nothing but the item: within a longer text, so
few words are no evidence of a copy.

Seeds are joined by a broadcast of at most BLOCK_BYTES of items; a larger benchmark takes more blocks, each with two
scans of the corpus (seed frequencies, then copies).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _SPACE, binary, concat_ranges, grams, pieces, words

SEED = 2
BLOCK_BYTES = 8 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of a whole match's score from which a passage is a copy.
THRESHOLD = 0.5
#: Items with fewer words leak only as a whole document.
LEAST_WORDS = 8

_PARTS = _SPACE.copy()
_PARTS[[*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = True


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of word hashes a (item) and b (passage): (score, start in b, end in b)."""
    n = len(b)
    j = np.arange(n + 1)
    row, begin = np.zeros(n + 1, np.int64), j.copy()
    best = (0, 0, 0)
    for x in a:
        step = np.where(b == x, MATCH, MISMATCH)
        cell, came = np.zeros(n + 1, np.int64), j.copy()
        diagonal, above = row[:-1] + step, row[1:] + GAP
        take = diagonal >= above
        cell[1:] = np.where(take, diagonal, above)
        came[1:] = np.where(take, begin[:-1], begin[1:])
        low = cell <= 0
        cell[low], came[low] = 0, j[low]
        # gaps in the item: a cell's value less one for each step to the right
        reach = np.maximum.accumulate(cell - GAP * j)
        source = np.maximum.accumulate(np.where(cell - GAP * j == reach, j, 0))
        row, begin = reach + GAP * j, came[source]
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (int(row[k]), int(begin[k]), k)
    return best


def bounds(n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(least number of seeds, greatest number of words) of a passage that aligns with n words at the threshold or more.

    Let the score t = 2 n threshold or more come from m matches, e words of the item that don't match and i words put
    in: 2m - e - i >= t and m + e <= n. Two successive matches are a hit unless a lost word or two put in lie between,
    so hits >= m - 1 - e - i / 2 >= (2t - n) / 3 - 1; and the passage has m + e + i <= 3n - t words.
    """
    t = MATCH * n * threshold
    return np.maximum(1, np.ceil((2 * t - n - 3) / 3 - 1e-9)).astype(np.int64), np.maximum(1, np.floor(3 * n - t + 1e-9)).astype(np.int64)


class Items:
    """A block of test items with their seeds."""

    def __init__(self, ids: list[int], texts: list[str], threshold: float = THRESHOLD):
        self.ids, self.words, self.whole = ids, [], {}
        h, item, offset = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, t in enumerate(texts):
            raw = np.frombuffer((t or "").encode(), np.uint8)
            w = words(raw, np.array([0, len(raw)]), True, _PARTS)[0]
            self.words.append(w)
            if len(w) < LEAST_WORDS:
                if len(w):
                    self.whole.setdefault(w.tobytes(), []).append(i)
                continue
            g = grams(w, SEED)
            h.append(g)
            item.append(np.full(len(g), i))
            offset.append(np.arange(len(g)))
        flat = np.concatenate(h)
        order = np.argsort(flat, kind="stable")
        self.seeds, self.item, self.offset = flat[order], np.concatenate(item)[order], np.concatenate(offset)[order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.seeds >> np.uint64(44)).astype(np.int64)] = True
        self.need, self.span = bounds(np.array([len(w) for w in self.words], np.int64), threshold)
        self.rare = np.ones(len(self.seeds), bool)

    def mark(self, df: np.ndarray) -> None:
        """Rare seeds, from every seed's document frequency: of an item's n seeds the n - need + 1 rarest."""
        order = np.lexsort((self.offset, df, self.item))
        item = self.item[order]
        first = np.searchsorted(item, item)
        n = np.searchsorted(item, item, "right") - first
        self.rare[order] = np.arange(len(order)) - first < n - self.need[item] + 1

    def hits(self, raw: np.ndarray, off: np.ndarray, gapped: bool = True):
        """(word hashes, rows' first words, place of each hit, number of its seed); gapped: pairs with a word between, too."""
        h, _, _, first = words(raw, off, True, _PARTS)
        places, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for reach in (SEED, SEED + 1)[: 1 + gapped]:
            if reach == SEED:
                g = grams(h, SEED)
            else:  # words j and j + 2, hashed as a pair of neighbours
                pairs = np.stack([h[:-2], h[2:]], 1).ravel() if len(h) > 2 else h[:0]
                g = grams(pairs, 2)[::2]
            n = np.maximum(first[1:] - first[:-1] - reach + 1, 0)
            ok = concat_ranges(first[:-1], n)
            ok = ok[self.filter[(g[ok] >> np.uint64(44)).astype(np.int64)]]
            lo, hi = np.searchsorted(self.seeds, g[ok], "left"), np.searchsorted(self.seeds, g[ok], "right")
            places.append(np.repeat(ok, hi - lo))
            numbers.append(concat_ranges(lo, hi - lo))
        return h, first, np.concatenate(places), np.concatenate(numbers)

    def joined(self, first: np.ndarray, place: np.ndarray, number: np.ndarray):
        """(row, place, seed) of hits in rows that hold a rare seed of the hit's item, by row, item and place."""
        row = np.searchsorted(first, place, "right") - 1
        pair = row * len(self.words) + self.item[number]
        own = np.isin(pair, np.unique(pair[self.rare[number]]))
        row, place, number = row[own], place[own], number[own]
        order = np.lexsort((place, self.item[number], row))
        return row[order], place[order], number[order]

    def passages(self, raw: np.ndarray, off: np.ndarray, threshold: float):
        """(row, item, score, rare seeds, first word, end word) of every copied passage of every row."""
        h, first, place, number = self.hits(raw, off)
        if self.whole:
            for r in np.flatnonzero((first[1:] > first[:-1]) & (first[1:] - first[:-1] < LEAST_WORDS)).tolist():
                for k in self.whole.get(h[first[r] : first[r + 1]].tobytes(), ()):
                    yield r, k, 1.0, 0, 0, int(first[r + 1] - first[r])
        row, place, number = self.joined(first, place, number)
        if not len(place):
            return
        item = self.item[number]
        need, span = self.need[item], self.span[item]
        group = row * len(self.words) + item
        # Hits from which enough lie within the span; what aligns from there begins and ends in [lo, hi).
        last = np.arange(len(row)) + need - 1
        end = np.minimum(last, len(row) - 1)
        at = np.flatnonzero((last < len(row)) & (group[end] == group) & (place[end] - place < span))
        if not len(at):
            return
        lo, hi = place[end[at]] - span[at], place[at] + span[at]
        new = np.ones(len(at), bool)
        new[1:] = (group[at][1:] != group[at][:-1]) | (lo[1:] > hi[:-1])
        cut = np.append(np.flatnonzero(new), len(at))
        ends = np.searchsorted(group, group[at], "right")
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            x = int(at[i])
            k, r = int(item[x]), int(row[x])
            a, b = max(int(first[r]), int(lo[i])), min(int(first[r + 1]), int(hi[j - 1]))
            own = number[x : x + int(np.searchsorted(place[x : int(ends[i])], b))]
            if len(np.unique(self.offset[own])) < need[x]:
                continue
            score, s, e = align(self.words[k], h[a:b])
            score /= MATCH * len(self.words[k])
            if score >= threshold:
                yield r, k, score, len(np.unique(own[self.rare[own]])), a + s - int(first[r]), a + e - int(first[r])


def _blocks(benchmark: DataFrame, threshold: float):
    """Items in blocks of bounded size, by identifier; the driver holds one block at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("length(trim(text)) > 0")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    count = -(-total // BLOCK_BYTES)
    for k in range(count):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).orderBy("item_id", "text").collect()
        if own:
            yield Items([r["item_id"] for r in own], [r["text"] for r in own], threshold)


def _counted(docs: DataFrame, items: Items) -> Items:
    """The block with its seeds' document frequencies over all documents looked up (a row for each seed at most)."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        own = shared.value
        n = np.zeros(len(own.seeds), np.int64)
        for b in batches:
            for _, raw, off in pieces(binary(b.column("text"))):
                _, first, place, number = own.hits(raw, off, gapped=False)
                if len(place):
                    row = np.searchsorted(first, place, "right") - 1
                    pairs = np.unique(row * len(own.seeds) + number)
                    n += np.bincount(pairs % len(own.seeds), minlength=len(own.seeds))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["seed", "n"])

    df = np.zeros(len(items.seeds), np.int64)
    for r in docs.select("text").mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect():
        df[r["seed"]] = r["n"]
    items.mark(df)
    return items


LEAKS = "doc_id long, item_id long, score double, n_seeds int, first_word long, end_word long"


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, n_seeds, first_word, end_word): the best copy of each leaked item in each document.

    Null or empty texts and items leak nothing; an empty benchmark or corpus gives no rows. Items that occur
    twice in the benchmark are found as themselves. Repeated documents are one if their doc_id is one. An item of
    fewer than LEAST_WORDS words is found in documents that are the item as a whole, with no seeds. Very long texts
    are looked through whole; of equal scores the one with most rare seeds, then the first, is told.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = spark.createDataFrame([], LEAKS)
    for items in _blocks(benchmark, threshold):
        shared = spark.sparkContext.broadcast(_counted(docs, items))

        def run(batches, shared=shared):
            own = shared.value
            for b in batches:
                names = b.column("doc_id").to_pylist()
                rows = [
                    (names[lo + r], own.ids[k], score, rare, s, e)
                    for lo, raw, off in pieces(binary(b.column("text")))
                    for r, k, score, rare, s, e in own.passages(raw, off, threshold)
                ]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64())
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "score", "n_seeds", "first_word", "end_word"])

        found = found.unionByName(docs.mapInArrow(run, LEAKS))
    best = F.max(F.struct("score", "n_seeds", (-F.col("first_word")).alias("f"), "end_word")).alias("s")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "s.score", "s.n_seeds", (-F.col("s.f")).alias("first_word"), "s.end_word")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs' rows and columns, without documents that hold a copy of a test item (see `leaks`).

    Rows are judged one by one, by their text alone: null and empty texts stay, repeated rows stay or go together, null
    and repeated doc_ids don't matter. An empty benchmark leaves all rows, an empty table has none.
    """
    text = docs.columns.index("text")
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields])
    for items in _blocks(benchmark, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(_counted(docs, items))

        def run(batches, shared=shared):
            own = shared.value
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for lo, raw, off in pieces(binary(b.column(text))):
                    for r, *_ in own.passages(raw, off, threshold):
                        keep[lo + r] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs
