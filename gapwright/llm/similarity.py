"""N-gram Jaccard join by a token-group matrix.

Sets of 5-word shingles; two documents link at a Jaccard similarity of 0.75 or more, exactly.

1. Equal sets are one class (its least doc_id stands for it).
2. A class shows its prefix: the rarest 30 % of its tokens, by a count-min estimate of document frequency. Two sets
   that link share at least 5 % of the larger one's tokens within their prefixes. So a class needs that many
   tokens that other prefixes have too, and of those the most frequent (by exact count) may be left out.
3. Classes that are left are partitioned into groups of similar sets: each goes to the least class with which it
   shares most tokens. Large groups are divided into parts of about PART.
4. The token-group matrix stores each part's union of shared prefix tokens. A group's own members are linked first.
5. Every class that shares a kept token with another part, and isn't in one component with it, is a query. Its
   overlap with the part's stored union bounds its overlap with any member, so parts below common_least(n) tokens
   are left closed before any text moves. The texts of the others go to the part, where the union of all its tokens
   bounds again, and only then members are compared. A part with many queries is opened in several tasks.

Links within a component that are already implied are not looked for, so large groups of near copies cost
about one comparison for each document and part, not one for each pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import Scratch, binary, concat_ranges, grams, mix, pieces, words
from .components import components
from .exchange import FLUSH
from .repeats import _LEAST

SHINGLE = 5
#: Members of a group that are kept together, and queries that one task asks them.
PART, ASKED = 256, 1024
#: Entries of a token-group matrix that are paired at a time.
PAIRS = 400_000
#: Counters of the frequency sketch: a fixed size, whatever the corpus.
SLOTS, SLICE = 1 << 20, 1 << 14
#: Tokens that so many classes of one flush have come last in the order, and their entries are settled there.
HOT = 64
LAST = (1 << 40) - 1


def common_least(n):
    """Tokens that two linked sets share within their prefixes, at least: n is the larger set's size."""
    return n // 20 + 1


def prefix_size(n: int) -> int:
    """n - ceil(0.75 n) + common_least(n), and one more for the roundings of two different sizes.

    For sizes a <= b of linked sets the overlap is at least ceil(0.75 b). The prefixes share common_least(b) tokens if
    prefix_size(a) >= a - ceil(0.75 b) + common_least(b), and ceil(0.75 b) - ceil(0.75 a) + 1 >= common_least(b) - common_least(a).
    """
    return min(n, n - (3 * n + 3) // 4 + common_least(n) + 1) if n else 0


def enough(both, a, b):
    """Is the Jaccard similarity of sets of sizes a and b with `both` common tokens at least 0.75?"""
    return 100 * both >= 75 * (a + b - both)


def shingle_sets(raw: np.ndarray, off: np.ndarray):
    """Sorted distinct shingle hashes of each row (words lower-cased in A-Z)."""
    h, _, _, first = words(raw, off, lower=True)
    g = grams(h, SHINGLE)
    none = np.zeros(0, np.uint64)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            yield np.unique(g[a : b - SHINGLE + 1])
        elif b > a:
            yield grams(h[a:b], b - a) ^ np.uint64(b - a)
        else:
            yield none


def sets_of(texts) -> list[np.ndarray]:
    return [s for _, raw, off in pieces(texts) for s in shingle_sets(raw, off)]


def frequencies(docs: DataFrame) -> np.ndarray:
    """Count-min estimate of each slot's document frequency, merged from all tasks: SLOTS counters."""

    def count(batches):
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            for _, raw, off in pieces(binary(b.column("text"))):
                own = list(shingle_sets(raw, off))
                if own:
                    total += np.bincount((np.concatenate(own) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield from exchange.blobs(at // SLICE, 0, ["slot", "n"], slot=at.astype(np.int32), n=total[at])  # small numbers: the exchange packs them

    def merge(_, x):
        total = np.bincount(x["slot"] % SLICE, x["n"], SLICE).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([int(x["slot"][0]) // SLICE], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "n"])

    rows = exchange.gather(docs.select("text").mapInArrow(count, exchange.schema_of(["slot", "n"])), {"slot": "<i4", "n": "<i8"}, merge, "part int, n binary").collect()
    out = np.zeros(SLOTS, np.int64)
    for r in rows:
        out[r["part"] * SLICE : (r["part"] + 1) * SLICE] = np.frombuffer(r["n"], "<i8")
    return np.floor(4 * np.log2(np.maximum(out, 1))).astype(np.uint8)


def prefixes(docs: DataFrame, level: np.ndarray) -> DataFrame:
    """(doc_id, rank, tid, n, sid, tokens): size, fingerprint and prefix of each document's set. A token is the
    frequency level in the high byte and 56 bits of the shingle's hash, so rarer tokens come first."""
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches):
        for b in batches:
            n, sid, tokens = [], [], []
            for _, raw, off in pieces(binary(b.column("text"))):
                for s in shingle_sets(raw, off):
                    n.append(len(s))
                    sid.append(xxhash.xxh3_128_digest(s.tobytes()))
                    t = (shared.value[(s & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                    tokens.append(np.sort(t)[: prefix_size(len(s))].tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("rank"), b.column("tid"), pa.array(n, pa.int64()), pa.array(sid, pa.binary()), pa.array(tokens, pa.binary())],
                ["doc_id", "rank", "tid", "n", "sid", "tokens"],
            )

    return docs.select("doc_id", "rank", "tid", "text").mapInArrow(run, "doc_id long, rank long, tid long, n long, sid binary, tokens binary")


def shared_tokens(classes: DataFrame) -> DataFrame:
    """(node, n, pivot, kept, tokens) of classes (node, n, tokens) that can link: shared tokens, rarest first, of which
    `kept` have to be looked up, and the least class that most of these lead to.

    Tokens are ordered by the number of prefixes that have them, hot ones last. A class with fewer shared tokens than
    common_least(n) links with nothing; of the others' shared tokens the last common_least(n) - 1 needn't be looked
    up, as the rarest of the tokens that two linked sets share can't be among them.
    """
    nb = exchange.buckets(classes)
    names = ["h", "r", "n", "f", "p"]

    def home(r):
        return (mix(r.view(np.uint64)) % np.uint64(nb)).astype(np.int64)

    def told(h, r, n, f, p):
        yield from exchange.blobs(home(r), 1, names, h=h, r=r, n=n, f=f, p=p)

    def by_token(h, r, n, f):
        order = np.lexsort((r, h))
        h, r, n, f = h[order], r[order], n[order], f[order]
        first, end = exchange.by_key(h)
        return h, r, n, f, first, end - first

    def emit(batches):
        held, size = [], 0

        def flush():
            h, r, n = (np.concatenate([x[i] for x in held]) for i in range(3))
            h, r, n, f, first, many = by_token(h, r, n, np.zeros(len(h), np.int64))
            hot = many >= HOT
            at = concat_ranges(first[hot], many[hot])
            yield from told(h[at], r[at], n[at], np.full(len(at), LAST), np.repeat(r[first[hot]], many[hot]))
            # a hot token goes on once, and tells the others' entries that it is hot
            f[first[hot]] = LAST
            stay = np.ones(len(h), bool)
            stay[at] = False
            stay[first[hot]] = True
            h, r, n, f = h[stay], r[stay], n[stay], f[stay]
            yield from exchange.blobs((mix(h) % np.uint64(nb)).astype(np.int64), 0, names, h=h, r=r, n=n, f=f)

        for b in batches:
            tokens = [np.frombuffer(x, "<u8") for x in b.column("tokens").to_pylist()]
            if tokens:
                many = [len(t) for t in tokens]
                held.append((np.concatenate(tokens), *(np.repeat(b.column(c).to_numpy(zero_copy_only=False), many) for c in ("node", "n"))))
                size += len(held[-1][0])
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def meet(k, x):
        if k == 1:
            yield home(x["r"]), 1, {c: x[c] for c in names}
            return
        h, r, n, f, first, many = by_token(*(x[c] for c in names[:4]))
        if not len(h):
            return
        hot = np.maximum.reduceat(f, first)
        count = np.repeat(np.where(hot > 0, LAST, many), many)
        pivot = np.repeat(r[first], many)
        own = count > 1
        yield home(r[own]), 1, {"h": h[own], "r": r[own], "n": n[own], "f": count[own], "p": pivot[own]}

    def choose(_, x):
        order = np.lexsort((x["h"], x["f"], x["r"]))
        h, r, n, p = (x[c][order] for c in ("h", "r", "n", "p"))
        first, end = exchange.by_key(r)
        rows = []
        for i, j in zip(first.tolist(), end.tolist(), strict=True):
            t, own = h[i:j], p[i:j]
            if (t[1:] == t[:-1]).any():  # a hot token's first entry is told by its flush and by its bucket
                new = np.append(True, t[1:] != t[:-1])
                t = t[new]
            keep = len(t) - common_least(int(n[i])) + 1
            if keep > 0:
                other = own[own != r[i]]
                pivot = int(r[i])
                if len(other):
                    v, c = np.unique(other, return_counts=True)
                    pivot = min(pivot, int(v[c.argmax()]))
                rows.append((int(r[i]), int(n[i]), pivot, keep, t.tobytes()))
        if rows:
            cols = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["node", "n", "pivot", "kept", "tokens"])

    types = {"h": "<u8", "r": "<i8", "n": "<i8", "f": "<i8", "p": "<i8"}
    met = exchange.gather(classes.select("node", "n", "tokens").mapInArrow(emit, exchange.schema_of(names)), types, meet, exchange.schema_of(names), names)
    return exchange.gather(met, types, choose, "node long, n long, pivot long, kept long, tokens binary")


class Group:
    """Members' token union with, for each token, the members that have it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        rows = np.repeat(np.arange(len(sets)), self.sizes)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.members = rows[order]
        flat = flat[order]
        self.first, self.end = exchange.by_key(flat)
        self.union = flat[self.first]

    def linked(self, query: np.ndarray) -> np.ndarray:
        """Members that link with the query; none if the union's overlap can't reach the threshold."""
        if not len(self.union) or not len(query):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.union, query), len(self.union) - 1)
        at = at[self.union[at] == query]
        if 100 * len(at) < 75 * len(query):
            return np.zeros(0, np.int64)
        who = self.members[concat_ranges(self.first[at], self.end[at] - self.first[at])]
        both = np.bincount(who, minlength=len(self.sizes))
        return np.flatnonzero((both > 0) & enough(both, self.sizes, len(query)))


def inner_links(nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """(node, least node of its tree) of every member. Members that are in the first one's tree by then don't ask: whoever isn't asks them."""
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    group, trees = Group(sets), len(nodes)
    for i in range(len(nodes)):
        if i and root(i) == root(0):
            continue
        for j in group.linked(sets[i]).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                trees -= 1
        if trees == 1:
            break
    least: dict[int, int] = {}
    for i, x in enumerate(nodes):
        least[root(i)] = min(x, least.get(root(i), x))
    return [(x, least[root(i)]) for i, x in enumerate(nodes)]


def _by_part(rows: DataFrame, work, out: str) -> DataFrame:
    """Gives work(part, rows) every part's rows: members first, then queries, as an iterator of (part, kind, node, text)."""

    def run(batches):
        def flat():
            for b in batches:
                yield from zip(*(b.column(n).to_pylist() for n in ("part", "kind", "node")), binary(b.column("text")), strict=True)

        import itertools

        for part, own in itertools.groupby(flat(), key=lambda r: r[0]):
            edges = work(own)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])

    n = exchange.partitions(rows.sparkSession)
    return rows.repartition(n, "part").sortWithinPartitions("part", "kind", "node").mapInArrow(run, out)


def _sets(rows) -> list[np.ndarray]:
    return sets_of(pa.array([r[3].as_py() for r in rows], pa.large_binary()))


def _inner(own):
    rows = list(own)
    return inner_links([r[2] for r in rows], _sets(rows))


def _opened(own):
    members, group, ranks, edges, asked = [], None, [], [], []

    def ask():
        for r, q in zip(asked, _sets(asked), strict=True):
            edges.extend((r[2], ranks[j]) for j in group.linked(q).tolist())

    for r in own:
        if r[1] == 0:
            members.append(r)
            continue
        if group is None:
            group, ranks = Group(_sets(members)), [m[2] for m in members]
        asked.append(r)
        if len(asked) >= 200:
            ask()
            asked.clear()
    if asked:
        ask()
    return edges


def overlaps(h, r, c, m, g, n, k):
    """(query, part, common tokens, kept ones among them) of one bucket of the token-group matrix, summed by query and part.

    An entry is a token (h) of a class (r, size n, k: is it kept) in a part (g) of a component (c, of m members). The
    smaller component asks the larger one, by (members, identifier); least and most size in a part bound who can link.
    A part can have members of several components: the first given entry of a token and part is compared, so the
    largest component's has to come first (see `largest_first`).
    """
    order = np.lexsort((g, h))
    h, r, c, m, g, n, k = (x[order] for x in (h, r, c, m, g, n, k))
    cell = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))) if len(h) else np.zeros(0, np.int64)
    least, most = (f.reduceat(n, cell) if len(cell) else n for f in (np.minimum, np.maximum))
    first, end = exchange.by_key(h)
    lo, hi = np.searchsorted(cell, first), np.searchsorted(cell, end)  # a token's cells
    token = np.repeat(np.arange(len(first)), end - first)
    several = (hi - lo > 1)[token]
    rows = np.flatnonzero(several)
    found = []
    each = (hi - lo)[token[rows]]
    at = 0
    total = np.cumsum(each)
    while at < len(rows):
        done = total[at - 1] if at else 0
        z = max(at + 1, int(np.searchsorted(total, done + PAIRS, "right")))
        own = np.repeat(rows[at:z], each[at:z])
        other = concat_ranges(lo[token[rows[at:z]]], each[at:z])
        x = cell[other]
        ask = (g[own] != g[x]) & (c[own] != c[x]) & ((m[own] < m[x]) | ((m[own] == m[x]) & (c[own] < c[x]))) & (4 * n[own] >= 3 * least[other]) & (3 * n[own] <= 4 * most[other])
        own, other, x = own[ask], other[ask], x[ask]
        # a token counts as kept if the query keeps it or a member does
        held = np.maximum.reduceat(k, cell)[other] if len(other) else other
        found.append(_summed(r[own], g[x], np.ones(len(own), np.int64), np.maximum(k[own], held)))
        if len(found) > 8:
            found = [_summed(*(np.concatenate(v) for v in zip(*found, strict=True)))]
        at = z
    return _summed(*(np.concatenate(v) for v in zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 4


def largest_first(h, r, c, m, g, n, k):
    """The entries by descending (members, component). A class then asks a part for a token exactly if some member that
    has it is of a larger component than its own; of two classes in different components, one always asks the other's part."""
    order = np.lexsort((c, m))[::-1]
    return tuple(x[order] for x in (h, r, c, m, g, n, k))


def _summed(r, g, n, k):
    order = np.lexsort((g, r))
    r, g, n, k = r[order], g[order], n[order], k[order]
    if not len(r):
        return r, g, n, k
    first = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (g[1:] != g[:-1])))
    return r[first], g[first], np.add.reduceat(n, first), np.add.reduceat(k, first)


def queries_by_group(entries: DataFrame) -> DataFrame:
    """(node, part): each class with the parts to ask, from (node, comp, members, part, n, kept, tokens).

    Two sets that link have a kept token of both in common, and common_least(n) shared prefix tokens. So of a class's
    overlap with a part's stored union, a part is asked only if it has a kept token and reaches that bound.
    """
    nb = exchange.buckets(entries)
    names = ["h", "r", "c", "m", "g", "n", "k"]

    def emit(batches):
        for b in batches:
            tokens = [np.frombuffer(x, "<u8") for x in b.column("tokens").to_pylist()]
            if not tokens:
                continue
            size = np.array([len(t) for t in tokens])
            h = np.concatenate(tokens)
            own = {k: np.repeat(b.column(c).to_numpy(zero_copy_only=False), size) for k, c in (("r", "node"), ("c", "comp"), ("m", "members"), ("g", "part"), ("n", "n"))}
            place = concat_ranges(np.zeros(len(size), np.int64), size)
            kept = (place < np.repeat(b.column("kept").to_numpy(zero_copy_only=False), size)).astype(np.uint8)
            yield from exchange.blobs((mix(h) % np.uint64(nb)).astype(np.int64), 0, names, h=h, k=kept, **own)

    def meet(_, x):
        r, g, n, k = overlaps(*largest_first(*(x[c] for c in ("h", "r", "c", "m", "g", "n")), x["k"].astype(np.int64)))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (r, g, n, k)], ["node", "part", "common", "kept"])

    sent = entries.select("node", "comp", "members", "part", "n", "kept", "tokens").mapInArrow(emit, exchange.schema_of(names))
    types = {"h": "<u8", "r": "<i8", "c": "<i8", "m": "<i8", "g": "<i8", "n": "<i8", "k": "u1"}
    found = exchange.gather(sent, types, meet, "node long, part long, common long, kept long")
    found = found.groupBy("node", "part").agg(F.sum("common").alias("common"), F.sum("kept").alias("kept")).join(entries.select("node", "n"), "node")
    return found.where((F.col("kept") > 0) & (F.col("common") >= common_least_column("n"))).select("node", "part")


def common_least_column(n: str):
    return F.floor(F.col(n) / 20) + 1


def _rooted(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, rank, tid, n, sid), and classes (sid, rank and tid of the least document, root): one root is one component."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("rank"), F.xxhash64(text).alias("tid"), text.alias("text"))
    all_ = scratch.save(prefixes(docs, frequencies(docs)), "sets", tidy=True)
    # A class is known by a number; (rank, tid) is the document that stands for it.
    least = F.min(F.struct("rank", "tid")).alias("s")
    classes = all_.where("n > 0").groupBy("sid").agg(least).select("sid", "s.rank", "s.tid", F.monotonically_increasing_id().alias("node"))
    classes = scratch.save(classes, "classes")

    own = all_.select("rank", "tid", "sid", "n", "tokens").join(classes, ["rank", "tid", "sid"]).dropDuplicates(["rank", "tid", "sid"])
    grouped = scratch.save(shared_tokens(own.select("node", "n", "tokens")), "grouped", tidy=True)
    all_ = scratch.save(all_.drop("tokens"), "documents")
    scratch.drop("sets")
    sizes = grouped.groupBy("pivot").agg(F.count(F.lit(1)).alias("members"))
    salts = F.ceil(F.col("members") / PART).cast("long")
    placed = grouped.join(sizes, "pivot").withColumn("part", F.xxhash64("pivot", F.pmod(F.xxhash64("node"), salts)))
    placed = scratch.save(placed.select("node", "n", "pivot", "part", "kept", "tokens"), "placed")
    where = placed.select("node", "part").join(classes.select("node", "rank", "tid"), "node")
    texts = docs.select("rank", "tid", "text").join(where, ["rank", "tid"]).dropDuplicates(["rank", "tid"])
    texts = scratch.save(texts.select("node", "part", "text"), "texts", tidy=True)

    # A group's pivot is a member of each of its parts, which joins them.
    pivots = placed.select("pivot", "part").distinct().select(F.col("pivot").alias("node"), F.col("part").alias("of"))
    pivots = pivots.join(texts, "node").where("of <> part").select(F.col("of").alias("part"), "node", "text")
    members = texts.select("part", "node", "text")
    rows = members.unionByName(pivots).select("part", F.lit(0).alias("kind"), "node", "text")
    inner = scratch.save(_by_part(rows, _inner, "a long, b long"), "inner", tidy=True)
    # Trees of different parts meet in pivots only: the others follow their tree.
    bridges = inner.join(pivots.select("node").distinct(), F.col("a") == F.col("node"), "left_semi")
    comps = _followed(inner.groupBy("a").agg(F.min("b").alias("b")), components(bridges, scratch, "first"))
    comps = scratch.save(comps.select("node", F.col("root").alias("comp")), "comps")

    # The smaller component asks the larger one, so its members are counted first.
    count = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("members"))
    entries = placed.select("node", "n", "part", "kept", "tokens").join(comps.join(count, "comp"), "node")
    asks = scratch.save(queries_by_group(entries), "asks", tidy=True)
    salts = asks.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("salts"))
    asked = members.join(salts, "part").select(F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "part", "node", "text")
    asking = asks.join(salts, "part").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).join(texts.select("node", "text"), "node")
    rows = [x.select(F.xxhash64("part", "salt").alias("part"), F.lit(kind).alias("kind"), "node", "text") for kind, x in enumerate((asked, asking))]
    outer = scratch.save(_by_part(rows[0].unionByName(rows[1]), _opened, "a long, b long"), "outer", tidy=True)
    # Links between components, as far as there are any.
    a, b = (comps.select(F.col("node").alias(x), F.col("comp").alias(y)) for x, y in (("a", "ca"), ("b", "cb")))
    between = outer.join(a, "a").join(b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    linked = _followed(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")), components(between, scratch, "second"))

    return all_, classes.join(linked, "node", "left").select("sid", "rank", "tid", F.coalesce("root", "node").alias("root"))


def similar(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    component_id is the least doc_id that links reach, the document's own included. A text without words
    (or null) has an empty set and links with nothing. Repeated rows and equal sets are linked. A null doc_id
    is smaller than all others, as a component_id too. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "op3")
    all_, rooted = _rooted(docs, scratch)
    first = rooted.groupBy("root").agg(F.min("rank").alias("component"))
    of_class = rooted.join(first, "root").select("sid", "component")
    out = all_.select("doc_id", "rank", "n", "sid").join(of_class, "sid", "left")
    found = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("rank"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(found != _LEAST, found).alias("component_id"))
    out = scratch.save(out, "result", tidy=True)
    scratch.keep("result")
    return out


def _followed(trees: DataFrame, components_: DataFrame) -> DataFrame:
    """(node, root): each (a, b) of trees with the component that b is in, if any."""
    c = components_.select(F.col("node").alias("_of"), "component")
    return trees.join(c, F.col("b") == F.col("_of"), "left").select(F.col("a").alias("node"), F.coalesce("component", "b").alias("root"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs' rows and columns, one document of each component: the one with the least (doc_id, hash of the text).

    Components are told apart by their texts, so different texts with null or repeated doc_ids each stay. Of
    repeated rows of a document one stays. Texts without words all stay.
    """
    scratch = Scratch(docs.sparkSession, "op3")
    rooted = _rooted(docs.select("doc_id", "text"), scratch)[1]
    least = rooted.groupBy("root").agg(F.min(F.struct("rank", "tid")).alias("s"))
    keep = scratch.save(least.select(F.col("s.rank").alias("_gapwright_rank"), F.col("s.tid").alias("_gapwright_tid")), "kept", tidy=True)
    scratch.keep("kept")
    text = F.coalesce("text", F.lit(""))
    worded = text.rlike(r"[^\x20\x09-\x0D]")
    rows = docs.where(worded).withColumns({"_gapwright_rank": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)), "_gapwright_tid": F.xxhash64(text)})
    key = ["_gapwright_rank", "_gapwright_tid"]
    return rows.dropDuplicates(key).join(keep, key, "left_semi").select(*docs.columns).union(docs.where(~worded))
