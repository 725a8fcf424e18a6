"""Operators that look at texts together, against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from gapwright.llm import components, decontamination, exchange, repeats, similarity
from gapwright.llm.common import Scratch


def key(i):
    return -1 if i is None or i != i else int(i)


def test_byte_repeats(docs, rows, empty):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    want = Counter()
    for (i, _), t in zip(rows, texts, strict=True):
        cover = bytearray(len(t))
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                cover[k : k + 200] = b"\1" * 200
        kept = bytes(a for a, b in zip(t, cover, strict=True) if not b)
        want[(key(i), len(t), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest())] += 1
    out = repeats.byte_repeats(docs).collect()
    assert Counter((key(r["doc_id"]), *r[1:]) for r in out) == want
    assert sum(w[2] for w in want) > 2000 and repeats.byte_repeats(empty).count() == 0


def test_word_repeats(docs, rows, empty):
    texts = [(key(i), re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in texts:
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, i), i)
    want = Counter()
    for i, w in texts:
        cover = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                cover[k : k + 13] = [True] * 13
        want[(i, len(w), sum(cover), hashlib.sha256(" ".join(a for a, b in zip(w, cover, strict=True) if not b).encode()).hexdigest())] += 1
    out = repeats.word_repeats(docs).collect()
    assert Counter((key(r["doc_id"]), *r[1:]) for r in out) == want
    assert sum(w[2] for w in want) > 200 and repeats.word_repeats(empty).count() == 0


def test_repeated_rows_stay_as_many(spark, empty):
    rng = np.random.default_rng(11)
    say = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 5000, n))
    passage, other = say(400), say(300)
    rows = [(5, passage + " " + say(30))] * 3 + [(3, say(20) + " " + passage)] + [(None, say(40) + " " + other)] * 4 + [(9, other + " " + say(9))] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    test_byte_repeats(docs, rows, empty)
    test_word_repeats(docs, rows, empty)


def test_columnwise_order():
    rng = np.random.default_rng(4)
    for _ in range(30):
        m, width, window = int(rng.integers(1, 40)), 24, 6
        start = rng.integers(0, 8, m)
        size = np.array([int(rng.integers(6, width - s + 1)) for s in start])
        strings = [rng.integers(97, 99, n).astype(np.uint8) for n in size]
        marks = repeats.columnwise(np.concatenate(strings), start, size, width, window)
        at = Counter((c, strings[i][c - s : c - s + window].tobytes()) for i, s in enumerate(start) for c in range(s, s + size[i] - window + 1))
        for i, s in enumerate(start):
            for c in range(width - window + 1):
                inside = s <= c <= s + size[i] - window
                assert marks[c, i] == (inside and at[(c, strings[i][c - s : c - s + window].tobytes())] > 1)


def test_prefix_cuts_bound_groups():
    cuts = repeats.prefix_cuts({1: 10, 2: 10, 7: 5000, 9: 3}, 20)
    assert (np.diff(cuts.astype(object)) > 0).all() and ((cuts >> np.uint64(48)) == 7).sum() > 10
    assert len(repeats.prefix_cuts({}, 8)) == 0


def test_prefix_cuts_divide_heavy_pairs():
    cuts = repeats.prefix_cuts({3: 9000, 5: 40}, 10, {(3, 9): 8000}).astype(object)
    inside = [c for c in cuts if c >> 32 == (3 << 16 | 9)]
    assert len(inside) >= 8 and ((3 << 48) + (10 << 32)) in cuts and (np.diff(cuts) > 0).all()


def test_suffixes_are_sorted_by_words():
    rng = np.random.default_rng(14)
    for _ in range(20):
        flat = rng.integers(0, 3, 200).astype(np.uint64) * np.uint64(1 << 60)
        at = np.sort(rng.choice(190, 60, replace=False))
        order, common = repeats.sorted_suffixes(flat, at, 7)
        rows = [tuple(flat[i : i + 7].tolist()) for i in at[order]]
        assert rows == sorted(rows)
        for k in range(1, len(rows)):
            same = next((j for j in range(7) if rows[k][j] != rows[k - 1][j]), 7)
            assert common[k] == same
        segment, place, beyond, head = repeats.subtree(flat, np.array([50, 90, 60]), np.array([5, 2, 5]), 7)
        begin, rank = np.array([0, 50, 140]), np.array([5, 2, 5])
        least = {}
        for i, p in zip(segment, place, strict=True):
            w = tuple(flat[begin[i] + p : begin[i] + p + 7].tolist())
            least[w] = min(least.get(w, 9), int(rank[i]))
        assert [bool(b) for b in beyond] == [rank[i] > least[tuple(flat[begin[i] + p : begin[i] + p + 7].tolist())] for i, p in zip(segment, place, strict=True)]
        assert head.sum() == len(least)


def test_an_anchor_in_many_surroundings(spark, empty, monkeypatch):
    """One passage of a window's length, in many texts of which some share more around it; anchors are divided."""
    rng = np.random.default_rng(13)
    say = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 5000, n))
    short, around = say(14), [say(30) for _ in range(3)]
    rows = [(i, say(20) + " " + (around[i % 3] if i % 5 == 0 else say(30)) + " " + short + " " + (around[i % 3] if i % 7 == 0 else say(30))) for i in range(150)]
    rows += [(1000, "ab" * 700_000 + say(40) + " " + around[0] + " " + short), (1001, "z" * (1 << 20) + around[0] + " " + short + " " + "q " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    test_word_repeats(docs, rows, empty)
    strings = [(i, t[-3000:]) for i, t in rows]
    docs = spark.createDataFrame(strings, "doc_id long, text string").repartition(3)
    test_byte_repeats(docs, strings, empty)


@pytest.mark.parametrize("seed", range(6))
def test_divided_anchors_lose_no_window(seed):
    rng = np.random.default_rng(seed)
    window, k, left = 200, 32, 168
    anchor = rng.integers(97, 120, k)
    sides = [rng.integers(97, 120, left) for _ in range(4)]
    strings, ats = [], []
    for _ in range(60):
        a, b = int(rng.integers(0, left + 1)), int(rng.integers(0, left + 1))
        if a + b < left:
            b = left
        x, y = sides[rng.integers(4)].copy(), sides[rng.integers(4)].copy()
        for side in (x, y):
            if rng.random() < 0.6:
                side[rng.integers(left)] = 65
        strings.append(np.concatenate([x[left - a :] if a else x[:0], anchor, y[:b]]).astype(np.uint8))
        ats.append(a)
    size, at = np.array([len(x) for x in strings]), np.array(ats)
    begin, data = np.cumsum(size) - size, np.concatenate(strings)
    whole = repeats.columnwise(data, left - at, size, left + window, window)
    want = {(i, int(c) - (left - ats[i])) for i in range(60) for c in np.flatnonzero(whole[:, i])}
    got = set()
    for own, a, n in repeats.divided(begin, size, at, data, k, window):
        part = np.concatenate([strings[i][x : x + m] for i, x, m in zip(own, a, n, strict=True)])
        start = left - at[own] + a
        found = repeats.columnwise(part, start, n, left + window, window)
        got |= {(int(i), int(c) - int(start[j]) + int(a[j])) for j, i in enumerate(own) for c in np.flatnonzero(found[:, j])}
    assert got == want and len(want) > 20


def test_long_text_is_hashed_in_blocks(monkeypatch):
    from gapwright.llm import common

    rng = np.random.default_rng(15)
    raw = rng.choice(np.frombuffer(b"abcAB \n", np.uint8), 5000)
    off = np.array([0, 10, 10, 4000, 5000])
    want = common.words(raw, off, True)
    monkeypatch.setattr(common, "BLOCK_BYTES", 7)
    assert all((a == b).all() for a, b in zip(want, common.words(raw, off, True), strict=True))


def shingles(t):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_roots(rows):
    """(doc_id, size of the set, component as a row number, its least doc_id) of each row."""
    sets = [(key(i), shingles(t)) for i, t in rows]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                up[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(s), root(i), least[root(i)]) for i, (d, s) in enumerate(sets)]


def plain_components(rows):
    return Counter((d, n, least) for d, n, _, least in plain_roots(rows))


def near_group(n=400, seed=8):
    """A chain of near copies around the threshold, larger than a part of a group, and texts that only share a passage."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        w = list(base)
        for k in rng.choice(60, rng.integers(0, 3), replace=False):
            w[k] = f"e{rng.integers(9)}"
        rows.append((int(i * 7 % 997), " ".join(w)))
    common = " ".join(base[:20])
    rows += [(2000 + i, " ".join(f"u{i}_{k}" for k in range(12)) + " " + common) for i in range(60)]
    return rows


@pytest.mark.parametrize("which", ["corpus", "near"])
def test_similarity(spark, docs, rows, which):
    if which == "near":
        rows = near_group()
        docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = similarity.similar(docs).collect()
    assert Counter((key(r["doc_id"]), r["n_shingles"], key(r["component_id"])) for r in out) == plain_components(rows)


def test_overlaps_with_the_stored_unions():
    """Sums by query and part against a plain loop, in chunks too."""
    rng = np.random.default_rng(17)
    n = 500
    node = rng.integers(0, 60, n)
    h, own = np.unique(np.stack([rng.integers(0, 25, n), node]), axis=1)
    comp, part, size, kept = own % 12, own % 20 + 100, 50 + own % 30, rng.integers(0, 2, len(own))
    members = 1 + comp % 3
    want = Counter()
    kept_of = Counter()
    for i in range(len(h)):
        for p in set(part.tolist()):
            cell = [j for j in range(len(h)) if h[j] == h[i] and part[j] == p]
            if not cell or p == part[i]:
                continue
            j = cell[0]
            if comp[j] != comp[i] and (members[i], comp[i]) < (members[j], comp[j]) and 4 * size[i] >= 3 * min(size[cell]) and 3 * size[i] <= 4 * max(size[cell]):
                want[int(own[i]), p] += 1
                kept_of[int(own[i]), p] += int(max(kept[i], max(kept[cell])))
    for chunk in (10, 1 << 20):
        similarity.PAIRS = chunk
        r, g, c, k = similarity.overlaps(h.astype(np.uint64), own, comp, members, part, size, kept)
        assert {(int(a), int(b)): int(x) for a, b, x in zip(r, g, c, strict=True)} == dict(want)
        assert {(int(a), int(b)): int(x) for a, b, x in zip(r, g, k, strict=True)} == {key: kept_of[key] for key in want}
    similarity.PAIRS = 400_000


def passages(seeds):
    """Overlapping windows of long texts: many pairs around the threshold, and groups of similar sets that don't all link."""
    rows = []
    for g in seeds:
        rng = random.Random(g)
        text = [f"g{g}_{i}" for i in range(rng.randrange(120, 400))]
        for _ in range(rng.randrange(10, 60)):
            n, a = rng.randrange(40, 110), rng.randrange(0, len(text) - 40)
            w = text[a : a + n]
            if rng.random() < 0.3:
                w[rng.randrange(len(w))] = f"e{g}_{rng.randrange(4)}"
            rows.append((len(rows), " ".join(w)))
    return rows


def test_links_into_parts_of_several_components(spark):
    rows = passages([19, 39, 115, 141, 175, 202, 226, 238, 256, 273, 287, 293])
    out = similarity.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == plain_components(rows)


@pytest.mark.parametrize("seed", range(3))
def test_one_of_two_classes_asks_for_every_common_token(seed):
    """Whichever members of other components a part has, and in whatever order they come."""
    rng = np.random.default_rng(seed)
    n = 300
    h, own = np.unique(np.stack([rng.integers(0, 40, n), rng.integers(0, 40, n)]), axis=1)
    comp, part = rng.integers(0, 15, 40), rng.integers(0, 8, 40) + 100
    members = np.bincount(comp, minlength=15)
    order = rng.permutation(len(h))
    h, own = h[order], own[order]
    given = (h.astype(np.uint64), own, comp[own], members[comp[own]], part[own], np.full(len(h), 50), np.ones(len(h), np.int64))
    r, g, c, _ = similarity.overlaps(*similarity.largest_first(*given))
    asked = {(int(a), int(b)): int(x) for a, b, x in zip(r, g, c, strict=True)}
    tokens = {int(i): set(h[own == i].tolist()) for i in own}
    for a in tokens:
        for b in tokens:
            if part[a] != part[b] and comp[a] != comp[b] and (members[comp[a]], comp[a]) < (members[comp[b]], comp[b]):
                assert asked.get((a, int(part[b])), 0) >= len(tokens[a] & tokens[b])


def test_one_of_each(docs, rows, empty):
    kept = similarity.one_of_each(docs)
    got = sorted((key(r["doc_id"]), r["text"] or "") for r in kept.collect())
    grouped = {root: least for _, n, root, least in plain_roots(rows) if n}  # components are told apart by row, not by doc_id
    assert kept.columns == docs.columns
    assert sorted(i for i, t in got if t.strip()) == sorted(grouped.values())
    assert sum(not t.strip() for _, t in got) == sum(not (t or "").strip() for _, t in rows)
    assert similarity.one_of_each(empty).count() == 0 and similarity.similar(empty).count() == 0


def test_one_of_each_of_texts_under_one_id(spark):
    rng = np.random.default_rng(12)
    say = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 5000, n))
    a, b, c, d, e = (say(50) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (1, b), (2, c), (2, d), (2, d), (2, ""), (3, c + " more"), (None, None), (4, e), (5, e)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, part string")
    got = Counter((r["doc_id"], r["text"]) for r in similarity.one_of_each(docs).collect())
    assert got == Counter([(None, a), (None, b), (2, c), (2, d), (2, ""), (None, None), (4, e)])


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5100)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    out = components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()
    want = {n: root(n) for a, b in edges if a != b for n in (a, b)}
    assert {r["node"]: r["component"] for r in out} == want and len(out) == len(want)
    assert components.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "e").count() == 0


def test_alignment():
    a = np.arange(10, 30, dtype=np.uint64)
    assert decontamination.align(a, np.concatenate([a[:0] + 1, np.uint64([1, 2]), a, np.uint64([3])])) == (40, 2, 22)
    edited = np.concatenate([np.uint64([5]), a[:8], np.uint64([99]), a[9:14], a[15:]])
    score, s, e = decontamination.align(a, edited)
    assert (s, e) == (1, 20) and score == 2 * 18 - 1 - 1
    assert decontamination.align(a, np.zeros(0, np.uint64))[0] == 0

    def slow(x, y):
        h = np.zeros((len(x) + 1, len(y) + 1), int)
        for i in range(len(x)):
            for j in range(len(y)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if x[i] == y[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        return h.max()

    rng = np.random.default_rng(6)
    for _ in range(50):
        x, y = rng.integers(0, 4, 12).astype(np.uint64), rng.integers(0, 4, 20).astype(np.uint64)
        assert decontamination.align(x, y)[0] == slow(x, y)


def test_decontamination(spark, empty):
    rng = np.random.default_rng(7)
    say = lambda n: [f"w{k}" for k in rng.integers(0, 4000, n)]
    items = [say(30), say(24), say(50), ["three", "short", "words"], ["yes"]]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(8, None), (9, " ")], "item_id long, text string")
    edited = list(items[1])
    edited[5], edited[15] = "x1", "x2"
    texts = [say(80) + items[0] + say(30), say(40) + edited, say(200), items[2][:10] + say(60), [w.upper() + "," for w in items[2]], None, [], ["so"] + items[3], ["Three", "short", "WORDS."], ["yes"] + say(30)]
    docs = spark.createDataFrame([(i, None if t is None else " ".join(t), "e") for i, t in enumerate(texts)] * 2, "doc_id long, text string, item_id string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontamination.leaks(docs, bench).collect()}
    assert set(found) == {(0, 0), (1, 1), (4, 2), (8, 3)}  # items of a few words only as whole documents
    assert (found[0, 0]["score"], found[0, 0]["first_word"], found[0, 0]["end_word"]) == (1.0, 80, 110) and 0.8 < found[1, 1]["score"] < 1
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 2, 3, 3, 5, 5, 6, 6, 7, 7, 9, 9]
    assert decontamination.leaks(empty, bench).count() == 0 and decontamination.leaks(docs, bench.where("false")).count() == 0


def test_no_edited_copy_is_lost():
    rng = np.random.default_rng(9)
    lost = found = 0
    for trial in range(600):
        n = int(rng.integers(16, 21))
        item = [f"w{k}" for k in rng.integers(0, 300, n)]
        copy = []
        for k, w in enumerate(item):
            kind = rng.random() / (0.25, 0.3, 0.35)[trial % 3]
            edited = (k % 4 == 3) if trial % 10 == 0 else kind < 1
            copy += [w] if not edited else [f"x{trial}"] if trial % 10 == 0 or kind < 0.6 else [] if kind < 0.75 else [w, f"y{k}"]
        if trial % 10 == 1:  # a word put in after each
            copy = [x for w in item for x in (w, "in")]
        text = " ".join([*(f"w{k}" for k in rng.integers(0, 300, 40)), *copy, *(f"w{k}" for k in rng.integers(0, 300, 40))])
        own = decontamination.Items([0], [" ".join(item)])
        own.mark(np.arange(len(own.seeds)))
        raw = np.frombuffer(text.encode(), np.uint8)
        off = np.array([0, len(raw)])
        want = decontamination.align(own.words[0], own.hits(raw, off)[0])[0] / (2 * n)
        got = max((p[2] for p in own.passages(raw, off, 0.5)), default=0)
        if want >= 0.5:
            found, lost = found + 1, lost + (got != want)
        else:
            assert got == 0
    assert lost == 0 and found > 300


def exhaustive(docs, items, threshold=0.5):
    """Every document aligned with every item."""
    def hashed(t):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        return decontamination.words(raw, np.array([0, len(raw)]), True, decontamination._PARTS)[0]

    own, out = [(i, hashed(t)) for i, t in items], {}
    for d, t in docs:
        h = hashed(t)
        for i, w in own:
            if len(w) >= decontamination.LEAST_WORDS and len(np.intersect1d(w, h)) >= len(w) / 3:  # an alignment at half a match needs so many words in common
                score = decontamination.align(w, h)[0] / (2 * len(w))
                if score >= threshold:
                    out[d, i] = score
    return out


def test_recall_against_exhaustive_alignment(spark):
    """The whole query on the smallest tables, with edited copies of items put in: every leak is found, with its score."""
    d = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    rng = np.random.default_rng(21)
    for k in range(150):
        w = items[k % len(items)][1].split()
        for j in range(len(w)):
            x = rng.random()
            w[j] = w[j] if x > 0.3 else "" if x < 0.1 else f"e{j}" if x < 0.25 else w[j] + " put"
        docs.append((100_000 + k, " ".join([*(f"w{x}" for x in rng.integers(0, 300, 30)), *w, "end of it"])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = exhaustive(docs, items)
    assert got == want and len(want) > 100


def test_exchange_brings_buckets_together(spark):
    def emit(batches):
        for b in batches:
            v = b.column("id").to_numpy()
            yield from exchange.blobs(v % 5, 0, ["v"], v=v)

    import pyarrow as pa

    def work(_, x):
        yield pa.RecordBatch.from_pydict({"b": [int(x["v"][0]) % 5], "s": [int(x["v"].sum())], "n": [len(x["v"])]})

    rows = exchange.gather(spark.range(0, 1000, 1, 7).mapInArrow(emit, exchange.schema_of(["v"])), {"v": "<i8"}, work, "b long, s long, n long").collect()
    assert {r["b"]: (r["s"], r["n"]) for r in rows} == {k: (sum(range(k, 1000, 5)), 200) for k in range(5)}


def test_coded_values():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (700, 300), (90_000, 80_000)):
        x = rng.integers(0, top, n).astype(np.uint64) * np.uint64(1 << 40)
        assert (exchange.unpacked(exchange.coded(x), exchange.CODED) == x).all()


def test_pipeline(spark):
    import public_tokenizers

    import corpus_pipeline
    from gapwright.llm import packing, pii, quality_model

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    step, sizes = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = spark.createDataFrame(stage(spark, step, d).toPandas(), docs.schema)
        assert step.columns == docs.columns
        sizes.append(step.count())
    assert docs.count() > sizes[0] > sizes[1] > sizes[2] == sizes[3]
    assert len(corpus_pipeline.STAGES) == 5
    texts = step.toPandas()
    assert (texts["n_chars"] == texts["text"].str.len()).all() and not any(pii.base_spans(t) for t in texts["text"])
    rest = [(r["doc_id"], r["text"]) for r in quality_model.keep_good(docs, spark.read.parquet(f"{d}/labels.parquet")).collect()]
    assert sizes[1] == len({root for _, _, root, _ in plain_roots(rest)})
    out, want = corpus_pipeline.run(spark, d), packing.pack(step, public_tokenizers.path("byte_bpe_50k.json"))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, out.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_every_stage_on_odd_rows(spark, docs, empty):
    """Null and repeated doc_ids, null and empty texts, repeated rows, clashing columns, and an empty table: through all stages."""
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, step, d)
        assert out.columns == docs.columns, name
        kept = out.collect()
        before = Counter((key(r["doc_id"]), r["text"]) for r in step.collect())
        if name != "pii":  # rows are only dropped, as many times as they were there at most
            assert not Counter((key(r["doc_id"]), r["text"]) for r in kept) - before
        step = spark.createDataFrame(kept, docs.schema)
        assert stage(spark, empty, d).count() == 0
    assert 0 < step.count() < docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, step, d)
    assert pieces.where("piece = 0").count() == step.count() and corpus_pipeline.STAGES[-1][1](spark, empty, d).count() == 0
