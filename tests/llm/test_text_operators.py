"""Operators that look at each text alone."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gapwright.llm import bpe, chat, packing, pii, quality_model, quality_rules, token_shards

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["a  b\n c   \n\nd ", " 　x\n  ý İz ΣΑΣ!! <|endoftext|> a\xa0 b", "", "it's 'tis don't, we'll 5 10. a.b,c", "é \U0001f600ok", "\x1c a\x1fb", "ÉÀÇ Straße, ÑANDÚ!!"]


def library(path):
    return Tokenizer.from_file(path)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_memo_gives_the_librarys_ids(path, rows):
    enc, plain = bpe.Encoder(path), library(path)
    assert enc.kind == {BYTE: "space", WORD: "drop"}[path]
    texts = ODD + [t or "" for _, t in rows]
    rng = random.Random(4)
    some = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", " ", "  ", "\n", "a", "It's", "É", "7", "."]
    texts += ["".join(rng.choice(some) for _ in range(rng.randrange(9))) for _ in range(600)]
    odd = [" ", " ", "\n", "\t", "\r\n", ".", ",", "?", "!", "a", "Be", "é", "7", "'s", "'", '"', "\xa0", "\u2003", "\u2028", "\u200b", "“", "Σ", "\u0301", "-", "\x1c", "\x00", "<|endoftext|>"]
    texts += ["".join(rng.choice(odd[: 15 if i % 2 else None]) for _ in range(rng.randrange(14))) for i in range(12_000)]
    for _ in range(2):  # from the library, then from the memo
        got = enc.encode([t.encode() for t in texts])
        for t, g in zip(texts, got, strict=True):
            assert np.frombuffer(g, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_unknown_splits_are_left_to_the_library(tmp_path):
    spec = json.load(open(BYTE, encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    path = str(tmp_path / "other.json")
    json.dump(spec, open(path, "w", encoding="utf-8"))
    texts = ["one two", "", " x"]
    assert bpe.Encoder(path).kind == "whole"
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.Encoder(path).encode([t.encode() for t in texts])] == [library(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_plan_is_dense():
    rng = np.random.default_rng(1)
    for _ in range(20):
        counts = Counter(int(x) for x in rng.integers(1, 65, rng.integers(1, 300)))
        bins: dict[int, list[tuple[int, int]]] = {}
        placed = Counter()
        for length, first, n, seq, off in packing.plan(dict(counts), 64):
            assert placed[length] == first
            placed[length] += n
            for k in range(n):
                bins.setdefault(seq + k, []).append((off, length))
        assert placed == counts
        for own in bins.values():
            own.sort()
            assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[-1][0] + own[-1][1] <= 64
        total = sum(k * v for k, v in counts.items())
        assert len(bins) <= max(-(-total // 64) * 1.25 + 1, sum(v for k, v in counts.items() if k > 32))


def plain_packing(lengths, capacity):
    """The method on a list of items: large ones, longest first, with the longest other large one that fits; the rest,
    longest first, into the smallest gap."""
    large, small = sorted(x for x in lengths if 3 * x > capacity), sorted((x for x in lengths if 3 * x <= capacity), reverse=True)
    gaps = []
    while large:
        top = large.pop()
        mate = max((x for x in large if x + top <= capacity), default=None)
        if mate is not None:
            large.remove(mate)
        gaps.append(capacity - top - (mate or 0))
    for x in small:
        best = min((g for g in gaps if g >= x), default=None)
        if best is None:
            gaps.append(capacity - x)
        else:
            gaps.remove(best)
            gaps.append(best - x)
    return len(gaps)


def test_packing_needs_as_few_sequences_as_item_by_item():
    rng = np.random.default_rng(8)
    for _ in range(150):
        lengths = [int(x) for x in rng.integers(1, 65, rng.integers(1, 120))]
        found = {seq + k for _, _, n, seq, _ in packing.plan(dict(Counter(lengths)), 64) for k in range(n)}
        assert len(found) == plain_packing(lengths, 64) or len(found) <= plain_packing(lengths, 64)


def test_packing(spark, docs, rows, empty):
    out = packing.pack(docs, BYTE, 0, 256).toPandas()
    plain = library(BYTE)
    want = Counter((i, len(plain.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows)
    out["doc"] = out["doc_id"].astype("object").where(out["doc_id"].notna(), None)
    assert out["length"].sum() == sum(n * c for (_, n), c in want.items())
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == np.concatenate(([0], np.cumsum(g["length"])[:-1])).tolist() and g["length"].sum() <= 256
    one = next(i for i, t in rows if t and len(t) > 15000)
    long = out[out["doc_id"] == one].sort_values("piece")
    assert set(long["length"].iloc[1:]) == {256}
    ids = plain.encode(dict(rows)[one], add_special_tokens=False).ids + [0]
    assert [zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) for s, n in zip(long["start"], long["length"])] == long["ids_crc32"].tolist()
    assert packing.pack(empty, BYTE, 0, 256).count() == 0


def test_shard_round_trip():
    w = token_shards.ShardWriter()
    keys = [None, -5, 0, 0, 1, 7, 7, *range(100, 4000, 3)]
    ids = [np.array([abs(k or 0), 70000 if i % 50 == 0 else i], "<u4") if i % 7 else np.zeros(0, "<u4") for i, k in enumerate(keys)]
    for k, x in zip(keys, ids, strict=True):
        w.add(token_shards.encode_key(k), x)
    with pytest.raises(ValueError):
        w.add(token_shards.encode_key(3), ids[0])
    shard = token_shards.Shard(w.bytes())
    back = list(shard)
    assert [token_shards.decode_key(k) for k, _, _ in back] == keys and all((a == b).all() for (_, _, a), b in zip(back, ids, strict=True))
    assert len(shard.get(0)) == 2 and len(shard.get(None)) == 1 and shard.get(-7) == [] and (shard.get(103)[0] == ids[keys.index(103)]).all()
    assert sum(shard.may_hold(token_shards.encode_key(k)) for k in range(10**6, 10**6 + 2000)) < 100
    with pytest.raises(ValueError):
        token_shards.Shard(b"nothing here" * 10)


def test_token_shards(spark, docs, rows, empty):
    out = token_shards.token_shards(docs, WORD, 2, rows_per_shard=8).toPandas()
    plain = library(WORD)
    want = sorted(((-1 if i is None else i), len(x) + 1, zlib.crc32(np.array(x + [2], "<u4").tobytes())) for i, t in rows for x in [plain.encode(t or "", add_special_tokens=False).ids])
    got = sorted(zip(out["doc_id"].fillna(-1).astype(int), out["n_tokens"], out["ids_crc32"]))
    assert got == want
    out = out.sort_values("start")
    assert out["start"].tolist() == np.concatenate(([0], np.cumsum(out["n_tokens"])[:-1])).tolist()
    assert out["doc_id"].fillna(-1).is_monotonic_increasing
    assert token_shards.token_shards(empty, WORD, 2).count() == 0


def test_one_doc_id_on_many_rows(spark, monkeypatch):
    """Rows of one identifier (and of none) are split over shards, closed at SHARD_BYTES; order and starts stay whole."""
    monkeypatch.setattr(token_shards, "SHARD_BYTES", 1 << 12)
    rows = [(7, f"text number {i} " * (1 + i % 5)) for i in range(300)] + [(None, f"none {i}") for i in range(200)] + [(i, f"other {i}") for i in range(100)] + [(7, "text number 1 " * 2)] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = token_shards.token_shards(df, WORD, 2, rows_per_shard=16).toPandas().sort_values("start")
    plain = library(WORD)
    want = Counter((-1 if i is None else i, zlib.crc32(np.array(plain.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes())) for i, t in rows)
    assert Counter(zip(out["doc_id"].fillna(-1).astype(int), out["ids_crc32"])) == want
    assert out["start"].tolist() == np.concatenate(([0], np.cumsum(out["n_tokens"])[:-1])).tolist()
    assert out["doc_id"].fillna(-1).is_monotonic_increasing and out[out["doc_id"] == 7]["shard"].nunique() > 5 and out[out["doc_id"].isna()]["shard"].nunique() > 5


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(t):
    def ok(k, m):
        digits = re.sub("[^0-9]", "", m)
        if k == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if k == "card":
            two = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
            return 13 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in two) % 10 == 0
        return k == "email" or 9 <= len(digits) <= 15

    return [(pii.KINDS.index(k), m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t) if ok(k, m[0])]


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for i in range(8000):
        t = "".join(rng.choice("aZ0.1@ -+()259%é\n") for _ in range(rng.randrange(50)))
        t = re.sub("[é@]", "4", t) if i % 3 == 0 else t
        assert pii.base_spans(t) == plain_spans(t), t
    assert pii.base_spans("9" * 20000) == []


def test_pii(spark, empty):
    texts = ["mail jo.doe@mail.example.com or call +1 (499) 555-6503 é", "card 4111 1111 1111 1111, host 10.0.0.256 and 10.0.0.25", 'token = "1eb9c654e721b4f812088970e66a6345cee33dd6" ok', None, "", "plain words only, 12 of them", "call me: tel 415-555-2671 now", "x@y", "ä" * 10 + " a@b.cd"]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] * 2, "doc_id long, text string, kind string")
    out = pii.digests(pii.find_pii(docs)).toPandas()
    assert len(out) == 2 * len(texts)
    for _, r in out.iterrows():
        t = texts[r["doc_id"]] or ""
        base = plain_spans(t)
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(b[0] == i for b in base) for i in range(4)]
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert {f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base} <= set(r["spans"].split(","))
        assert (not spans) == (r["doc_id"] in (3, 4, 5, 7))
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[0] == "mail [EMAIL] or call [PHONE] é" and clean[2] == 'token = "[SECRET]" ok' and clean[3] is None and clean[5] == texts[5] and clean[6] == "call me: tel [TEL] now"
    assert pii.redact(docs).columns == docs.columns and pii.find_pii(empty).count() == 0


def test_the_span_classifier_uses_what_no_labeler_votes_on():
    """One kind, two groups of spans with the same votes: where most of a shape's spans have clear votes, it decides."""
    k, yes, no = pii.KINDS.index("secret"), (2, 2, 2, 2), (2, 0, 0, 1)
    shape = {True: (1, 0, 1, 1, 1, 0, 0), False: (0, 1, 0, 0, 0, 0, 1)}
    unsure = (2, 0, 0, 0)
    rows = [(yes, True, 900), (unsure, True, 60), (no, False, 900), (unsure, False, 60)]
    pattern = np.array([pii._pattern((*v, *shape[s])) for v, s, _ in rows])
    p = pii.train(np.full(4, k), pattern, np.array([n for _, _, n in rows]))
    got = [p[k, int(x)] for x in pattern]
    assert got[0] > 0.8 and got[1] > 5 * got[3] and got[2] < 0.3
    assert all(pii._pattern(pii._unpattern(int(x))) == x for x in pattern)


def test_context_and_gazetteer_vote_apart():
    def vote(text, kind, span):
        at = text.index(span)
        return dict(zip(pii.LABELERS, pii.votes(text, pii.KINDS.index(kind), at, at + len(span)), strict=False))

    assert vote("call me: tel 415-555-2671 now", "tel", "415-555-2671")["context"] == 2
    assert vote("the number 415-555-2671 of things", "tel", "415-555-2671")["context"] == 0
    assert vote("visa card 415-555-2671", "tel", "415-555-2671")["context"] == 1
    assert vote("x jo@site.org y", "email", "jo@site.org")["gazetteer"] == 2 and vote("x jo@site.zzq y", "email", "jo@site.zzq")["gazetteer"] == 1
    assert vote("415-555-2671 is my phone", "tel", "415-555-2671")["context"] == 2


def test_em_finds_the_unreliable_labeler():
    rng = np.random.default_rng(0)
    truth = rng.random(5000) < 0.6
    vote = np.stack([np.where(rng.random(5000) < acc, truth, ~truth) + 1 for acc in (0.95, 0.9, 0.85, 0.5)], 1)
    rows, n = np.unique(vote, axis=0, return_counts=True)
    post, odds, _ = pii.em(np.zeros(len(rows), int), rows, n.astype(float))
    weight = odds[0, :, 2] - odds[0, :, 1]
    assert weight[0] > weight[2] > weight[3] and abs(weight[3]) < 0.4
    found = {tuple(r): p for r, p in zip(rows, post, strict=True)}
    assert np.mean([(found[tuple(v)] > 0.5) == t for v, t in zip(vote, truth, strict=True)]) > 0.95


def test_rule_column_equals_the_model(spark, docs, empty):
    rng = np.random.default_rng(2)
    x = rng.random((3000, len(quality_model.STATS)))
    y = ((x[:, 3] > 0.3) & (x[:, 9] < 0.7)).astype(float)
    model = quality_model.fit(x[:2000], y[:2000])
    assert 0 < len(model.rules) < 200
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.97
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[2000:2100]], ", ".join(f"{quality_model._S}{s} double" for s in quality_model.STATS))
    assert np.allclose([r[0] for r in df.select(model.column()).collect()], model.score(x[2000:2100]))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_model.classify(docs, none).where("score > 0.9").count() == docs.count()
    assert quality_model.classify(empty, none).count() == 0


def test_quality_classifier_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality_model.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(out) > 40 and (out["predicted"] == out["quality"]).mean() >= 0.95
    kept = quality_model.keep_good(docs, labels)
    assert kept.columns == docs.columns and 0.8 < kept.count() / docs.count() < 0.95


def plain_stats(t):
    """The statistics from their names, over words and lines of the text."""
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return (0.0,) * len(quality_model.STATS)
    n, size = len(w), lambda x: len(x.encode())
    ink, c = sum(map(size, w)), Counter(w)
    threes = Counter(zip(w, w[1:], w[2:]))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    share = lambda pattern: len(re.findall(pattern, t)) / ink
    title = sum(x.encode().istitle() for x in w)
    return (
        n, ink / n, max(map(size, w)), len(c) / n, max(c.values()) / n, sum(a == b for a, b in zip(w, w[1:])) / n, sum(v for v in threes.values() if v > 1) / n,
        share("[A-Z]"), share("[0-9]"), share(r"[#*$%&<>@^~_=+\\/{}\[\]]"), share("!"), t.count("|") / n, t.count(".") / n, t.count(",") / n, n / max(1, len(lines)),
        (len(lines) - len(set(lines))) / max(1, len(lines)), sum(size(x) for x in t if ord(x) > 127) / ink, title / n, sum(v for x, v in c.items() if size(x) <= 3) / n,
    )


def test_text_stats(rows):
    for t in [t for _, t in rows] + ODD[:1] + ["A!B #x\n#x\n#x |,.\n\n é_é Éa 12"]:
        if not re.search("[\x1c-\x1f\x85\xa0\u2000-\u3000]", t or ""):
            assert np.allclose(quality_model.text_stats((t or "").encode()), plain_stats(t)), t


def test_trees_find_the_best_cut():
    """The first split is the one with the most gain, by brute force; rules hold for the rows of their nodes."""
    rng = np.random.default_rng(12)
    x = rng.random((400, len(quality_model.STATS))).round(2)
    y = (x[:, 2] > 0.62).astype(float)
    rules = quality_model.Trees(depth=1, trees=4).rules(x, y)  # each tree sees two thirds of the statistics
    assert {r[0][2] for r in rules if r[0][0] == 2} == {True, False}
    cut = next(r[0][1] for r in rules if r[0][0] == 2)
    edges = quality_model._edges(x)[2]
    purity = lambda c: sum(abs(part.mean() - 0.5) * len(part) for part in (y[x[:, 2] <= c], y[x[:, 2] > c]) if len(part))
    assert purity(cut) == max(map(purity, edges))
    assert (quality_model.holds(((2, 0.3, True), (2, 0.6, False)), x) == ((x[:, 2] > 0.3) & (x[:, 2] <= 0.6))).all()


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.default_rng(13)
    m = (rng.random((800, 12)) < 0.4).astype(np.float32)
    y = (rng.random(800) < 1 / (1 + np.exp(-(2 * m[:, 0] - 2 * m[:, 1])))).astype(float)
    w, b = quality_model.lasso(m, y, penalty=0.02, rounds=3000)
    scale = m.std(0) + 1e-6
    grad = (m / scale).T @ (1 / (1 + np.exp(-(m @ w + b))) - y) / len(y)
    on = np.abs(w) > 1e-6
    assert np.allclose(grad[on], -0.02 * np.sign(w[on]), atol=1e-3) and (np.abs(grad[~on]) <= 0.021).all() and on[:2].all() and not on[2:].all()


def test_labels_that_tie_repeat_or_clash(spark, docs):
    """Ties of a document's labels count as 1, repeated label rows as their majority; clashing columns are carried."""
    own = docs.withColumn("_label_of", F.lit("x")).withColumn("s_n_words", F.lit("y"))
    labels = spark.createDataFrame([(i, q) for i in range(0, 100) for q in ((0, 1) if i % 2 else (0, 0, 1))] + [(None, 1), (3, None)], "doc_id long, quality int")
    kept = quality_model.keep_good(own, labels, 0.0)
    assert kept.columns == own.columns and kept.count() == own.count()
    one = quality_model.classify(own, labels.where("doc_id % 2 = 1"))
    assert one.where("score < 0.9").count() == 0 and one.where("doc_id is null and not held_out").count() == 0
    assert quality_model.keep_good(own, labels.where("doc_id % 2 = 0"), 0.3).count() == 0


def plain_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(g)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len({j for i, x in enumerate(g) if c[x] > 1 for j in (i, i + 1, i + 2)})


def test_quality_rules(spark, docs, rows, empty):
    more = spark.createDataFrame([(500, "a\x0bb\x0cc\td #$%\n\nx\nx\n x\nfff ff\x1cg"), (501, "l1 a b c\nl1 a b c\nl1 a b c")], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string")})
    both = docs.select("doc_id", "text", "lang", "source").unionByName(more)
    out = quality_rules.quality_rules(both).toPandas()
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = Counter((None if i != i else int(i), *map(int, r)) for i, r in zip(out["doc_id"], out[cols].to_numpy()))
    texts = rows + [(r["doc_id"], r["text"]) for r in more.collect()]
    assert got == Counter((i, *plain_counts(t)) for i, t in texts)
    failed = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    assert (out["base_failed"] == failed).all() and not (out["kept"] & failed).any()
    assert quality_rules.quality_rules(empty).count() == 0


def plain_fences(stats, name, least, lower):
    """From the blend's buckets, in plain Python: {(lang, source): (low, high)}."""
    import math

    bucket = lambda x: math.ceil(math.log(x) / math.log(quality_rules.GAMMA)) if x > 0 else None
    whole = Counter(bucket(r[name]) for r in stats)
    groups: dict = {}
    for r in stats:
        groups.setdefault((r["lang"], r["source"]), Counter())[bucket(r[name])] += 1
    out = {}
    for g, own in groups.items():
        n = Counter({k: own[k] * len(stats) + quality_rules.PRIOR * whole[k] for k in whole})
        total, q = sum(n.values()), []
        for p in (100, 500, 900):
            at = 0
            for k in sorted(n, key=lambda k: (k is not None, k or 0)):
                at += n[k]
                if at * 1000 >= total * p:
                    q.append(0.0 if k is None else quality_rules.GAMMA**k)
                    break
        out[g] = (min(q[0] - 2 * (q[1] - q[0]), q[1] - least) if lower else -1.0, max(q[2] + 2 * (q[2] - q[1]), q[1] + least))
    return out


def test_kept_by_plain_fences(spark):
    """The verdicts, from counts and fences in plain Python; groups of few and of many documents, null ones too."""
    rng = random.Random(9)
    texts = []
    for i in range(260):
        n = rng.choice((20, 60, 90, 140))
        t = " ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(2, 5 + i % 7))) for _ in range(n))
        texts.append((i, t + (" #%&" * rng.randrange(9) if i % 6 == 0 else "") + ("\nagain\nagain" if i % 9 == 0 else ""), ("en", "de", None)[i % 3], f"s{min(i % 5, 1)}" if i % 4 else None))
    texts += [(900, None, "en", "s1"), (900, None, "en", "s1"), (901, "", "xx", "alone")]
    df = spark.createDataFrame([(*t, "z") for t in texts], "doc_id long, text string, lang string, source string, words string")
    stats = []
    for i, t, lang, source in texts:
        n, chars, symbols, dup, rep = plain_counts(t)
        shares = (chars / n if n else 0.0, symbols / chars if chars else 0.0, dup / n if n else 0.0, rep / n if n else 0.0)
        stats.append({"id": i, "lang": lang, "source": source, "failed": n < 50 or 100 * rep > 50 * n, **dict(zip(quality_rules.METRICS, shares, strict=True))})
    fences = {k: plain_fences(stats, k, least, lower) for k, (_, least, lower) in quality_rules.METRICS.items()}
    want = Counter((r["id"], not r["failed"] and all(fences[k][r["lang"], r["source"]][0] <= r[k] <= fences[k][r["lang"], r["source"]][1] for k in fences)) for r in stats)
    got = Counter((r["doc_id"], r["kept"]) for r in quality_rules.quality_rules(df).collect())
    assert got == want and 20 < sum(v for (_, k), v in got.items() if k) < 220
    assert len({f[1] for f in fences["word_length"].values()}) >= 3


def test_very_long_text(spark):
    rng = random.Random(2)
    t = " ".join(f"w{rng.randrange(400)}" for _ in range(60_000))
    row = quality_rules.statistics(spark.createDataFrame([(1, t)], "doc_id long, text string"), "doc_id").first()
    assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == plain_counts(t) and row["n_repeat_words"] > 100


def test_sketches_merge(spark):
    """Sketches of parts, added, are the sketch of all."""
    stats = spark.range(3000).select(F.lit("en").alias("lang"), F.lit("s").alias("source"), (F.col("id") % 3).alias("part"), *[(F.col("id") % 97 / 10).alias(m) for m in quality_rules.METRICS])
    key = ["lang", "source", "metric", "bucket"]
    parts = quality_rules.sketches(stats.where("part = 0")).union(quality_rules.sketches(stats.where("part = 1"))).union(quality_rules.sketches(stats.where("part = 2")))
    merged = parts.groupBy(key).agg(F.sum("n").alias("n"))
    assert Counter(map(tuple, merged.collect())) == Counter(map(tuple, quality_rules.sketches(stats).select(*key, "n").collect()))


def test_quantiles_from_sketches_are_near(spark):
    stats = spark.range(4000).select(F.lit("en").alias("lang"), F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("source"), *[(F.col("id") / 1000 + 1).alias(m) for m in quality_rules.METRICS])
    q = {r["source"]: r for r in quality_rules.quantiles(quality_rules.sketches(stats), "lang", "source", shares=(0.25, 0.75)).where("metric = 'word_length'").collect()}
    whole = quality_rules.quantiles(quality_rules.sketches(stats), shares=(0.25, 0.75)).where("metric = 'word_length'").first()
    for r in (*q.values(), whole):
        assert abs(r["q0"] / 2 - 1) < 0.025 and abs(r["q1"] / 4 - 1) < 0.025


def test_chat(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    turns = [(1, 0, "user", said), (1, 1, "assistant", "&amp; &lt;| <| & é\n"), (2, 0, "assistant", "x"), (3, 1, "user", None), (3, 0, "system", "s"), (3, 2, None, "t"), (4, 5, "us\ner&nl;", "<"), (4, 5, "us\ner&nl;", "<"), (None, None, "user", "q"), (None, 1, "assistant", "")]
    df = spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn long, role string, text string, turns string")
    out = chat.format_conversations(df)
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["t"]] for r in out.select("conv_id", chat.parse(F.col("formatted")).alias("t")).collect()}
    want: dict = {}
    for c, _, r, t in sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        want.setdefault(c, []).append((r or "", t or ""))
    assert back == want
    rows = {r["conv_id"]: r for r in out.collect()}
    assert [rows[k]["valid"] for k in (1, 2, 3, 4)] == [True, False, False, False] and rows[None]["valid"] and rows[2]["bad_turn"] == 0 and rows[3]["bad_turn"] == 2
    for r in chat.digests(out).collect():
        loss = "".join(t for role, t in want[r["conv_id"]] if role == "assistant")
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and r["n_turns"] == len(want[r["conv_id"]])
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want[r["conv_id"]]).encode()).hexdigest()
        assert r["formatted_chars"] == len("".join(s["text"] for s in rows[r["conv_id"]]["segments"]))
    assert chat.format_conversations(df.where("false")).count() == 0


def test_very_long_conversation(spark):
    turns = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k} <|im_end|> & " * (2000 if k == 7 else 1)) for k in range(3000)]
    out = chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    r = chat.digests(out).first()
    assert r["n_turns"] == 3000 and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, _, a, b in turns).encode()).hexdigest()
    assert r["loss_chars"] == sum(len(t) for _, _, a, t in turns if a == "assistant") and out.first()["valid"]
