r"""Personal data: weak supervision over span candidates.

Four kinds have fixed patterns and are always found (`BASE`). Further kinds are candidates: regex,
gazetteer and context labelers (and checksums) vote on every candidate: the strict form of the kind, known
beginnings and endings, and words around the span. Expectation-maximisation estimates each labeler's reliability per
kind from how votes agree, and a logistic span classifier is trained on the posteriors. Beside the votes it sees
statistics of the span and its surroundings that no labeler votes on (`SHAPES`), kind by kind, so it can overrule
them. The candidates that it accepts are added.

Only counts of distinct (kind, votes, features) reach the driver: at most
`len(KINDS) * 3**len(LABELERS) * 2**len(SHAPES)` rows, whatever the size of the corpus.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, binary

BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "mailbox", "secret", "ssn", "tel")
KINDS = BASE + EXTRA
LABELERS = ("regex", "gazetteer", "context", "checksum")
SHAPES = ("long", "digits", "mixed", "bounded", "assigned", "parted", "varied")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

_MORE = {
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "secret": re.compile(r"(?<![A-Za-z0-9])(?:(?:sk|pk|ghp|xox[bp])[_-][A-Za-z0-9_-]{16,}|AKIA[A-Z0-9]{16}|[0-9a-f]{32,64})(?![A-Za-z0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "tel": re.compile(r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"),
}
_BOX = re.compile(r"[A-Za-z0-9._%+-]+\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]+(?:\x20?(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z0-9-]+)+", re.I)

#: Words before or just after a candidate (fixed values).
_CUES = {
    "email": {"email", "e-mail", "mail", "contact", "correo", "courriel", "kontakt"},
    "mailbox": {"email", "e-mail", "mail", "contact", "write", "reach"},
    "ip": {"ip", "host", "server", "address", "addr", "from", "adresse"},
    "card": {"card", "visa", "credit", "mastercard", "amex", "payment", "carte", "tarjeta", "karte"},
    "phone": {"phone", "tel", "call", "mobile", "cell", "fax", "telefon", "telefono", "contact"},
    "tel": {"phone", "tel", "call", "mobile", "cell", "fax", "telefon", "telefono", "contact"},
    "iban": {"iban", "account", "bank", "konto", "cuenta", "compte"},
    "ssn": {"ssn", "social", "security"},
    "secret": {"token", "key", "api_key", "apikey", "secret", "password", "passwd", "bearer", "access_key"},
}
#: Endings and beginnings that real ones have (fixed values).
_TAILS = {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "us", "ch"}
_BEGINNINGS = ("sk", "pk", "ghp", "xox", "AKIA")
_COUNTRIES = {"AT", "BE", "CH", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE"}
_WORDS = re.compile(r"[A-Za-z_-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the fixed pattern: from each @ back over the local part, then on over the domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > done and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            yield s, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            done = max(done, at + 1)
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind and start; matches that fail their test are dropped."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            if 13 <= m.end() - m.start() <= 37:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def extra_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of the further kinds that touch no base span, nor an earlier candidate."""
    found = []
    if _DIGIT.search(text):
        for k, name in enumerate(EXTRA, len(BASE)):
            if name in _MORE:
                found += [(k, m.start(), m.end()) for m in _MORE[name].finditer(text)]
    low = text.lower() if "(" in text or "[" in text else ""
    if "[at]" in low or "(at)" in low:
        found += [(len(BASE) + EXTRA.index("mailbox"), m.start(), m.end()) for m in _BOX.finditer(text)]
    if not found:
        return found
    taken = sorted((s, e) for _, s, e in base)
    out, at, done = [], 0, 0
    for k, s, e in sorted(found, key=lambda x: (x[1], -x[2])):
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if s >= done and not (at < len(taken) and taken[at][0] < e):
            out.append((k, s, e))
            done = e
    return out


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def votes(text: str, k: int, s: int, e: int) -> tuple[int, ...]:
    """Each labeler's vote: 2 yes, 1 no, 0 none; then the shape bits."""
    kind, span = KINDS[k], text[s:e]
    strict = {"email": len(span) <= 100 and ".." not in span, "ip": span.count(".") == 3, "card": len(span) >= 15, "phone": len(span) <= 22}
    regex = 2 if strict.get(kind, True) else 1
    gazetteer = 0
    if kind in ("email", "mailbox"):
        gazetteer = 2 if re.split(r"[^A-Za-z]+", span)[-1].lower() in _TAILS else 1
    elif kind == "iban":
        gazetteer = 2 if span[:2] in _COUNTRIES else 1
    elif kind == "secret" and span.startswith(_BEGINNINGS):
        gazetteer = 2
    elif kind == "card":
        gazetteer = 2 if span[0] in "3456" else 1
    elif kind == "ip":
        gazetteer = 1 if span.split(".")[0].lstrip("0") in ("", "127", "255") else 2
    cue = {w.lower() for w in _WORDS.findall(text[max(0, s - 40) : s])[-4:] + _WORDS.findall(text[e : e + 24])[:3]}
    context = 2 if cue & _CUES[kind] else 1 if any(cue & own for k, own in _CUES.items() if not own & _CUES[kind]) else 0
    checksum = 0
    digits = "".join(c for c in span if "0" <= c <= "9")
    if kind == "card":
        checksum = 2 if luhn(digits) else 1
    elif kind == "iban":
        checksum = 2 if _mod97(span) else 1
    elif kind == "ssn":
        checksum = 1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 2
    elif kind == "tel":
        checksum = 1 if digits[0] in "01" or digits[3] in "01" else 2
    elif kind == "ip":
        checksum = 2 if all(int(p) <= 255 for p in span.split(".")) else 1
    elif kind == "secret":
        checksum = 2 if len(set(span)) >= 10 else 1
    letters = sum(c.isalpha() for c in span)
    before, after = text[s - 1 : s], text[e : e + 1]
    shape = (
        len(span) > 24, 2 * len(digits) > len(span), bool(letters and digits), not (before.isalnum() or after.isalnum()),
        text[max(0, s - 2) : s].strip(" \"'")[-1:] in (":", "="), any(c in " -" for c in span), 2 * len(set(span)) > len(span),
    )
    return (regex, gazetteer, context, checksum, *map(int, shape))


SPAN = "struct<kind:int,start:int,end:int,pattern:int>"
FOUND = f"doc_id long, spans array<{SPAN}>"


def _pattern(v: tuple[int, ...]) -> int:
    n = 0
    for x in v[:4]:
        n = n * 3 + x
    for x in v[4:]:
        n = n * 2 + x
    return n


def _unpattern(n: int) -> tuple[int, ...]:
    out = []
    for base in (2,) * len(SHAPES) + (3,) * len(LABELERS):
        out.append(n % base)
        n //= base
    return tuple(reversed(out))


def candidates(docs: DataFrame) -> DataFrame:
    """One row per document: its base spans and the further candidates, with votes packed in a number."""

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.int32())]))
        for b in batches:
            rows = []
            for t in binary(b.column("text")):
                t = str(t.as_buffer(), "utf-8")
                base = base_spans(t)
                rows.append([(k, s, e, _pattern(votes(t, k, s, e))) for k, s, e in base + extra_spans(t, base)])
            spans = pa.array([[dict(zip(("kind", "start", "end", "pattern"), x, strict=True)) for x in r] for r in rows], kind)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), spans], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)


def em(kind: np.ndarray, vote: np.ndarray, n: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dawid and Skene's estimate per kind, from counts of vote patterns.

    Returns the posterior of each pattern, and each labeler's log odds of a yes and of a no by kind.
    """
    post = np.clip(0.5 + 0.2 * (vote == 2).sum(1) - 0.3 * (vote == 1).sum(1), 0.02, 0.98)
    kinds, labelers = len(KINDS), vote.shape[1]
    odds = np.zeros((kinds, labelers, 3))
    prior = np.zeros(kinds)
    for _ in range(rounds):
        for k in range(kinds):
            own = kind == k
            w1, w0 = n[own] * post[own], n[own] * (1 - post[own])
            prior[k] = np.log((w1.sum() + 2) / (w0.sum() + 1))
            for j in range(labelers):
                for v in range(3):
                    hit = vote[own, j] == v
                    # pseudo-counts: a labeler is right more often than not until data says otherwise
                    a = (w1[hit].sum() + (4, 1, 4)[v]) / (w1.sum() + 9)
                    b = (w0[hit].sum() + (4, 4, 1)[v]) / (w0.sum() + 9)
                    odds[k, j, v] = np.log(a / b)
        score = prior[kind] + sum(odds[kind, j, vote[:, j]] for j in range(labelers))
        post = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return post, odds, prior


def _features(kind: np.ndarray, bits: np.ndarray) -> np.ndarray:
    one = [np.ones(len(kind)), *[(kind == k).astype(float) for k in range(len(KINDS))]]
    one += [(bits[:, j] == v).astype(float) for j in range(len(LABELERS)) for v in (1, 2)]
    shapes = [bits[:, len(LABELERS) + j].astype(float) for j in range(len(SHAPES))]
    return np.stack(one + shapes + [(kind == k) * x for k in range(len(KINDS)) for x in shapes], 1)


def train(kind: np.ndarray, pattern: np.ndarray, n: np.ndarray, rounds: int = 1000) -> dict[tuple[int, int], float]:
    """Probability of every seen (kind, pattern): logistic regression on the posteriors, weighted by count."""
    if not len(kind):
        return {}
    bits = np.array([_unpattern(int(p)) for p in pattern])
    soft, _, _ = em(kind, bits[:, :4], n)
    x, weight = _features(kind, bits), np.sqrt(n) / np.sqrt(n).sum()
    w = np.zeros(x.shape[1])
    step = 4 / max(1.0, float((weight * (x * x).sum(1)).sum()))  # the loss bends no more than a quarter of this
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= step * (x.T @ (weight * (p - soft)) + 1e-4 * w)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return {(int(k), int(q)): float(v) for k, q, v in zip(kind, pattern, p, strict=True)}


def find_pii(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: (doc_id, spans), accepted spans in order of kind and start, base ones always.

    Offsets are code points, ends exclusive. Null or empty text: no spans. Repeated rows stay. An empty
    table gives no rows. Other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "op1")
    found = scratch.save(candidates(docs), "found")
    rows = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "pattern").collect()
    p = train(*(np.array([r[c] for r in rows], np.int64) for c in ("kind", "pattern", "n")))
    accepted = {k for k, v in p.items() if v >= threshold}
    sql_keep = " or ".join(
        [f"x.kind < {len(BASE)}", *(f"(x.kind = {k} and x.pattern in ({', '.join(map(str, own))}))" for k in range(len(BASE), len(KINDS)) if (own := sorted(q for kk, q in accepted if kk == k)))]
    )
    return found.select("doc_id", F.expr(f"array_sort(filter(spans, x -> {sql_keep}))").alias("spans"))


def redact(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs with every found span replaced by [KIND]; all other columns as they were.

    Rows are told apart by their place, not by doc_id, so repeated and null identifiers are safe. A null text stays
    null, an empty one empty; very long texts are worked on whole; an empty table has no rows. The corpus is scanned
    twice: for the counts of vote patterns, and to replace what the trained classifier accepts.
    """
    found = candidates(docs)
    rows = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "pattern").collect()
    p = train(*(np.array([r[c] for r in rows], np.int64) for c in ("kind", "pattern", "n")))
    accepted = {k for k, v in p.items() if v >= threshold}
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields])
    column = docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts = []
            for t, null in zip(binary(b.column(column)), b.column(column).is_null(), strict=True):
                if null.as_py():
                    texts.append(None)
                    continue
                t = str(t.as_buffer(), "utf-8")
                base = base_spans(t)
                spans = base + [(k, s, e) for k, s, e in extra_spans(t, base) if (k, _pattern(votes(t, k, s, e))) in accepted]
                out, at = [], 0
                for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
                    if s >= at:
                        out += [t[at:s], f"[{KINDS[k].upper()}]"]
                    at = max(at, e)
                texts.append("".join(out) + t[at:])
            cols = list(b.columns)
            cols[column] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return docs.mapInArrow(run, schema)


def digests(found: DataFrame) -> DataFrame:
    """Counts of base kinds, the digest of base spans and the list of all spans."""
    names = F.array(*[F.lit(k) for k in KINDS])
    line = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.array_join(F.transform(F.filter("spans", lambda x: x["kind"] < len(BASE)), line), ",")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE)],
        F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("spans", line), ",").alias("spans"),
    )


def digest_text(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
