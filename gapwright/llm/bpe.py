"""Token ids of whole texts by the tokenizers library, with a bounded memo of pieces.

A text is cut at places where the tokenizer's own pre-tokenization always cuts, so the
ids of the pieces, one behind the other, are the ids of the text. Pieces repeat a lot: those of a
batch of texts are told apart by 64-bit hashes in numpy, each different one is looked up once by its bytes, and only
unseen ones go to the library. Texts that hold a special token's string go there whole, since what
the library does with it is part of the ids; so do texts of tokenizers that split in another way than the two
known here.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np

from .common import _ODD, _SPACE, concat_ranges, words

#: Entries in each of the two generations of a memo.
MEMO = 300_000
_CACHE: dict[str, "Encoder"] = {}


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


_ALNUM, _GRAPH = _bytes((48, 57), (65, 90), (97, 122)), _bytes((33, 126))
#: After a space: what surely is no white space (the lead bytes that are left out begin some).
_NO_SPACE = _bytes((33, 126), (0x80, 0xC1), (0xC3, 0xE0), (0xE4, 0xFF))
_POINT = np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))

#: Pre-tokens of the two kinds (fixed by the vocabulary files).
_SPLIT = {
    "space": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "drop": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}


def _kind(spec: dict) -> str:
    """'space', 'drop', or 'whole' for a tokenizer whose cuts aren't known here."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
        return "space"
    steps = [x.get("type") for x in pre.get("pretokenizers", [])]
    if steps == ["Split", "ByteLevel"] and pre["pretokenizers"][0].get("pattern") == {"Regex": _SPLIT["drop"]} and [x.get("type") for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
        return "drop"
    return "whole"


def _byte_letters() -> dict[int, str]:
    """Byte to letter of byte-level vocabularies: printable bytes stand for themselves, others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """kind 'space': pieces keep the space before them (byte-level BPE). kind 'drop': white space has no ids, case is folded.
    kind 'whole': nothing is cut."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind = _kind(spec)
        self.added = [x["content"].lower().encode() for x in spec.get("added_tokens", [])]
        self.split = regex.compile(_SPLIT.get(self.kind, "")).findall
        self.model = self.full.model
        self.letters = _byte_letters()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.tokens: dict[str, bytes] = {}
        self.line = self._ids(["\n"])[0]

    def _ids(self, texts: list[str]) -> list[bytes]:
        out = []
        for lo in range(0, len(texts), 2000):
            out += [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.full.encode_batch_fast(texts[lo : lo + 2000], add_special_tokens=False)]
        return out

    def _learn(self, missing: list[bytes]) -> list[bytes]:
        """Ids of pieces that the young memo lacks, and keeps them."""
        young, old, tokens, fold = self.young, self.old, self.tokens, self.kind == "drop"
        if len(tokens) > MEMO:
            tokens.clear()
        tokenize, letters, split = self.model.tokenize, self.letters, self.split
        out, rest = [], []
        for k in missing:
            v = old.get(k)
            if v is None:
                s = k.decode("utf-8")
                if fold:
                    s = s.lower()
                head = b""
                if s[0] == "\n" and "!" <= s[1:2] <= "~":  # a pre-token of its own
                    head, s = self.line, s[1:]
                word = s[1:] if s[:1] == " " else s
                if word.isalpha() and (word.isascii() or max(word) < "\u0100"):  # one pre-token
                    x = s.replace(" ", "\u0120") if word.isascii() else s.encode().decode("latin-1").translate(letters)
                    v = head + array("I", [y.id for y in tokenize(x)]).tobytes()
                elif max(s, default="") >= "\u0100":  # other scripts: the library normalises and splits
                    rest.append((len(out), k))
                else:
                    parts = [head]
                    for x in split(s):
                        t = tokens.get(x)
                        if t is None:
                            t = tokens[x] = array("I", [y.id for y in tokenize(x.encode().decode("latin-1").translate(letters))]).tobytes()
                        parts.append(t)
                    v = b"".join(parts)
            young[k] = v
            out.append(v)
        for (i, k), v in zip(rest, self._ids([k.decode("utf-8") for _, k in rest]), strict=True):
            young[k] = out[i] = v
        return out

    def _cut(self, raw: bytes) -> bool:
        """Can this text be cut? Not if it holds a special token, whose string goes before all splits."""
        low = raw.lower() if self.added else raw
        return self.kind != "whole" and not any(x in low for x in self.added)

    def _parts(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each byte: is it a cut (a piece ends before it); is it a piece alone.

        A point after a letter or digit and before another, white space or the end is a pre-token of its own. 'space':
        so is a line feed between printable characters, and a space before a character goes with that; both stay with the
        word behind. 'drop': ASCII white space has no ids.
        """
        before, after = np.zeros_like(raw), np.zeros_like(raw)
        before[1:], after[:-1] = raw[:-1], raw[1:]
        inner = off[(off > 0) & (off < len(raw))]
        before[inner], after[inner - 1] = 0, 0
        last = (after == 0) & np.isin(np.arange(len(raw)), off[1:] - 1)
        alone = _POINT[raw] & _ALNUM[before] & (_ALNUM[after] | (after == 32) | (after == 10) | last)
        if self.kind == "drop":
            return alone | _SPACE[raw], alone
        return alone | ((raw == 32) & _NO_SPACE[after]) | ((raw == 10) & _GRAPH[before] & _GRAPH[after]), alone

    def _pieces(self, texts: list[bytes]) -> list[bytes]:
        joined = b"".join(texts)
        off = np.cumsum([0, *map(len, texts)])
        raw, keep = np.frombuffer(joined, np.uint8), self.kind == "space"
        if not len(raw):
            return [b""] * len(texts)
        parts, alone = self._parts(raw, off)
        h, s, e, first = words(raw, off, not keep, parts=parts)
        if keep:  # a piece has the space or line feed before it, if that is a cut
            start = np.maximum(s - 1, 0)
            at = (s > np.repeat(off[:-1], np.diff(first))) & parts[start] & ~alone[start]
            h, s = np.where(at, h ^ (_ODD + raw[start].astype(np.uint64)), h), s - at
        one = np.flatnonzero(alone)
        order = np.argsort(np.concatenate((s, one)), kind="stable")
        h, s, e = np.concatenate((h, raw[one].astype(np.uint64)))[order], np.concatenate((s, one))[order], np.concatenate((e, one + 1))[order]
        first = np.searchsorted(s, off)
        _, some, place = np.unique(h, return_index=True, return_inverse=True)
        keys = [joined[i:j] if keep else joined[i:j].lower() for i, j in zip(s[some].tolist(), e[some].tolist(), strict=True)]
        if len(self.young) > MEMO:
            self.old, self.young = self.young, {}
        ids = list(map(self.young.get, keys))
        unseen = [i for i, v in enumerate(ids) if v is None]
        for i, v in zip(unseen, self._learn([keys[i] for i in unseen]), strict=True):
            ids[i] = v
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, each = np.frombuffer(b"".join(ids), "<u4"), n[place]
        all_ = flat[concat_ranges((np.cumsum(n) - n)[place], each)]
        cut = np.concatenate(([0], np.cumsum(each)))[first].tolist()
        return [all_[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each UTF-8 text."""
        out = [b""] * len(texts)
        cut = [self._cut(t) for t in texts]
        own, whole = ([i for i, x in enumerate(cut) if x is y] for y in (True, False))
        for i, v in zip(own, self._pieces([texts[i] for i in own]) if own else [], strict=True):
            out[i] = v
        for i, v in zip(whole, self._ids([texts[i].decode("utf-8") for i in whole]), strict=True):
            out[i] = v
        return out


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    if path not in _CACHE:
        _CACHE[path] = Encoder(path)
    return _CACHE[path]


def batches(texts: list[bytes], size: int = 4 << 20):
    """Index ranges of texts of about `size` bytes together."""
    lo = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
