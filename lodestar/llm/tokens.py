"""Whole-text encoding with a tokenizers file, each distinct piece of the pre-tokenizer merged once.

Text is cut by the file's own pattern: with ``re`` where all characters are Latin (below U+0250, the
classes written out), else with ``regex`` and its Unicode classes. Pieces that a worker hasn't seen
are merged together in numpy (:class:`Merges`): in each round every piece applies its lowest-ranked
pair, which is what byte-pair encoding does piece by piece. Files of another make, added tokens in a
text and pieces out of the ordinary go to the tokenizers library itself. Ids of a piece are kept as
little-endian uint32 bytes, so a document's ids are one ``b"".join``.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np

#: Pieces that a worker's cache holds, each of less than LONG bytes; a full one is emptied.
CACHE = 500_000
#: Characters cut at a time; longer texts are first cut at a space between two other characters.
STRETCH = 1 << 20
#: Bytes from which a piece goes to the library.
LONG = 512

# The Latin letters, digits and white space below U+0250, and the two files' patterns.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
DIGITS = "0-9²³¹¼-¾"
BLANKS = " \\t\\n\\x0b\\x0c\\r\\x85\\xa0"
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN_BYTE_LEVEL = re.compile(f" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{DIGITS}]+| ?[^{BLANKS}{LETTERS}{DIGITS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")
LATIN_WORD_LEVEL = re.compile(f"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{DIGITS}]|[^{BLANKS}{LETTERS}{DIGITS}]+")
NOT_LATIN = re.compile("[^\x00-ɏ]|İ")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """Byte-pair merges over many pieces at once."""

    NONE = np.int64(1 << 40)
    BITS = 18

    def __init__(self, spec: dict):
        vocab = spec["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["merges"]]
        suffix = spec.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.first = np.array([vocab[symbols[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[symbols[b] + suffix] for b in range(256)], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.ranks = np.full(1 << self.BITS, self.NONE, np.int64)
        rank = {}
        for i, (a, b) in enumerate(pairs):
            rank.setdefault(vocab[a] << 20 | vocab[b], i)
        for key, i in rank.items():
            at = int(self._slot(np.array([key], np.int64))[0])
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.BITS) - 1)
            self.keys[at], self.ranks[at] = key, i

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def rank(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], self.NONE)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.BITS) - 1)
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.ranks[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece (none may be empty), as little-endian uint32 bytes."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ids, ends = self.first[raw], np.cumsum(size)
        ids[ends - 1] = self.last[raw[ends - 1]]
        who, done = np.arange(len(pieces)), []
        while len(size):
            ends = np.cumsum(size)
            starts = ends - size
            ranks = np.full(len(ids), self.NONE)
            if len(ids) > 1:
                ranks[:-1] = self.rank(ids[:-1] << 20 | ids[1:])
            ranks[ends - 1] = self.NONE
            least = np.minimum.reduceat(ranks, starts)
            settled = least == self.NONE
            if settled.any():
                own = np.repeat(settled, size)
                done.append((who[settled], size[settled], ids[own]))
                ids, ranks, who, size, least = ids[~own], ranks[~own], who[~settled], size[~settled], least[~settled]
                if not len(size):
                    break
                starts = np.cumsum(size) - size
            merged = ranks == np.repeat(least, size)
            if (merged[1:] & merged[:-1]).any():  # the same symbol over and over: from the left, every other pair
                at = np.arange(len(merged))
                run = at - np.maximum.accumulate(np.where(merged, -1, at))
                merged &= run % 2 == 1
            at = np.flatnonzero(merged)
            ids[at] = self.made[ranks[at]]
            gone = np.zeros(len(ids), bool)
            gone[at + 1] = True
            size = size - np.add.reduceat(merged, starts, dtype=np.int64)
            ids = ids[~gone]
        who, size = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        flat = np.concatenate([d[2] for d in done]).astype("<u4").tobytes()
        ends = np.cumsum(size) * 4
        out: list[bytes] = [b""] * len(pieces)
        for i, a, b in zip(who.tolist(), (ends - size * 4).tolist(), ends.tolist(), strict=True):
            out[i] = flat[a:b]
        return out


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut before spaces that have no white space beside them."""
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while 0 <= cut < len(text) - 1 and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if not 0 <= cut < len(text) - 1:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


class Cutter:
    """The pieces that a tokenizers file's pattern makes of a text, added tokens apart."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(self.tok.to_str())
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        simple = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")) and not spec["post_processor"]
        simple = simple and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or " " in x["content"] for x in spec["added_tokens"])
        steps = pre.get("pretokenizers") or [{}]
        norm = [n.get("type") for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.bytes_kept = simple and spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
        self.spaces_gone = simple and norm == ["NFC", "Replace", "Lowercase"] and steps[0].get("pattern", {}).get("Regex") == WORD_LEVEL and steps[0].get("behavior") == "Removed" and model.get("end_of_word_suffix") == "</w>"
        self.latin = LATIN_BYTE_LEVEL if self.bytes_kept else LATIN_WORD_LEVEL
        self.any = regex.compile(BYTE_LEVEL if self.bytes_kept else WORD_LEVEL)
        self.merges = Merges(model) if self.bytes_kept or self.spaces_gone else None
        self.between = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def cut(self, text: str) -> list[str] | None:
        """Pieces of a text without added tokens; None if only the library can tell."""
        if self.bytes_kept:
            return (self.latin if text.isascii() or not NOT_LATIN.search(text) else self.any).findall(text)
        if text.isascii() or not NOT_LATIN.search(text):
            return self.latin.findall(text.lower())
        return None

    def direct(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class Encoder(Cutter):
    """ids of whole texts as the library gives them with add_special_tokens=False and no truncation or padding."""

    def __init__(self, path: str):
        super().__init__(path)
        self.known: dict[str, bytes] = {}

    def learn(self, unseen: list[str]) -> dict[str, bytes]:
        """Add the ids of pieces; those of long ones are returned instead."""
        raw = [p.encode() for p in unseen]
        for i in range(0, len(raw), 20_000):
            part = [(p, r) for p, r in zip(unseen[i : i + 20_000], raw[i : i + 20_000], strict=True) if len(r) < LONG]
            if part:
                self.known.update(zip((p for p, _ in part), self.merges.merge([r for _, r in part]), strict=True))
        return {p: self.direct(p) for p, r in zip(unseen, raw, strict=True) if len(r) >= LONG}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian uint32 bytes."""
        if self.merges is None:
            return [self.direct(t) for t in texts]
        cut: list[list] = []
        for t in texts:
            parts: list = []
            for k, own in enumerate(self.between.split(t) if self.between and any(a in t for a in self.added) else [t]):
                if k % 2:
                    parts.append(np.array([self.added[own]], "<u4").tobytes())
                else:
                    for s in stretches(own):
                        parts.append(self.direct(s) if (pieces := self.cut(s)) is None else pieces)
            cut.append(parts)
        unseen = set().union(*(p for parts in cut for p in parts if isinstance(p, list))).difference(self.known)
        long: dict[str, bytes] = {}
        if unseen:
            if len(self.known) + len(unseen) > CACHE:
                self.known.clear()
                unseen = set().union(*(p for parts in cut for p in parts if isinstance(p, list)))
            long = self.learn(list(unseen))
        get = (self.known | long if long else self.known).__getitem__
        return [b"".join([b"".join(map(get, p)) if isinstance(p, list) else p for p in parts]) for parts in cut]


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each file and worker process."""
    return Encoder(path)
