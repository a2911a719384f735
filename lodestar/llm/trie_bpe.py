"""BPE encoding by a prefix-sharing trie, and decoding.

For byte-pair merges numbered in order, the encoding of a string is fixed by the last token of each of
its prefixes: the token ending there is the one that byte-pair encoding wouldn't merge across its left
edge with the last token before it. A batch's unseen distinct words form a trie; walked depth first
(here: words in sorted order, keeping the path shared with the word before), each node's last token is
found once, however many words share the prefix, and a word's ids are read back along its path.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_columns, pieces_of
from .tokens import CACHE, LONG, Cutter, byte_symbols, stretches

#: Pairs of tokens whose fit a worker remembers.
FITS = 1_000_000


class TrieEncoder(Cutter):
    """Encodes and decodes whole texts as the library does for a byte-level file with the usual pattern."""

    def __init__(self, path: str):
        super().__init__(path)
        if not self.bytes_kept:
            raise ValueError("a byte-level BPE file with the usual pattern is needed")
        model = json.loads(self.tok.to_str())["model"]
        back = {s: b for b, s in byte_symbols().items()}
        vocab = model["vocab"]
        self.text = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.id = {t: i for i, t in self.text.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.pair, self.halves = {}, {i: (i, i) for i in vocab.values()}
        for k, (a, b) in enumerate(merges):
            if vocab[a + b] != len(vocab) - len(merges) + k:
                raise ValueError("merged tokens must be numbered in the order of their merges")
            self.pair[vocab[a], vocab[b]] = vocab[a + b]
            self.halves[vocab[a + b]] = (vocab[a], vocab[b])
        # tokens by their last bytes: lengths worth trying at a node
        self.endings: dict[bytes, list[int]] = {}
        for t in self.id:
            self.endings.setdefault(t[-2:], []).append(len(t))
        self.endings = {k: sorted(set(v), reverse=True) for k, v in self.endings.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self.out = {i: t for i, t in self.text.items()} | {i: a.encode() for a, i in self.added.items()}

    def fit(self, left: int, right: int) -> bool:
        """Whether byte-pair encoding keeps both tokens when they stand side by side.

        Both are taken apart, the younger first; if a merge across the edge was due before the one
        that is being undone, they wouldn't have stayed.
        """
        key = left, right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > FITS:
                self.fits.clear()
            known = self.fits[key] = self._fit(left, right)
        return known

    def _fit(self, left: int, right: int) -> bool:
        limit, pair, halves = 1 << 60, self.pair, self.halves
        while True:
            across = pair.get((left, right))
            if across is not None and across < limit:
                return False
            if left > right:
                limit, left = left, halves[left][1]
                if left == limit:
                    limit, right = right + 1, halves[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, halves[right][0]
                if right + 1 == limit:
                    limit, left = left, halves[left][1]
                    if left == limit:
                        return True

    def walk(self, words: list[bytes]) -> Iterator[list[int]]:
        """ids of each of the words, which are distinct and sorted."""
        last: list[int] = []  # of the path: the last token of each prefix
        size: list[int] = []
        ids, endings, fit, halves = self.id, self.endings, self.fits, self.fit
        before = b""
        for word in words:
            n = min(len(word), len(before))
            shared = next((i for i in range(n) if word[i] != before[i]), n)
            del last[shared:], size[shared:]
            for end in range(shared + 1, len(word) + 1):
                for k in endings.get(word[end - 2 : end] if end > 1 else word[:1], ()):
                    if k > end:
                        continue
                    t = ids.get(word[end - k : end])
                    if t is None:
                        continue
                    if k < end:
                        left = last[end - k - 1]
                        ok = fit.get((left, t))
                        if not (halves(left, t) if ok is None else ok):
                            continue
                    last.append(t)
                    size.append(k)
                    break
                else:
                    t = ids[word[end - 1 : end]]
                    last.append(t)
                    size.append(1)
            before = word
            found, at = [], len(word)
            while at:
                found.append(last[at - 1])
                at -= size[at - 1]
            found.reverse()
            yield found

    def learn(self, unseen: list[str]) -> dict[str, bytes]:
        """Add the ids of words; those of long ones are returned instead."""
        words, long = sorted({p.encode() for p in unseen}), {}
        for w, ids in zip(words, self.walk(words), strict=True):
            (self.known if len(w) < LONG else long)[w.decode()] = np.array(ids, "<u4").tobytes()
        return long

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian uint32 bytes."""
        cut: list[list] = []
        for t in texts:
            parts: list = []
            for k, own in enumerate(self.between.split(t) if self.between and any(a in t for a in self.added) else [t]):
                if k % 2:
                    parts.append(np.array([self.added[own]], "<u4").tobytes())
                else:
                    parts += [self.cut(s) for s in stretches(own)]
            cut.append(parts)
        everything = lambda: set().union(*(p for parts in cut for p in parts if isinstance(p, list)))
        long: dict[str, bytes] = {}
        if unseen := everything().difference(self.known):
            if len(self.known) + len(unseen) > CACHE:
                self.known.clear()
                unseen = everything()
            long = self.learn(list(unseen))
        get = (self.known | long if long else self.known).__getitem__
        return [b"".join([b"".join(map(get, p)) if isinstance(p, list) else p for p in parts]) for parts in cut]

    def decode(self, ids: bytes) -> str:
        """The text of little-endian uint32 ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.out.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def trie_encoder(path: str) -> TrieEncoder:
    return TrieEncoder(path)


def encode_documents(docs: DataFrame, tokenizer: str, digests: bool = False) -> DataFrame:
    """Each document's ids and decoded text (or their digests, so that neither leaves the worker).

    One pass, no shuffle: a worker's words are learnt batch by batch. Null texts count as empty, null
    doc_ids stay, repeated rows repeat, empty tables give no rows, other columns play no part, and
    texts of any length are cut into stretches at safe spaces.
    """
    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = trie_encoder(tokenizer)
        for batch in pieces_of(batches):
            ids = enc.encode(batch.column(1).to_pylist())
            back = map(enc.decode, ids)
            if digests:
                cols = [pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string())]
            else:
                cols = [pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array(list(back), pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), *cols], ["doc_id", "n_tokens", *names])

    kinds = ("string", "string") if digests else ("array<int>", "string")
    return doc_columns(docs).mapInArrow(run, f"doc_id long, n_tokens long, {names[0]} {kinds[0]}, {names[1]} {kinds[1]}")
