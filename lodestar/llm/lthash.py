"""Document fingerprints by a homomorphic multiset hash.

Each paragraph (line of a text) is hashed to a wide vector: 16 lanes of 32 uniform bits, and 128 lanes
that add up +1 or -1 for each of its units (clauses, long ones by eight words). A fingerprint is the
sum over the paragraphs, each lane modulo 2^32, which no text's units reach. Sums don't depend on the paragraphs' order, equal
multisets have equal fingerprints, and a paragraph is added or taken away by adding or subtracting its
vector. The inner product of two sums' signed lanes estimates how many units the texts share, so their
cosine is the likeness of two fingerprints, without the texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, partitions

UNIFORM, SIGNED = 16, 128
LANES = UNIFORM + SIGNED
_CLAUSE = re.compile(r"[^.,;:!?]+")
_EIGHT = re.compile(r"(?:\S+\s*){1,8}")


def units(paragraph: str) -> list[str]:
    out = []
    for clause in _CLAUSE.findall(paragraph):
        clause = clause.strip()
        if len(clause) > 80:
            out += [u.strip() for u in _EIGHT.findall(clause)]
        elif clause:
            out.append(clause)
    return out


def _sums(rows: np.ndarray, counts: list[int], kind: type) -> np.ndarray:
    """Sums of consecutive groups of rows; a group may be empty."""
    size = np.array(counts)
    out = np.zeros((len(size), rows.shape[1]), kind)
    full = size > 0
    if full.any():
        starts = np.cumsum(size) - size
        out[full] = np.add.reduceat(rows, starts[full], axis=0, dtype=kind)
    return out


def fingerprints(texts: list[str]) -> np.ndarray:
    """(texts, LANES) of uint32. Empty paragraphs add nothing; an empty text's fingerprint is zero."""
    whole, n_whole, parts, n_parts = [], [], [], []
    for t in texts:
        own = [p for p in t.split("\n") if p]
        whole += [hashlib.blake2b(p.encode()).digest() for p in own]
        n_whole.append(len(own))
        mine = [xxhash.xxh3_128_digest(u.encode()) for p in own for u in units(p)]
        parts += mine
        n_parts.append(len(mine))
    uniform = _sums(np.frombuffer(b"".join(whole), "<u4").reshape(-1, UNIFORM), n_whole, np.uint32)
    bits = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, SIGNED // 8)
    signed = np.zeros((len(texts), SIGNED), np.int64)
    at, ends = 0, np.cumsum(n_parts)
    while at < len(texts):  # a bounded number of units at a time
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 50_000, side="right")))
        a, b = int(ends[at - 1]) if at else 0, int(ends[to - 1])
        signed[at:to] = 2 * _sums(np.unpackbits(bits[a:b], axis=1), n_parts[at:to], np.int64) - np.array(n_parts[at:to])[:, None]
        at = to
    return np.concatenate([uniform, signed.astype(np.uint32)], axis=1)


def insert(fingerprint: np.ndarray, paragraph: str) -> np.ndarray:
    return fingerprint + fingerprints([paragraph])[0]


def delete(fingerprint: np.ndarray, paragraph: str) -> np.ndarray:
    return fingerprint - fingerprints([paragraph])[0]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for rows of fingerprints: 1 if equal, else the cosine of the signed lanes, at least 0."""
    x, y = np.ascontiguousarray(a[:, UNIFORM:]).view(np.int32).astype(float), np.ascontiguousarray(b[:, UNIFORM:]).view(np.int32).astype(float)
    norm = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cos = np.divide((x * y).sum(1), norm, out=np.zeros(len(x)), where=norm > 0)
    return np.where((a == b).all(1), 1.0, np.clip(cos, 0.0, 1.0))


_NAMES = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def edit(text: str, following: str) -> str:
    """The last half of the characters replaced by as many (or all) from the start of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _digest(docs: list[int | None], texts: list[str], after: list[str]) -> pa.RecordBatch:
    """The result for documents whose next ones are known."""
    edited = [edit(t, n) for t, n in zip(texts, after, strict=True)]
    # most next texts are the following row's own
    more = [k for k, n in enumerate(after) if k + 1 == len(texts) or n is not texts[k + 1]]
    prints = fingerprints([*texts, *(after[k] for k in more)])
    own, nexts = prints[: len(texts)], np.roll(prints[: len(texts)], -1, axis=0)
    nexts[more] = prints[len(texts) :]
    changed = fingerprints(edited)
    columns = [
        pa.array(docs, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        pa.array([r.tobytes() for r in own], pa.binary()),
        pa.array([r.tobytes() for r in changed], pa.binary()),
        pa.array(likeness(own, changed)),
        pa.array(likeness(own, nexts)),
    ]
    return pa.RecordBatch.from_arrays(columns, list(_NAMES))


def _bucket(bounds: list[int]) -> Column:
    """How many of the descending bounds lie above doc_id, by binary search; null comes last."""

    def tree(low: int, high: int) -> str:
        if low == high:
            return str(low)
        middle = (low + high) // 2
        return f"CASE WHEN doc_id >= {bounds[middle]}L THEN {tree(low, middle)} ELSE {tree(middle + 1, high)} END"

    return F.expr(f"CASE WHEN doc_id IS NULL THEN {len(bounds)} ELSE {tree(0, len(bounds))} END")


#: Ranges of doc_id at most; their bounds and first documents' ids are known to the driver.
RANGES = 4096


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, its edited text's, and their likeness and that to the next document.

    Documents are dealt out by ranges of descending doc_id (nulls last, equal ids by text) and sorted.
    A range also needs the first document of the next one: it is sent to both, marked as being ahead,
    so texts are shuffled once and nothing is stored. The last document's next is the first. Null texts
    count as empty, a lone document is its own next, empty tables give no rows, other columns play no
    part. Fingerprints are little-endian uint32 lanes.
    """
    spark, rows = docs.sparkSession, doc_columns(docs)
    n = min(partitions(spark), RANGES)
    found = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 10_000).alias("at")).first()["at"]
    bucket = _bucket(sorted(set(found or []), reverse=True))
    heads = {r["bucket"]: r["head"] for r in rows.select(bucket.alias("bucket"), "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()}
    present = sorted(heads)
    ahead = spark.createDataFrame([(heads[b], present[k - 1]) for k, b in enumerate(present)], "head long, before int")
    own = rows.withColumn("bucket", bucket)
    # a row a range at most, so it may be broadcast
    marked = own.join(F.broadcast(ahead), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    places = F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("ahead")), F.struct(F.col("before").alias("b"), F.lit(True).alias("ahead")))
    sent = marked.select("doc_id", "text", F.explode(F.filter(places, lambda x: x["b"].isNotNull())).alias("p")).select("p.b", "p.ahead", "doc_id", "text")
    dealt = sent.repartitionByRange(n, "b").sortWithinPartitions("b", "ahead", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # a document whose next one is still to come
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                ids, texts, after = [], [], []
                for b, first, doc, text in zip(*(c.to_pylist() for c in batch.slice(i, 128).columns), strict=True):
                    if held is not None and held[0] == b:
                        ids.append(held[1])
                        texts.append(held[2])
                        after.append(text)
                    held = None if first else (b, doc, text)
                if ids:
                    yield _digest(ids, texts, after)

    return dealt.mapInArrow(run, _SCHEMA)
