"""Exact substring dedup by super-k-mers of words.

A window is ``window`` consecutive words. Its minimiser is the smallest hash of the runs of ``m`` words
within it; consecutive windows that share one form a super-k-mer, which travels as one packed string to
the minimiser's bucket. Equal windows have equal minimisers, so they meet; there all windows of the
bucket are sorted, and neighbours compared word for word.

Most minimisers occur once in the corpus and their windows can't repeat. A first pass counts them all
and keeps a bitmap of fixed size (2^``bits``) of those that occur again; a super-k-mer whose bit isn't
set stays where it is. Bits set by chance only make more strings travel. In buckets of over ``hot``
occurrences (copies or passages in very many documents) equal strings are folded, before the shuffle,
into one with its count; what is found in it is joined back to its documents, a join that adaptive
execution can split. If over ``hot`` distinct strings are left, the bucket is split further, twice. First
a string is cut into parts: neighbouring windows whose first minimiser stands at one of ``PART``
neighbouring places in them. All windows of such a place have most words around the minimiser in common;
these words name the part's bucket, and equal parts are folded. Then, where over ``hot`` distinct parts
are left, each window goes to a place of its own, where its bytes are grouped and counted.

Words of over ``LONG`` bytes travel as their SHA-256 (after a tab, which no word holds), so a string's
size is bounded whatever the words.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, doc_columns, partitions, pieces_of, stored

WINDOW, M = 35, 8
#: The bitmap's size, occurrences from which a bucket is split, windows in a packed string at most.
BITS, HOT, RUN = 26, 1024, 256
#: Bytes from which a word is stood for by its digest in strings.
LONG = 256
#: Places of the minimiser in a window that make one part of a crowded string.
PART = 8
#: Words of a document that are looked at together.
BLOCK = 1 << 18

_SPAN = "doc_id long, h1 long, h2 long, a long, b long"


def words_of(text: str) -> list[bytes]:
    """Runs of anything but ASCII white space, as UTF-8."""
    return text.encode().split()


def bounded(words: list[bytes]) -> list[bytes]:
    """The words as they travel: long ones as their digest."""
    if max(map(len, words), default=0) <= LONG:
        return words
    return [w if len(w) <= LONG else b"\t" + hashlib.sha256(w).hexdigest().encode() for w in words]


def _sliding(x: np.ndarray, n: int, f: np.ufunc) -> np.ndarray:
    """f over every n neighbours, by doubling."""
    size, out = 1, x
    while 2 * size <= n:
        out = f(out[: len(out) - size], out[size:])
        size *= 2
    return f(out[: len(x) - n + 1], out[n - size : n - size + len(x) - n + 1])


def _grams(words: list[bytes], m: int) -> np.ndarray:
    """Hashes of the runs of m words."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - m + 1
    grams = np.zeros(n, np.uint64)
    for k in range(m):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    return grams


def minimisers(words: list[bytes], window: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Each window's minimiser, and the hashes at the places where some window has it."""
    grams = _grams(words, m)
    wide = window - m + 1
    least = _sliding(grams, wide, np.minimum)
    edge = np.zeros(wide - 1, np.uint64)
    chosen = _sliding(np.concatenate([edge, least, edge]), wide, np.maximum) == grams
    return least, grams[chosen]


def _blocks(words: list[bytes], window: int) -> Iterator[tuple[int, list[bytes]]]:
    for at in range(0, len(words) - window + 1, BLOCK):
        yield at, words[at : at + BLOCK + window - 1]


def _words(minis: DataFrame, bits: int) -> DataFrame:
    """A bitmap of 2^bits bits, those of the low bits of ``mini`` set, as words (i, b): at most 2^(bits-6) rows."""
    low = F.col("mini").bitwiseAND(F.lit((1 << bits) - 1))
    return minis.select(F.shiftright(low, 6).alias("i"), F.expr("shiftleft(1L, cast((mini & 63L) as int))").alias("b")).groupBy("i").agg(F.bit_or("b").alias("b"))


def _bitmap(minis: DataFrame, bits: int) -> np.ndarray:
    """The words of :func:`_words` as an array."""
    rows = _words(minis, bits).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["i"].to_numpy()] = rows["b"].to_numpy()
    return out


def _in(bitmap: np.ndarray, minis: np.ndarray, bits: int) -> np.ndarray:
    low = (minis & np.uint64((1 << bits) - 1)).astype(np.int64)
    return (bitmap[low >> 6] >> (low & 63)) & 1 == 1


def _spans(marks: list[tuple]) -> Iterator[tuple]:
    """Sorted (row, window) marks as (row, first, last + 1) of neighbouring windows."""
    row = first = last = None
    for r, w in marks:
        if r == row and w == last:
            last = w + 1
            continue
        if row is not None and last != first:
            yield row, first, last
        row, first, last = r, w, w + 1
    if row is not None:
        yield row, first, last


def repeated_words(docs: DataFrame, window: int = WINDOW, m: int = M, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """Word spans [a, b) of each document that windows occurring elsewhere cover: doc_id, h1, h2, a, b.

    h1 and h2 are 128 hashed bits of the text: with doc_id they name a document, so repeated rows have
    the spans once and in common. Spans may overlap.
    """
    spark = docs.sparkSession
    text = F.col("text")
    keyed = doc_columns(docs).select("text", "doc_id", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            found = [minimisers(block, window, m)[1] for t in batch.column(0).to_pylist() for _, block in _blocks(bounded(words_of(t)), window)]
            if found:
                values, n = np.unique(np.concatenate(found).view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], ["mini", "n"])

    minis = stored(keyed.select("text").mapInArrow(count, "mini long, n long").groupBy("mini").agg(F.sum("n").alias("n")).where("n > 1"), "minimisers")
    # of fixed size each, whatever the corpus
    again = spark.sparkContext.broadcast(_bitmap(minis.select("mini"), bits))
    many = spark.sparkContext.broadcast(_bitmap(minis.where(F.col("n") > hot).select("mini"), bits))
    discard(minis)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, common = again.value, many.value
        for batch in pieces_of(batches, 64):
            rows: list[tuple] = []
            for t, *key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for at, words in _blocks(bounded(words_of(t)), window):
                    least, _ = minimisers(words, window, m)
                    cuts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
                    ends = np.append(cuts[1:], len(least))
                    value = least[cuts]
                    go = _in(repeated, value, bits)
                    for a, b, v, wide in zip(cuts[go].tolist(), ends[go].tolist(), value[go].view(np.int64).tolist(), _in(common, value[go], bits).tolist(), strict=True):
                        rows += [(v, wide, *key, at + w, b" ".join(words[w : min(w + RUN, b) + window - 1])) for w in range(a, b, RUN)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.bool_(), *[pa.int64()] * 4, pa.binary()), strict=True)], ["mini", "wide", "doc_id", "h1", "h2", "at", "packed"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spans of documents; a bucket holds at most ``hot`` strings."""
        rows = ((r["doc_id"], r["h1"], r["h2"], r["at"] + a, r["at"] + b) for bucket in _buckets(batches) for i, a, b in repeats([x["packed"] for x in bucket], [1] * len(bucket), window) for r in (bucket[i],))
        yield from _batches(rows, ("doc_id", "h1", "h2", "a", "b"), (pa.int64(),) * 5)

    def sort_distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spans within distinct strings, counted as often as they occur."""
        rows = ((bucket[i]["string"], a, b) for bucket in _buckets(batches) for i, a, b in repeats([x["packed"] for x in bucket], [x["times"] for x in bucket], window))
        yield from _batches(rows, ("string", "a", "b"), (pa.int64(),) * 3)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts of distinct strings, with the bucket that each goes to."""
        strings = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        rows = ((key, part, string, times, at) for mini, packed, string, times in strings for key, part, at in _parts(packed, mini, window, m))
        yield from _batches(rows, ("mini", "packed", "string", "times", "at"), (pa.int64(), pa.binary(), *[pa.int64()] * 3), 4096)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows of distinct parts, each as its bytes."""
        strings = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        rows = ((packed[a:b], string, times, k) for string, packed, times in strings for k, (a, b) in enumerate(_windows(packed, window)))
        yield from _batches(rows, ("w", "string", "times", "a"), (pa.binary(), *[pa.int64()] * 3), 4096)

    def in_buckets(strings: DataFrame) -> DataFrame:
        return strings.repartition(partitions(spark), "mini").sortWithinPartitions("mini").mapInArrow(sort_distinct, "string long, a long, b long")

    def back(occurrences: DataFrame, strings: DataFrame, spans: DataFrame) -> DataFrame:
        """Spans of the strings, in what they occur in."""
        # one row a string, so that the join's other side is what adaptive execution may split
        folded = strings.join(spans.groupBy("string").agg(F.collect_set(F.struct("a", "b")).alias("own")), "string").select("mini", "packed", "own")
        names = [c for c in occurrences.columns if c in ("doc_id", "h1", "h2", "string")]
        found = occurrences.join(folded, ["mini", "packed"]).select(*names, "at", F.explode("own").alias("s"))
        return found.select(*names, (F.col("at") + F.col("s.a")).alias("a"), (F.col("at") + F.col("s.b")).alias("b"))

    sent = stored(keyed.mapInArrow(send, "mini long, wide boolean, doc_id long, h1 long, h2 long, at long, packed binary"), "super-k-mers")
    plain = sent.where("NOT wide").drop("wide").repartition(partitions(spark), "mini").sortWithinPartitions("mini").mapInArrow(sort, _SPAN)
    wide = sent.where("wide")
    if wide.isEmpty():
        return plain
    # strings that many documents share are one row each before they meet; stored, so their numbers stay
    distinct = stored(wide.groupBy("mini", "packed").agg(F.count("*").alias("times")).withColumn("string", F.monotonically_increasing_id()), "distinct-super-k-mers")
    many_strings = distinct.groupBy("mini").count().where(F.col("count") > hot).select("mini")
    spans = in_buckets(distinct.join(many_strings, "mini", "left_anti"))
    cuts = stored(distinct.join(many_strings, "mini", "left_semi").select("mini", "packed", "string", "times").mapInArrow(cut, "mini long, packed binary, string long, times long, at long"), "parts")
    parts = stored(cuts.groupBy("mini", "packed").agg(F.sum("times").alias("times")).withColumn("string", F.monotonically_increasing_id()), "distinct-parts")
    many_parts = parts.groupBy("mini").count().where(F.col("count") > hot).select("mini")
    exploded = stored(parts.join(many_parts, "mini", "left_semi").select("string", "packed", "times").mapInArrow(explode, "w binary, string long, times long, a long"), "windows")
    more = exploded.groupBy("w").agg(F.sum("times").alias("n")).where("n > 1").select("w")
    within = in_buckets(parts.join(many_parts, "mini", "left_anti")).union(exploded.join(more, "w").select("string", "a", (F.col("a") + window).alias("b")))
    spans = spans.union(back(cuts.select("mini", "packed", "string", "at"), parts, within))
    return plain.union(back(wide, distinct, spans))


def _windows(packed: bytes, window: int) -> list[tuple[int, int]]:
    """Where the windows of a packed string begin and end."""
    edges = [0, *(np.flatnonzero(np.frombuffer(packed, np.uint8) == 32) + 1).tolist(), len(packed) + 1]
    return [(a, b - 1) for a, b in zip(edges, edges[window:], strict=False)]


def _parts(packed: bytes, mini: int, window: int, m: int) -> Iterator[tuple[int, bytes, int]]:
    """(key, bytes, first window) of a string's parts. Equal windows of strings with this minimiser are in parts of equal keys."""
    words, wide = packed.split(b" "), window - m + 1
    at, first = np.flatnonzero(_grams(words, m).view(np.int64) == mini), np.arange(len(words) - window + 1)
    anchor = at[np.searchsorted(at, first)]
    group = (anchor - first) // PART
    cuts = np.flatnonzero((anchor[1:] != anchor[:-1]) | (group[1:] != group[:-1])) + 1
    for a, b in itertools.pairwise([0, *cuts.tolist(), len(first)]):
        k, p = int(group[a]), int(anchor[a])
        core = words[p - k * PART : p - min(k * PART + PART, wide) + 1 + window]
        yield int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(core), k)).view(np.int64)), b" ".join(words[a : b - 1 + window]), a


def repeats(strings: list[bytes], times: list[int], window: int) -> list[tuple[int, int, int]]:
    """(string, first word, last word + 1) of what repeated windows cover, by sorting all windows of a bucket.

    A string that occurs more than once repeats as a whole. Windows are sorted by a hash, without copies
    of them; those of one hash are compared byte for byte.
    """
    at = [_windows(s, window) for s in strings]
    own, first = np.repeat(np.arange(len(at)), [len(x) for x in at]), np.cumsum([0, *map(len, at)])
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(s[a:b]) for s, x in zip(strings, at, strict=True) for a, b in x), np.uint64, len(own))
    order = np.argsort(h, kind="stable")
    equal = np.concatenate([[False], h[order[1:]] == h[order[:-1]], [False]])
    again = (np.array(times, np.int64) > 1)[own] if len(own) else np.zeros(0, bool)
    starts = np.flatnonzero(~equal[:-1] & equal[1:])
    for a, b in zip(starts.tolist(), np.flatnonzero(equal[:-1] & ~equal[1:]).tolist(), strict=True):
        places: dict[bytes, list[int]] = {}
        for j in order[a : b + 1].tolist():
            i = int(own[j])
            x, y = at[i][j - int(first[i])]
            places.setdefault(strings[i][x:y], []).append(j)
        for same in places.values():
            if len(same) > 1:
                again[same] = True
    marks = np.flatnonzero(again)
    return [(i, a, b + window - 1) for i, a, b in _spans([(int(own[j]), int(j - first[own[j]])) for j in marks.tolist()])]


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of each minimiser; they come sorted by it."""
    bucket: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if bucket and bucket[0]["mini"] != r["mini"]:
                yield bucket
                bucket = []
            bucket.append(r)
    if bucket:
        yield bucket


def _batches(rows: Iterator[tuple], names: tuple, kinds: tuple, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    while part := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), kinds, strict=True)], list(names))


def kept_words(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, [a for a, _ in spans], 1)
    np.add.at(gone, [b for _, b in spans], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]


def _with_spans(docs: DataFrame, window: int, extra: list, **how) -> DataFrame:
    """Rows of ``docs`` as (text, spans, *extra); spans are null where nothing repeats."""
    spans = repeated_words(docs, window, **how).groupBy("doc_id", "h1", "h2").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(text.alias("text_"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2"), *extra)
    joined = rows.alias("d").join(spans.alias("s"), F.expr("d.id <=> s.doc_id AND d.h1 = s.h1 AND d.h2 = s.h2"), "left")
    return joined.select(F.col("d.text_").alias("text"), F.col("d.id").alias("id"), "s.spans", *(["d.row"] if extra else []))


def _pairs(column: pa.Array) -> list[list[tuple[int, int]] | None]:
    return [None if s is None else [(x["a"], x["b"]) for x in s] for s in column.to_pylist()]


def substring_report(docs: DataFrame, window: int = WINDOW, **how) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by spaces), a row per document.

    Words are left as they are. Null texts have no words; documents of fewer words than a window lose
    none; null doc_ids stay; repeated rows count as elsewhere for each other, and so lose all windows;
    an empty table gives no rows; other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            n, gone, digests = [], [], []
            for t, s in zip(batch.column(0).to_pylist(), _pairs(batch.column(1)), strict=True):
                words = words_of(t)
                kept = kept_words(words, s) if s else words
                n.append(len(words))
                gone.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _with_spans(docs, window, [], **how).select("text", "spans", "id").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, **how) -> DataFrame:
    """``docs`` with repeated words gone from ``text`` (kept words joined by spaces) and ``n_chars`` (if there) counted anew.

    Texts without a repeated window stay as they are, byte for byte; no row goes.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            rows = batch.column(1)
            out = []
            for t, s in zip(batch.column(0).to_pylist(), _pairs(batch.column(2)), strict=True):
                out.append(b" ".join(kept_words(words_of(t), s)).decode() if s else None)
            yield pa.RecordBatch.from_arrays([rows, pa.array(out, pa.string())], ["row", "kept"])

    rows = _with_spans(docs, window, [row], **how).select("text", "row", "spans")
    done = rows.mapInArrow(run, f"row {docs.select(row).schema['row'].dataType.simpleString()}, kept string")
    out = []
    for c in docs.columns:
        own = F.col("row").getField(c)
        if c == "text":
            own = F.coalesce(F.col("kept"), own)
        elif c == "n_chars":
            own = F.when(F.col("kept").isNull(), own).otherwise(F.length("kept").cast(docs.schema[c].dataType))
        out.append(own.alias(c))
    return done.select(*out)
