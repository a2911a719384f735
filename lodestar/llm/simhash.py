"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's 64 bits are read as 16 segments of four; their bit counts are a point of a grid of 16
dimensions with sides 0 to 4, and the Manhattan distance of two points is a lower bound of the
fingerprints' Hamming distance. Two points at distance 2 or less have a grid point at distance 1 or
less from both: each fingerprint is sent to its own cell and to the neighbouring cells (33 at most),
fingerprints that meet in a cell are the candidates, and the exact distance is checked in the join.
Points, cells and checks are arithmetic on 64-bit integers, so all of it stays in Spark's own code.
Equal fingerprints are one node from the start, however many documents share them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, doc_columns, pieces_of, stored

SHINGLE, SEED, RADIUS = 3, 42, 2
SEGMENTS, SEGMENT_BITS = 16, 4


def fingerprint(text: str, words: int = SHINGLE) -> int:
    """Bits set in over half of the XXH64 (seed 42) of the text's shingles, repeats included.

    Words are runs of anything but ASCII white space, A-Z lower-cased; fewer words than a shingle make
    one shingle, none make fingerprint zero.
    """
    h = shingle_hashes(text, words)
    return majority(h) if len(h) else 0


def shingle_hashes(text: str, words: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of the text, in order and with repeats, as uint64."""
    own = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not own:
        return np.zeros(0, "<u8")
    grams = map(b" ".join, zip(*(own[i:] for i in range(words)), strict=False)) if len(own) >= words else [b" ".join(own)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, SEED) for g in grams), "<u8")


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        counts += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and two hashes of the text, a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            fp = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), batch.column(2), batch.column(3)], ["doc_id", "fp", "h1", "h2"])

    text = F.col("text")
    keyed = doc_columns(docs).withColumns({"h1": F.xxhash64(text), "h2": F.xxhash64(F.lit("second"), text)})
    return keyed.mapInArrow(run, "doc_id long, fp long, h1 long, h2 long")


def segment_counts(fp: Column) -> Column:
    """The 16 segments' bit counts, 0 to 4 in four bits each (at most 0x44..4, a positive long)."""
    odd, pairs = F.lit(0x5555555555555555), F.lit(0x3333333333333333)
    twos = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    # counts of two bits: carries and sums by bit logic, as long addition may overflow in ANSI mode
    both, one = twos[0].bitwiseAND(twos[1]), twos[0].bitwiseXOR(twos[1])
    count = F.shiftleft(both, 1).bitwiseOR(one)
    return count.bitwiseAND(pairs) + F.shiftrightunsigned(count, 2).bitwiseAND(pairs)


def links(fps: DataFrame) -> DataFrame:
    """Pairs (u < v) of the distinct fingerprints ``fp`` at a Hamming distance of 1 or 2.

    Distance 0 or 1 between points meets in one's own cell, distance 2 in a cell beside both; pairs are
    let through once in a cell, and only when the exact distance holds. The join is a merge join: Spark
    takes the cells for as many as the fingerprints (there are up to 33 of each) and would broadcast them
    from the driver.
    """
    at = fps.select("fp", segment_counts(F.col("fp")).alias("point"))
    moves = "array(struct(point AS cell, 0 AS move))"
    for i in range(SEGMENTS):
        shift = i * SEGMENT_BITS
        count = f"(shiftrightunsigned(point, {shift}) & 15L)"
        one = f"shiftleft(1L, {shift})"
        moves += f", filter(array(struct(if({count} < {SEGMENT_BITS}, point + {one}, point) AS cell, if({count} < {SEGMENT_BITS}, {i + 1}, 0) AS move), struct(if({count} > 0, point - {one}, point) AS cell, if({count} > 0, {-i - 1}, 0) AS move)), x -> x.move <> 0)"
    cells = at.select("fp", F.explode(F.expr(f"concat({moves})")).alias("x")).select("fp", "x.cell", "x.move")
    a, b = cells.alias("a").hint("merge"), cells.alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS
    once = ((F.col("a.move") == 0) & (F.col("b.move") == 0)) | ((F.col("a.move") == 0) != (F.col("b.move") == 0)) | (F.col("a.move") != F.col("b.move"))
    return a.join(b, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp")) & once & near).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).distinct()


def components(found: DataFrame) -> DataFrame:
    """(fp, comp) for every distinct fingerprint of ``found``; comp is one for all that links connect."""
    fps = found.select("fp").distinct()
    comp = connected_components(links(fps)).select(F.col("node").alias("fp"), "comp")
    return fps.join(comp, "fp", "left").select("fp", F.coalesce("comp", "fp").alias("comp"))


def near_duplicates(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach) and n_links, a row per document.

    n_links counts the other fingerprints within reach. Null texts count as empty and link like any
    text without words; a null doc_id belongs to its component but never names it (null if all are);
    repeated rows repeat; an empty table gives no rows; other columns play no part.
    """
    found = stored(fingerprints(docs, words), "simhash")
    own = stored(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fps")
    pairs = stored(links(own), "simhash-links")
    degree = pairs.select(F.explode(F.array("u", "v")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    comp = connected_components(pairs).select(F.col("node").alias("fp"), "comp")
    known = own.join(comp, "fp", "left").join(degree, "fp", "left").select("fp", "least", F.coalesce("comp", "fp").alias("comp"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    named = known.join(known.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("fp", "component_id", "n_links")
    return found.select("doc_id", "fp").join(named, "fp").select("doc_id", "fp", "component_id", "n_links")


def keep_one(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id (nulls last), then text hash.

    The rows to keep are named by doc_id and 128 hashed bits of the text; where repeated rows carry
    one name, one of them stays. All columns are kept, clashing names included.
    """
    found = stored(fingerprints(docs, words), "simhash")
    return keep_least(docs, found, components(found))


def keep_least(docs: DataFrame, found: DataFrame, comp: DataFrame) -> DataFrame:
    """:func:`keep_one` from the documents' nodes (doc_id, fp, h1, h2) and the nodes' components (fp, comp)."""
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")
    best = found.groupBy("fp").agg(F.min(name).alias("best"))
    kept = best.join(comp, "fp").groupBy("comp").agg(F.min("best").alias("best")).select("best.*")
    times = found.groupBy("doc_id", "h1", "h2").agg(F.count("*").alias("times"))
    kept = stored(kept.alias("k").join(times.alias("t"), F.expr("k.doc_id <=> t.doc_id AND k.h1 = t.h1 AND k.h2 = t.h2")).select("k.doc_id", "k.h1", "k.h2", "t.times"), "simhash-kept")
    discard(found)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2"))
    left = whole.alias("d").join(kept.alias("k"), F.expr("d.id <=> k.doc_id AND d.h1 = k.h1 AND d.h2 = k.h2")).select("d.row", "d.id", "d.h1", "d.h2", "k.times")
    one = left.where("times = 1").select("row")
    # of rows that differ in other columns alone the least stays; maps have no order, so any does where there are some
    pick = F.first if "map<" in docs.schema.simpleString() else F.min
    first = left.where("times > 1").groupBy("id", "h1", "h2").agg(pick("row").alias("row")).select("row")
    return one.union(first).select("row.*")
