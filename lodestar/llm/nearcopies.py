"""Near copies by exact Jaccard similarity of word shingles, SimHash first.

A text is the set of its shingles' 64-bit hashes; two texts are near copies if their sets' Jaccard
similarity is at least 4/5. Candidates come from two sources, and every one is checked exactly:

1. SimHash fingerprints of the same shingles that the segment-popcount range join of :mod:`.simhash`
   brings together (2 or fewer differing bits). Copies with few changes meet there.
2. Prefixes, for what no small radius reaches: a pair that similar shares one of each set's first fifth
   (and one) in any common order, so only these prefixes meet and no pair is lost. Shingles that are
   common in a sample come last in the order, which keeps the groups that share one small; the order
   changes the work alone.

Groups are compared with one leader each first (the set that shares most; of equal fingerprints the
least set), and pairs that links already join are left out when all pairs of what remains are checked.
So many copies of one text cost a link each, not a pair each. In a group of over ``FEW`` sets what
remains isn't paired in rows at all: sets outside the group's largest component meet blocks of bounded
size, of the others and of that component, and a block's sizes of intersections are one product of
matrices. Sets of up to ``KEPT`` shingles go there whole, of larger ones the least KEPT; only pairs that
can be links leave it.

Disk follows the input: sets, which are twice its size, are never written as a whole but made again
from the texts that a step asks for, and comparisons go in rounds that shuffle ``ROOM`` bytes a document.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simhash, tokens
from .common import connected_components, discard, doc_columns, pieces_of, stored, tidy
from .simhash import SEED, keep_least
from .substring import BITS, _bitmap, _in, _words

SHINGLE = 5
#: Sets whose shingles are counted for the order, and how many of the commonest are set apart.
SAMPLE, COMMON = 4_000, 100_000
#: Hashes of each set that are compared first, and the share (one in so many) of them that has to agree.
SKETCH, AGREE = 64, 4
#: Sets of a group from which its pairs are compared in blocks, sets in a block, shingles of a block at a time.
FEW, BLOCK, COLUMNS = 64, 128, 8192
#: Bytes of sets for each document that a round of comparisons may shuffle, and bytes that any may.
ROOM, LEAST = 1024, 1 << 26
#: Least hashes of a set that a block holds, and how many of them similar larger sets share: fewer with a chance below 1e-17.
KEPT, SHARED = 256, 140


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and two hashes of it."""
    text = F.col("text")
    return doc_columns(docs).withColumns({"h1": F.xxhash64(text), "h2": F.xxhash64(F.lit("second"), text)})


def _set(h: np.ndarray) -> np.ndarray:
    return np.unique(h.view(np.int64))


def _names(own: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([xxhash.xxh64_intdigest(g.tobytes(), SEED) for g in own], np.uint64).view(np.int64))


def names(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """A row per document: doc_id, fp (a hash of the shingle set), two hashes of the text, the SimHash fingerprint.

    Words are those of :func:`simhash.fingerprint`; a text without any has the empty set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.encoder.cache_clear()  # what a packing before this left in the worker
        for batch in pieces_of(batches):
            every = [simhash.shingle_hashes(t, words) for t in batch.column(1).to_pylist()]
            bits = np.array([simhash.majority(h) if len(h) else 0 for h in every], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), _names([_set(h) for h in every]), batch.column(2), batch.column(3), pa.array(bits)], ["doc_id", "fp", "h1", "h2", "bits"])

    return keyed(docs).mapInArrow(run, "doc_id long, fp long, h1 long, h2 long, bits long")


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """fp and the set (grams: sorted, eight bytes a shingle) of each text."""
    for batch in pieces_of(batches):
        own = [_set(simhash.shingle_hashes(t, words)) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([_names(own), pa.array([g.tobytes() for g in own], pa.binary())], ["fp", "grams"])


@dataclasses.dataclass
class Sets:
    """The documents, their names as written (:func:`names`), the words of a shingle and the number of documents."""

    docs: DataFrame
    found: DataFrame
    words: int
    rows: int

    def rounds(self, size: int | None) -> int:
        """In how many rounds so many bytes are shuffled."""
        return max(1, -(-(size or 0) // max(LEAST, ROOM * self.rows)))


def among(every: Sets, ends: DataFrame, **columns: Column) -> DataFrame:
    """A row (fp and a set's columns) for each of the sets ``ends`` (column fp).

    Sets are made again from one text each, as ``ends`` are few: other texts go before that, by a
    broadcast bitmap of at most 2^(BITS - 6) rows of two longs; the join after it is exact, however full
    the bitmap. Copies of a set are folded in the tasks that read them.
    """
    words = every.words
    one = every.found.join(ends, "fp", "left_semi").groupBy("fp").agg(F.min("h1").alias("mini"))
    bitmap = F.broadcast(_words(one, BITS))
    bit = F.expr("b & shiftleft(1L, cast((h1 & 63L) as int)) <> 0L")
    texts = keyed(every.docs).join(bitmap, (F.shiftright(F.col("h1").bitwiseAND(F.lit((1 << BITS) - 1)), 6) == F.col("i")) & bit, "left_semi").select("text")
    may = texts.mapInArrow(lambda batches: _sets(batches, words), "fp long, grams binary").select("fp", *[c.alias(n) for n, c in columns.items()])
    return may.groupBy("fp").agg(*[F.first(n).alias(n) for n in columns]).join(ends, "fp", "left_semi")


def close_fingerprints(found: DataFrame) -> DataFrame:
    """Pairs (u, v) of sets: each with the least one of its fingerprint, and the least ones of fingerprints in reach."""
    held = found.select("fp", "bits").distinct()
    least = stored(held.groupBy("bits").agg(F.min("fp").alias("least")), "near-bits")
    same = held.join(least, "bits").where("fp <> least").select(F.col("least").alias("u"), F.col("fp").alias("v"))
    near = simhash.links(least.select(F.col("bits").alias("fp")))
    a, b = least.select(F.col("bits").alias("u"), F.col("least").alias("x")), least.select(F.col("bits").alias("v"), F.col("least").alias("y"))
    across = near.join(a, "u").join(b, "v").where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
    out = stored(same.union(across).distinct(), "near-close")
    discard(least)
    return out


def prefixes(every: Sets) -> DataFrame:
    """g, fp, n, at: shingles of each set's prefix, its size and their places in the common order.

    Shingles of one set alone are left out by a bitmap of those that several sets' prefixes have; bits
    set by chance let some through.
    """
    spark, words = every.docs.sparkSession, every.words
    one_in = max(1, every.rows // SAMPLE)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64))], ["g"])

    some = every.found.where(F.pmod(F.xxhash64("fp"), F.lit(one_in)) == 0).select("fp").distinct()
    seen = among(every, some, grams=F.col("grams")).select("grams").mapInArrow(unpacked, "g long")
    often = seen.groupBy("g").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "g").limit(COMMON).toArrow().sort_by("g")
    common, times = (often[c].to_numpy() if len(often) else np.zeros(1, np.int64) for c in ("g", "n"))

    def run(batches: Iterator[pa.RecordBatch], bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        for batch in _sets(batches, words):
            own = batch.column(1).to_pylist()
            grams, offsets = np.frombuffer(b"".join(own), np.int64), np.cumsum([0, *(len(x) // 8 for x in own)])
            where = np.minimum(np.searchsorted(common, grams), len(common) - 1)
            count = np.where(common[where] == grams, times[where], 0)
            g, fp, n, at = [], [], [], []
            for k, name in enumerate(batch.column(0).to_pylist()):
                a, c = grams[offsets[k] : offsets[k + 1]], count[offsets[k] : offsets[k + 1]]
                if size := len(a):
                    first = a[np.lexsort((a, c))[: size - (4 * size + 4) // 5 + 1]]
                    place = np.arange(len(first)) if bits is None else np.flatnonzero(_in(bits, first.view(np.uint64), BITS))
                    g.append(first[place])
                    fp.append(np.full(len(place), name, np.int64))
                    n.append(np.full(len(place), size, np.int64))
                    at.append(place)
            if g:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (g, fp, n, at)], ["g", "fp", "n", "at"])

    tidy(spark)
    own, schema = keyed(every.docs).select("text"), "g long, fp long, n long, at long"
    every_one = own.mapInArrow(lambda batches: run(batches, None), schema)
    several = every_one.groupBy("g").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high")
    shared = spark.sparkContext.broadcast(_bitmap(several.select(F.col("g").alias("mini")), BITS))
    tidy(spark)
    return own.mapInArrow(lambda batches: run(batches, shared.value), schema).distinct()


def _may(a: str, b: str) -> str:
    """Whether two sets that share a shingle at these places can be similar enough, from sizes alone."""
    both = f"({a}.n + {b}.n)"
    return f"5 * {a}.n >= 4 * {b}.n AND 5 * {b}.n >= 4 * {a}.n AND 9 * (least({a}.at, {b}.at) + least({a}.n - {a}.at, {b}.n - {b}.at)) >= 4 * {both}"


def dealt(rows: DataFrame, by: list[str], k: int, rounds: int) -> DataFrame:
    """The rows of round k, dealt by the columns ``by``."""
    return rows if rounds == 1 else rows.where(F.pmod(F.xxhash64(*by), F.lit(rounds)) == k)


def in_rounds(spark: SparkSession, rounds: int, step: Callable[[int], DataFrame], what: str) -> DataFrame:
    """What ``step`` makes in each round, written; shuffle files of a round go before the next."""
    parts = []
    for k in range(rounds):
        if k:
            tidy(spark)
        parts.append(stored(step(k), what))
    return functools.reduce(DataFrame.union, parts)


def similar(every: Sets, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets' Jaccard similarity is at least 4/5.

    Whole sets travel only for pairs of which one in AGREE of the least hashes (SKETCH of each) is in
    common. Four fifths of them are expected to be in similar sets; a quarter or less, with a chance
    below 1e-19. Sets of up to SKETCH shingles are compared whole at once.
    """

    spark = every.docs.sparkSession

    def compared(of: DataFrame, part: Column, enough: Callable[[int, int, int], bool], what: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces_of(batches):
                pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
                sets_ = ((np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)) for x, y in pairs)
                good = [enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)) for x, y in sets_]
                yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

        ends = of.select(F.explode(F.array("u", "v")).alias("fp")).distinct()
        held = stored(among(every, ends, grams=part).withColumn("size", F.octet_length("grams").cast("long")), "near-sets")
        tidy(spark)
        a, b = held.select(F.col("fp").alias("u"), F.col("grams").alias("x")), held.select(F.col("fp").alias("v"), F.col("grams").alias("y"))
        moved = of.join(held.select(F.col("fp").alias("u"), "size"), "u").agg(F.sum("size")).first()[0]
        rounds = every.rounds(moved)
        out = in_rounds(spark, rounds, lambda k: dealt(of, ["u", "v"], k, rounds).join(a, "u").join(b, "v").select("u", "v", "x", "y").mapInArrow(run, "u long, v long"), what)
        discard(held)
        return out

    alike = compared(pairs, F.substring("grams", 1, 8 * SKETCH), lambda both, x, y: AGREE * both >= min(x, y), "near-alike")
    tidy(spark)
    links = compared(alike, F.col("grams"), lambda both, x, y: 9 * both >= 4 * (x + y), "near-links")
    discard(alike)
    return links


def links(every: Sets) -> DataFrame:
    """Pairs of similar sets that connect what all similar pairs connect."""
    spark = every.docs.sparkSession
    close = close_fingerprints(every.found)
    tidy(spark)
    none = similar(every, close)
    tidy(spark)
    keys = stored(prefixes(every), "near-prefixes")
    tidy(spark)
    shared = keys.groupBy("g").agg(F.count("*").alias("held")).where("held > 1")
    met = stored(keys.join(shared, "g"), "near-met")
    discard(keys)
    tidy(spark)
    score = met.groupBy("fp").agg(F.sum("held").alias("score"))
    scored = met.join(score, "fp")
    leader = scored.groupBy("g").agg(F.max(F.struct("score", "fp", "n", "at")).alias("l")).select("g", "l.fp", "l.n", "l.at")
    first = met.alias("a").join(leader.alias("b"), F.expr(f"a.g = b.g AND a.fp <> b.fp AND {_may('a', 'b')}"))
    least = lambda df: df.select(F.least("a.fp", "b.fp").alias("u"), F.greatest("a.fp", "b.fp").alias("v")).distinct()
    led = stored(least(first).join(close, ["u", "v"], "left_anti"), "near-pairs")
    tidy(spark)
    one = none.union(similar(every, led))
    discard(led)
    tidy(spark)
    comp = stored(connected_components(one).select(F.col("node").alias("fp"), "comp"), "near-comp")
    named = met.join(comp, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    mixed = named.groupBy("g").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("g")
    left = stored(named.join(mixed, "g", "left_semi"), "near-left")
    discard(met, close)
    large = left.groupBy("g").agg(F.count("*").alias("held")).where(F.col("held") > FEW).select("g")
    few = left.join(large, "g", "left_anti")
    second = few.alias("a").join(few.alias("b"), F.expr(f"a.g = b.g AND a.fp < b.fp AND a.comp <> b.comp AND {_may('a', 'b')}"))
    tidy(spark)
    pairs = stored(least(second), "near-pairs")
    tidy(spark)
    two = similar(every, pairs)
    discard(pairs)
    tidy(spark)
    pairs = all_blocks(every, left.join(large, "g", "left_semi").select("g", "fp", "comp"))
    tidy(spark)
    many = similar(every, pairs)
    discard(pairs, left, comp)
    tidy(spark)
    return one.union(two).union(many)


def _blocks(left: DataFrame) -> DataFrame:
    """``left`` with inside (whether a set is of its group's largest component), and the numbers of blocks of what is outer and inner to it."""
    sizes = left.groupBy("g", "comp").agg(F.count("*").alias("c"))
    groups = sizes.groupBy("g").agg(F.max_by("comp", F.struct("c", "comp")).alias("largest"), F.max("c").alias("inside"), F.sum("c").alias("all"))
    blocks = groups.select("g", "largest", F.ceil((F.col("all") - F.col("inside")) / BLOCK).alias("outer"), F.ceil(F.col("inside") / BLOCK).alias("inner"))
    return left.join(blocks, "g").withColumn("inside", F.col("comp") == F.col("largest"))


def in_blocks(found: DataFrame, left: DataFrame, k: int = 0, rounds: int = 1) -> DataFrame:
    """The pairs (u, v) of different components that can be similar, among the sets that share a shingle g; of round k alone.

    Sets outside the largest component of g are dealt into blocks, and so are its own; a task compares
    one of the former with one of either. Each set goes to as many tasks as there are blocks of the
    former (which are few after the leaders), and those to one for each other block besides. How many
    places that makes Spark can't tell, so they are merged with the sets and never broadcast.
    ``found`` has each set's size as n where its grams are cut already.
    """
    own = _blocks(left)
    mine = F.pmod(F.xxhash64("fp"), F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer")))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    place = lambda i, j, inside: F.struct(i.alias("i"), j.alias("j"), F.lit(inside).alias("within"))
    inner = F.transform(upto("outer"), lambda i: place(i, F.col("mine"), True))
    outer = F.concat(F.transform(upto("inner"), lambda j: place(F.col("mine"), j, True)), F.transform(upto("outer"), lambda j: place(F.least(j, F.col("mine")), F.greatest(j, F.col("mine")), False)))
    placed = own.withColumn("mine", mine).select("g", "fp", "comp", "inside", F.explode(F.when(F.col("inside"), inner).otherwise(outer)).alias("p"))
    placed = dealt(placed.select("g", "p.i", "p.j", "p.within", "fp", "comp", "inside"), ["g", "i", "j", "within"], k, rounds)
    size = F.col("n") if "n" in found.columns else F.expr("octet_length(grams) div 8")
    held = found.select("fp", F.substring("grams", 1, 8 * KEPT).alias("hashes"), size.alias("n"))
    rows = placed.hint("merge").join(held, "fp").select("g", "i", "j", "within", "fp", "comp", "inside", "hashes", "n")
    return rows.groupBy("g", "i", "j", "within").applyInArrow(_compared, "u long, v long").distinct()


def all_blocks(every: Sets, left: DataFrame) -> DataFrame:
    """:func:`in_blocks` of all rounds: places grow with the square of a group."""
    spark = every.docs.sparkSession
    held = among(every, left.select("fp").distinct(), grams=F.substring("grams", 1, 8 * KEPT), n=F.expr("octet_length(grams) div 8"))
    held = stored(held, "near-sets")
    tidy(spark)
    places = _blocks(left).agg(F.sum(F.when(F.col("inside"), F.col("outer")).otherwise(F.col("inner") + F.col("outer")))).first()[0]
    rounds = every.rounds(places and places * 8 * KEPT)
    parts = in_rounds(spark, rounds, lambda k: in_blocks(held, left, k, rounds), "near-parts")
    out = stored(parts.distinct(), "near-pairs")
    discard(held, parts)
    return out


def _compared(block: pa.Table) -> pa.Table:
    """Pairs of a block's sets of different components that can be similar; within the largest component's reach, one of it and one not."""
    block = block.combine_chunks()
    fp, comp, inside, within, n = (block[c].to_numpy() for c in ("fp", "comp", "inside", "within", "n"))
    lists = block["hashes"].to_pylist()
    hashes, number = np.unique(np.frombuffer(b"".join(lists), np.int64), return_inverse=True)
    row = np.repeat(np.arange(len(fp)), [len(x) // 8 for x in lists])
    several = np.bincount(number, minlength=len(hashes)) > 1
    kept = several[number]
    column, row = (np.cumsum(several) - 1)[number[kept]], row[kept]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    both = np.zeros((len(fp), len(fp)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, (at, at + COLUMNS)))
        has = np.zeros((len(fp), COLUMNS), np.float32)
        has[row[part], column[part] - at] = 1
        both += has @ has.T
    x, y = n[:, None], n[None, :]
    enough = np.where(np.maximum(x, y) <= KEPT, 9 * both >= 4 * (x + y), both >= SHARED)
    alike = enough & (5 * x >= 4 * y) & (5 * y >= 4 * x) & (comp[:, None] != comp[None, :]) & (fp[:, None] < fp[None, :])
    if len(fp) and within[0]:
        alike &= inside[:, None] != inside[None, :]
    u, v = np.nonzero(alike)
    return pa.table({"u": fp[u], "v": fp[v]})


def keep_one(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component of near copies, as :func:`simhash.keep_one` keeps them.

    Texts with fewer words than a shingle are one shingle; those without words are copies of each other.
    ``docs`` is read several times, so it should be a table rather than a long plan.
    """
    found = stored(names(docs, words), "near")
    tidy(docs.sparkSession)
    joined = links(Sets(docs, found, words, found.count()))
    comp = connected_components(joined).select(F.col("node").alias("fp"), "comp")
    discard(joined)
    tidy(docs.sparkSession)
    named = found.select("fp").distinct().join(comp, "fp", "left").select("fp", F.coalesce("comp", "fp").alias("comp"))
    out = keep_least(docs, found, named)
    tidy(docs.sparkSession)
    return out
