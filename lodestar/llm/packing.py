"""Best-fit packing by a configuration linear program over the length histogram.

Documents become token ids plus an end id, cut into pieces of at most ``capacity``. Only counts of the
at most ``capacity`` distinct lengths reach the driver. There the configuration program (fewest
sequences whose piece counts cover the histogram) is solved by multiplicative weights over groups of
neighbouring lengths: a knapsack dynamic program prices the heaviest configuration, its lengths lose
weight as they are covered, and the weights under which the program's bound is highest are kept as the
lengths' prices. Rounding takes configurations of single lengths in whole numbers, dearest first, at
these prices and again with weights that fall as a length's own pieces are covered, until every length
is covered or no configuration is worth a sequence. What is left over is packed best-fit, into room that
the configurations leave and new sequences.

Pieces then find their place without meeting: their rank among equal lengths (its worker's running
count plus the counts of earlier partitions) points into the plan, whose size depends on the histogram
alone. No row is sorted and no group collected, however many pieces share a length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import doc_columns, pieces_of, stored
from .tokens import encoder

CAPACITY = 2048
END_ID = 0
#: Groups of lengths and rounds of the linear program, and the share of the scarcest length a round covers.
GROUPS, ROUNDS, STEP = 64, 600, 0.1
#: How strongly a length's weight follows its uncovered share while rounding. The first value places most
#: pieces; the result of the second is taken where it saves over SAVES of the sequences.
ETAS, SAVES = (0.02, 0.3), 0.005
#: Lengths that one configuration is priced from, and the least worth of a configuration (1: a whole sequence).
PRICED, WORTH = 192, 0.98

PIECES = "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, part int, nth long"


def tokenized_pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: start counts its ids before the piece; part and nth number equal lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in pieces_of(batches):
            rows: list[list] = [[] for _ in range(7)]
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    own = ids[at : at + step]
                    n = len(own) // 4
                    for c, x in zip(rows, (doc, k, at // 4, n, own, zlib.crc32(own), int(seen[n])), strict=True):
                        c.append(x)
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip([*rows[:6], [part] * len(rows[0]), rows[6]], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64()), strict=True)],
                ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "part", "nth"],
            )

    return doc_columns(docs).mapInArrow(run, PIECES)


def price(weights: np.ndarray, lengths: np.ndarray, capacity: int, left: np.ndarray | None = None) -> dict[int, int]:
    """The heaviest configuration (length index: count) of what is left, by a bounded knapsack over 0 to capacity."""
    best, taken = np.zeros(capacity + 1), []
    most_of = capacity // lengths if left is None else np.minimum(left, capacity // lengths)
    for k, (length, most) in enumerate(zip(lengths.tolist(), most_of.tolist(), strict=True)):
        n = 1
        while most > 0:  # 1, 2, 4, ... pieces and the rest make any count
            n = min(n, most)
            size = n * length
            if size > capacity:
                break
            value = best[: capacity + 1 - size] + n * weights[k]
            taken.append((k, n, size, value > best[size:]))
            np.maximum(best[size:], value, out=best[size:])
            most -= n
            n *= 2
    out: dict[int, int] = {}
    c = capacity
    for k, n, size, better in reversed(taken):
        if c >= size and better[c - size]:
            out[k] = out.get(k, 0) + n
            c -= size
    return out


def prices(lengths: np.ndarray, need: np.ndarray, capacity: int) -> np.ndarray:
    """What a piece of each length is worth, in sequences: the program's dual values, by multiplicative weights.

    Lengths (longest first) are solved in groups of equal volume that stand for their longest length;
    within a group the worth goes by length.
    """
    volume = np.cumsum(lengths * need)
    group = np.unique(np.minimum((volume - 0.5) * GROUPS // volume[-1], GROUPS - 1), return_inverse=True)[1]
    longest = np.maximum.reduceat(lengths, np.flatnonzero(np.diff(group, prepend=-1)))
    wanted, covered = np.bincount(group, need), np.zeros(len(longest))
    best, bound = longest / capacity, 0.0
    for _ in range(ROUNDS):
        weights = longest / capacity * np.exp(-covered)
        config = price(weights, longest, capacity)
        value = sum(weights[k] * c for k, c in config.items())
        if wanted @ weights / value > bound:
            bound, best = wanted @ weights / value, weights / value
        step = STEP * min(wanted[k] / c for k, c in config.items())
        for k, c in config.items():
            covered[k] += c * step / wanted[k]
    return best[group] * lengths / longest[group]


def solve(counts: dict[int, int], capacity: int, eta: float = ETAS[0], rounds: int | None = None) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Configurations ((length, count), ...) with whole numbers of sequences, in the order they were priced.

    Each is the dearest of some of the lengths that are left: an eighth of PRICED are the longest, the
    others drawn evenly (with a fixed seed). At first it is taken half as often as what is left allows,
    so that the weights can change, then as often as it allows, which covers a length for good: so there
    are at most two rounds a length, however many pieces there are.
    """
    rng = np.random.default_rng(1)
    lengths = np.array(sorted(counts, reverse=True))
    need = np.array([counts[int(x)] for x in lengths])
    worth = prices(lengths, need, capacity)
    left, out, poor = need.copy(), [], 0
    while left.any() and poor < 3 and (rounds is None or len(out) < rounds):
        on = np.flatnonzero(left)
        whole = len(on) <= PRICED
        if not whole:
            first = PRICED // 8
            on = np.sort(np.concatenate([on[:first], rng.choice(on[first:], PRICED - first, replace=False)]))
        config = {int(on[k]): c for k, c in price(worth[on] * np.exp(eta * left[on] / need[on]), lengths[on], capacity, left[on]).items()}
        if sum(worth[k] * c for k, c in config.items()) < WORTH:
            if whole:
                break
            poor += 1
            continue
        poor = 0
        times = min(int(left[k]) // c for k, c in config.items())
        if len(out) < len(lengths):
            times = -(-times // 2)
        for k, c in config.items():
            left[k] -= c * times
        out.append((tuple((int(lengths[k]), c) for k, c in sorted(config.items())), times))
    return out


def best_fit(counts: dict[int, int], capacity: int, begun: dict[tuple[tuple[int, int], ...], int] | None = None) -> dict[tuple[tuple[int, int], ...], int]:
    """Best-fit decreasing over a histogram: each length, longest first, goes into the fullest sequences that take it, those of ``begun`` included."""
    open_: dict[int, dict[tuple, int]] = {}  # free space: configuration: how many sequences
    spaces: list[int] = []

    def put(free: int, config: tuple, n: int) -> None:
        if free not in open_:
            open_[free] = {}
            bisect.insort(spaces, free)
        open_[free][config] = open_[free].get(config, 0) + n

    for config, n in (begun or {}).items():
        put(capacity - sum(k * c for k, c in config), config, n)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(spaces, length)
            if at == len(spaces):
                per = capacity // length
                if full := left // per:
                    put(capacity - per * length, ((length, per),), full)
                if rest := left % per:
                    put(capacity - rest * length, ((length, rest),), 1)
                break
            free = spaces[at]
            config, n = next(iter(open_[free].items()))
            per = min(free // length, left)
            m = min(n, left // per)
            open_[free][config] -= m
            if not open_[free][config]:
                del open_[free][config]
                if not open_[free]:
                    del open_[free]
                    spaces.pop(at)
            put(free - per * length, (*config, (length, per)), m)
            left -= per * m
    out: dict[tuple, int] = {}
    for configs in open_.values():
        for c, n in configs.items():
            out[c] = out.get(c, 0) + n
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY, rounds: int | None = None) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Configurations and how many sequences use each; together they hold exactly ``counts``."""
    counts = {k: v for k, v in counts.items() if v}
    if not counts:
        return []
    full = counts.pop(capacity, 0)
    found: list[dict] = []
    for eta in ETAS if counts else ():
        left, begun = dict(counts), {}
        for config, n in solve(counts, capacity, eta, rounds):
            begun[config] = begun.get(config, 0) + n
            for k, c in config:
                left[k] -= c * n
        found.append(best_fit({k: v for k, v in left.items() if v}, capacity, begun))
    best = found[0] if found else {}
    for other in found[1:]:
        if sum(other.values()) < (1 - SAVES) * sum(best.values()):
            best = other
    return ([(((capacity, 1),), full)] if full else []) + list(best.items())


def slots(found: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, tuple[list[int], list[tuple[int, int, int]]]]:
    """For each length: first rank of each run, and its (first sequence, pieces a sequence, offset)."""
    out: dict[int, tuple[list[int], list[tuple[int, int, int]]]] = {}
    next_rank: dict[int, int] = {}
    sequence = 0
    for config, n in found:
        offset = 0
        for length, c in config:
            ranks, runs = out.setdefault(length, ([], []))
            ranks.append(next_rank.get(length, 0))
            runs.append((sequence, c, offset))
            next_rank[length] = next_rank.get(length, 0) + n * c
            offset += length * c
        sequence += n
    return out


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, rounds: int | None = None) -> DataFrame:
    """Every piece of every document with its ids, sequence_id and offset; offsets have no gaps.

    A null text counts as empty (its piece is the end id alone), a null doc_id stays null, repeated rows
    are packed as often as they occur, an empty table gives no rows, other columns play no part, and
    texts of any length are encoded whole.
    """
    pieces = stored(tokenized_pieces(docs, tokenizer, end_id, capacity), "pieces")
    held = stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = slots(plan(counts, capacity, rounds))
    before = held.select("part", "length", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for n in np.unique(length):
            own = np.flatnonzero(length == n)
            ranks, runs = where[int(n)]
            first, per, offset = np.array(runs).T[:, np.searchsorted(ranks, rank.to_numpy()[own], side="right") - 1]
            into = rank.to_numpy()[own] - np.array(ranks)[np.searchsorted(ranks, rank.to_numpy()[own], side="right") - 1]
            seq[own], off[own] = first + into // per, offset + into % per * n
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    return ranked.withColumn("place", place("length", "rank")).select("doc_id", "piece", "start", "length", "ids", "ids_crc32", "place.sequence_id", "place.offset")
