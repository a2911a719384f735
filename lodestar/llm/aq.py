"""Approximate nearest neighbours by additive quantisation.

A vector (scaled to length one) is written as a sum of full-dimensional codewords, one from each of
several codebooks. Codebooks are trained on a bounded sample, each by k-means on what the ones before
left over; every vector is then encoded by beam search, which keeps the best partial sums at each
codebook instead of one. The sum's length is stored with the code.

A query is scored against codes alone: its inner products with all codewords are tables, a code's
score is a sum of look-ups divided by the stored length. The vectors with the best scores are ranked
again by the exact cosine of the original vectors in double precision.

Encoding writes blocks to the shared folder: codes, lengths and vectors of a bounded number of rows.
The stated queries meet all blocks: a task reads some blocks and the queries of some, scores the codes,
ranks each block's best again where it stands, and sends on the k best of all its blocks. So neither
codes, candidates nor vectors are shuffled, and a task's memory doesn't grow with the table.
"""

from __future__ import annotations

import bisect
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, open_shared, small_batches, stored

#: Codebooks, codewords in each, vectors they are trained on, partial sums kept while encoding.
BOOKS, WORDS, SAMPLE, BEAM = 16, 256, 8192, 4
#: Dimensions (of those in the sample, the commonest) that have codebooks; others are scored by their vectors.
DIMENSIONS = 4
#: Candidates of each block and query that are ranked again.
CANDIDATES = 128
#: Vectors, and bytes of them, in a block; queries and vectors that a task takes together at least.
BLOCK, BLOCK_BYTES = 1 << 15, 1 << 25
QUERIES, VECTORS = 1024, 1 << 18


@dataclass
class Books:
    words: np.ndarray  # (books, words, dimensions), float32


def train(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 6, seed: int = 7) -> Books:
    rng, left, out = np.random.default_rng(seed), sample.astype(np.float32).copy(), []
    for _ in range(books):
        centres = left[rng.choice(len(left), min(words, len(left)), replace=False)].copy()
        for _ in range(rounds):
            nearest = (left @ centres.T * 2 - (centres * centres).sum(1)).argmax(1)
            count = np.bincount(nearest, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, nearest, left)
            centres[count > 0] = sums[count > 0] / count[count > 0, None]
        nearest = (left @ centres.T * 2 - (centres * centres).sum(1)).argmax(1)
        left -= centres[nearest]
        out.append(np.pad(centres, ((0, words - len(centres)), (0, 0)), mode="edge"))
    return Books(np.stack(out))


def encode(books: Books, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, books) of uint8 and the lengths of their sums, by beam search over all codebooks."""
    n, (m, k, d) = len(x), books.words.shape
    codes, left = np.zeros((n, 1, 0), np.uint8), x[:, None, :].astype(np.float32)
    rows = np.arange(n)[:, None]
    for b in range(m):
        own = books.words[b]
        cost = (left * left).sum(2)[:, :, None] - 2 * (left.reshape(-1, d) @ own.T).reshape(n, -1, k) + (own * own).sum(1)
        flat = cost.reshape(n, -1)
        best = np.empty((n, min(beam, flat.shape[1]) if b < m - 1 else 1), np.int64)
        for j in range(best.shape[1]):
            best[:, j] = flat.argmin(1)
            flat[rows[:, 0], best[:, j]] = np.inf
        left = left[rows, best // k] - own[best % k]
        codes = np.concatenate([codes[rows, best // k], (best % k).astype(np.uint8)[:, :, None]], axis=2)
    return codes[:, 0], np.linalg.norm(x - left[:, 0], axis=1).astype(np.float32)


def scores(books: Books, codes: np.ndarray, lengths: np.ndarray, queries: np.ndarray, rows: int = 2048) -> np.ndarray:
    """(queries, codes): sums of look-ups in the queries' tables over the codes' lengths, in float32."""
    tables = np.ascontiguousarray(books.words @ queries.astype(np.float32).T)  # (books, words, queries)
    out = np.empty((len(queries), len(codes)), np.float32)
    own = codes.astype(np.int64)
    for i in range(0, len(codes), rows):
        part = own[i : i + rows]
        total = tables[0][part[:, 0]]
        for m in range(1, len(tables)):
            total += tables[m][part[:, m]]
        out[:, i : i + rows] = (total / lengths[i : i + rows, None]).T
    return out


def top(scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest scores; of equal ones the first places."""
    if len(scores) <= n:
        return np.arange(len(scores))
    edge = np.partition(scores, len(scores) - n)[len(scores) - n]
    above = np.flatnonzero(scores > edge)
    return np.concatenate([above, np.flatnonzero(scores == edge)[: n - len(above)]])


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and its vector in doubles: neither null nor zero, all components finite."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component near one, so that no square over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _save(path: str, **arrays: np.ndarray) -> None:
    raw = io.BytesIO()
    np.savez(raw, **arrays)
    with open_shared(path, "wb") as f:
        f.write(raw.getvalue())


def _load(path: str) -> dict[str, np.ndarray]:
    with open_shared(path, "rb") as f, np.load(io.BytesIO(f.read())) as z:
        return {k: z[k] for k in z.files}


def _groups(sizes: list[int], least: int) -> list[list[int]]:
    """Consecutive places whose sizes add up to ``least`` or more; the last group may be smaller."""
    out, now, held = [], [], 0
    for i, n in enumerate(sizes):
        if n:
            now.append(i)
            held += n
        if held >= least:
            out.append(now)
            now, held = [], 0
    return [*out, now] if now else out


def nearest(spark: SparkSession, embeddings: DataFrame, every: int = 50, k: int = 5, candidates: int = CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found to each vector whose vec_id is divisible by ``every``.

    Vectors null, zero or with null or non-finite components take no part, nor do rows without a vec_id,
    which no result could name. Vectors are near only to those of their own dimension. Rows that repeat
    a vec_id are rows like others: each is a candidate to all but itself, and each is a query if its
    vec_id is one. Ties go to the smaller vec_id. With fewer than k others all are returned; an empty
    table gives no rows; other columns play no part.
    """
    small_batches(spark)
    rows, folder = usable(embeddings), new_path(spark, "aq-blocks")
    drawn = rows.orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).select("v").toArrow()["v"].to_pylist()
    by_size: dict[int, list] = {}
    for v in drawn:
        by_size.setdefault(len(v), []).append(v)
    chosen = sorted(by_size, key=lambda d: (-len(by_size[d]), d))[:DIMENSIONS]
    # of fixed size: codebooks of a few dimensions
    shared = spark.sparkContext.broadcast({d: train(_unit(_scaled(np.array(by_size[d])))).words for d in chosen})

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = {d: Books(w) for d, w in shared.value.items()}
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush(d: int) -> pa.RecordBatch:
            ids, x = (np.concatenate(a) for a in zip(*held.pop(d), strict=True))
            order = np.argsort(ids, kind="stable")  # of equal scores the smaller ids come first
            ids, x = ids[order], x[order]
            codes, lengths = np.zeros((len(x), 0), np.uint8), np.zeros(0, np.float32)
            if d in books:
                done = [encode(books[d], _unit(_scaled(x[i : i + 512]))) for i in range(0, len(x), 512)]
                codes, lengths = (np.concatenate(a) for a in zip(*done, strict=True))
            path, at = f"{folder}/{uuid.uuid4().hex}", np.flatnonzero(ids % every == 0)
            _save(f"{path}.block", ids=ids, x=x, codes=codes, lengths=lengths)
            if len(at):
                _save(f"{path}.queries", ids=ids[at], x=x[at], at=at)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([d]), pa.array([len(x)]), pa.array([len(at)])], ["path", "d", "n", "asked"])

        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            values, starts = batch.column(1).flatten().to_numpy(), np.cumsum(sizes) - sizes
            for d in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == d)
                held.setdefault(d, []).append((batch.column(0).to_numpy()[own], values[starts[own, None] + np.arange(d)]))
                n = sum(len(i) for i, _ in held[d])
                if n >= BLOCK or 8 * n * d >= BLOCK_BYTES:
                    yield flush(d)
        for d in list(held):
            yield flush(d)

    # a row a block, at most one more a partition and dimension than the rows fill
    blocks = stored(rows.mapInArrow(index, "path string, d long, n long, asked long"), "aq-listed").orderBy("d", "path").collect()
    tasks = max(1, 2 * spark.sparkContext.defaultParallelism)
    places: list[tuple[list[int], list[list[int]], list[list[int]]]] = []
    for d in sorted({b["d"] for b in blocks}):
        own = [i for i, b in enumerate(blocks) if b["d"] == d]
        asked = _groups([blocks[i]["asked"] for i in own], QUERIES)
        # fewer vectors a task where that keeps all cores at work
        each = min(VECTORS, sum(blocks[i]["n"] for i in own) * max(1, len(asked)) // tasks + 1)
        places.append((own, asked, _groups([blocks[i]["n"] for i in own], each)))
    ends = np.cumsum([len(a) * len(c) for _, a, c in places]).tolist()
    paths = spark.sparkContext.broadcast([b["path"] for b in blocks])  # 100 bytes for every 32,768 vectors
    if not ends or not ends[-1]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in (u for batch in batches for u in batch.column(0).to_pylist()):
            p = bisect.bisect_right(ends, unit)
            own, asked, chunks = places[p]
            i, j = divmod(unit - (ends[p - 1] if p else 0), len(chunks))
            parts = [(own[g], _load(f"{paths.value[own[g]]}.queries")) for g in asked[i]]
            ids, x, at = (np.concatenate([q[name] for _, q in parts]) for name in ("ids", "x", "at"))
            home = np.concatenate([np.full(len(q["ids"]), b) for b, q in parts])
            yield _best(ids, x, home, at, ((own[g], _load(f"{paths.value[own[g]]}.block")) for g in chunks[j]), shared.value, k, candidates)

    units = spark.range(0, ends[-1], 1, min(ends[-1], 20_000))
    found = units.mapInArrow(search, "query_id long, home long, at long, vec_id long, score double")
    best = Window.partitionBy("home", "at").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(ids: np.ndarray, x: np.ndarray, home: np.ndarray, at: np.ndarray, blocks: Iterator[tuple[int, dict]], books: dict[int, np.ndarray], k: int, candidates: int) -> pa.RecordBatch:
    """The k nearest rows of the blocks to each query, by exact cosine of the candidates."""
    q = _scaled(x)
    size = np.sqrt((q * q).sum(1))
    near: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64))] * len(q)
    for number, block in blocks:
        y = _scaled(block["x"])
        y_size = np.sqrt((y * y).sum(1))
        for a in range(0, len(q), 256):
            part = slice(a, a + 256)
            if block["codes"].shape[1]:
                guess = scores(Books(books[x.shape[1]]), block["codes"], block["lengths"], q[part])
            else:
                guess = (q[part] / size[part, None] @ (y / y_size[:, None]).T).astype(np.float32)
            for n in range(len(guess)):
                own = a + n
                if home[own] == number:
                    guess[n, at[own]] = -np.inf
                c = top(guess[n], candidates)
                c = c[guess[n, c] > -np.inf]
                exact = (y[c] * q[own]).sum(1) / (y_size[c] * size[own])
                s, v = np.concatenate([near[own][0], exact]), np.concatenate([near[own][1], block["ids"][c]])
                first = np.lexsort((v, -s))[:k]
                near[own] = s[first], v[first]
    count = [len(s) for s, _ in near]
    columns = [np.repeat(ids, count), np.repeat(home, count), np.repeat(at, count), np.concatenate([v for _, v in near]), np.concatenate([s for s, _ in near])]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "home", "at", "vec_id", "score"])
