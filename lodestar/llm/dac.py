"""Token ids in directly addressable codes.

An id is split into chunks of 8 bits, lowest first. Level 0 holds the first chunk of every id and a
bitmap that says which go on; level k holds the chunks of those that do. With each bitmap goes a rank
directory (set bits before every 512), so the position of an id's next chunk is a rank, and any token
is read by as many lookups as it has chunks, without decoding what lies before it.

A file holds a run of whole documents: magic, sizes, document starts, then per level chunks, bitmap and
directory. Files are written in the order of doc_id, each by the task that holds its range.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_columns, new_path, open_shared, partitions, pieces_of, stored
from .tokens import encoder

MAGIC = b"LSDAC001"
BLOCK = 512
#: Ids from which a task starts a new file.
FILE_IDS = 1 << 22


def to_bytes(ids: np.ndarray, starts: np.ndarray, docs: list[int | None]) -> bytes:
    """A file of the ids (uint32); starts and doc_ids of its documents."""
    levels, left = [], ids.astype(np.uint32)
    while True:
        more = left > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits.reshape(-1, BLOCK // 8)).sum(1, dtype=np.int64))]).astype("<u4")
        levels.append(((left & 255).astype(np.uint8), bits, ranks))
        if not more.any():
            break
        left = left[more] >> 8
    null = np.array([d is None for d in docs], np.uint8)
    out = [MAGIC, struct.pack("<QQI", len(ids), len(docs), len(levels)), np.asarray(starts, "<u8").tobytes(), np.array([d or 0 for d in docs], "<i8").tobytes(), null.tobytes()]
    for chunks, bits, ranks in levels:
        out += [struct.pack("<QQQ", len(chunks), len(bits), len(ranks)), chunks.tobytes(), bits.tobytes(), ranks.tobytes()]
    return b"".join(out)


class Reader:
    """Random access to a file's bytes."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.n, docs, levels = struct.unpack_from("<QQI", raw, 8)
        at = 28

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        self.starts, ids, null = take("<u8", docs), take("<i8", docs), take("u1", docs)
        self.docs = [None if z else int(d) for d, z in zip(ids, null, strict=True)]
        self.levels = []
        for _ in range(levels):
            sizes = struct.unpack_from("<QQQ", raw, at)
            at += 24
            self.levels.append(tuple(take(k, n) for k, n in zip(("u1", "u1", "<u4"), sizes, strict=True)))
        if at != len(raw):
            raise ValueError("the file is cut short or too long")

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """Token i, by one lookup and one rank a level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // BLOCK
            own = bits[block * (BLOCK // 8) : (i >> 3) + 1].copy()
            own[-1] &= (1 << (i & 7)) - 1
            i = int(ranks[block]) + int(np.bitwise_count(own).sum())
            shift += 8
        raise ValueError("the last level goes on")

    def _rank(self, level: int, i: int) -> int:
        """How many of a level's first i chunks go on: the directory's count and the bits of one block."""
        _, bits, ranks = self.levels[level]
        block, rest = divmod(i, BLOCK)
        out = int(ranks[block])
        if rest:
            own = np.unpackbits(bits[block * (BLOCK // 8) : (i + 7) >> 3], count=rest, bitorder="little")
            out += int(own.sum())
        return out

    def part(self, a: int, b: int) -> np.ndarray:
        """Tokens a to b (excluded): on every level their chunks stand together, between two ranks."""
        if not 0 <= a <= b <= self.n:
            raise IndexError((a, b))
        out, at = np.zeros(b - a, "<u4"), np.arange(b - a)
        for k, (chunks, bits, _) in enumerate(self.levels):
            if a == b:
                break
            out[at] += chunks[a:b].astype(np.uint32) << np.uint32(8 * k)
            if k + 1 < len(self.levels):
                more = np.unpackbits(bits[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + b - a]
                at = at[np.flatnonzero(more)]
                a, b = self._rank(k, a), self._rank(k, b)
        return out

    def all(self) -> np.ndarray:
        out, at = np.zeros(self.n, "<u4"), None
        for k, (chunks, bits, _) in enumerate(self.levels):
            own = chunks.astype(np.uint32) << np.uint32(8 * k)
            if at is None:
                out += own
            else:
                out[at] += own
            more = np.flatnonzero(np.unpackbits(bits, count=len(chunks), bitorder="little"))
            at = more if at is None else at[more]
        return out


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Write every document's ids and the end id to files in ``folder``, by ascending doc_id (nulls first).

    Returns a row per file in their order: part, nth, path, n_tokens, n_docs. Documents are dealt out by
    ranges of doc_id and sorted within, so equal doc_ids (repeated rows) stand side by side, by text.
    A lost executor's files are written anew under other names; the returned rows name those that count.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, nth = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end, ids, names, sizes = np.array([end_id], "<u4").tobytes(), [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal nth, ids, names, sizes
            path = f"{folder}/{part:06d}-{nth:06d}-{uuid.uuid4().hex}.dac"
            starts = np.cumsum([0, *sizes[:-1]])
            with open_shared(path, "wb") as f:
                f.write(to_bytes(np.frombuffer(b"".join(ids), "<u4"), starts, names))
            row = [part, nth, path, sum(sizes), len(names)]
            nth, ids, names, sizes = nth + 1, [], [], []
            return pa.RecordBatch.from_pylist([dict(zip(("part", "nth", "path", "n_tokens", "n_docs"), row, strict=True))], schema=pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("path", pa.string()), ("n_tokens", pa.int64()), ("n_docs", pa.int64())]))

        held = 0
        for batch in pieces_of(batches):
            for doc, own in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                ids.append(own + end)
                names.append(doc)
                sizes.append(len(own) // 4 + 1)
                held += sizes[-1]
                if held >= FILE_IDS:
                    yield flush()
                    held = 0
        if names:
            yield flush()

    dealt = doc_columns(docs).repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return stored(dealt.mapInArrow(run, "part int, nth int, path string, n_tokens long, n_docs long"), "dac-files")


def read(files: DataFrame) -> DataFrame:
    """Per document, read from the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32.

    Each document is read for itself, by its file's rank directories.

    The number of files bounds what the driver adds up: a first token for each.
    """
    spark = files.sparkSession
    rows = files.select("part", "nth", "path", "n_tokens").toPandas().sort_values(["part", "nth"])
    rows["base"] = rows["n_tokens"].cumsum() - rows["n_tokens"]
    rows["base"] = rows["base"].astype("int64")
    listed = spark.createDataFrame(rows[["path", "base"]], "path string, base long") if len(rows) else spark.createDataFrame([], "path string, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_shared(path, "rb") as f:
                    r = Reader(f.read())
                starts = [*r.starts.tolist(), r.n]
                crc = [zlib.crc32(r.part(a, b).tobytes()) for a, b in zip(starts, starts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(r.docs, pa.int64()), pa.array([base + a for a in starts[:-1]], pa.int64()), pa.array(np.diff(starts), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.repartition(max(1, min(len(rows), partitions(spark)))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write the files and read every document back."""
    return read(write(docs, tokenizer, end_id, folder or new_path(spark, "dac")))
