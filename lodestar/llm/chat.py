"""Chat formatting by columnar byte assembly.

A turn is a header, its text and a footer. Control strings inside a text (or a role) are escaped by a
backslash after their first character; those that already have backslashes there get one more, so
escaping can be undone. For a batch of turns the lengths of all segments give cumulative offsets, the
offsets give scatter indices, and headers, contents and footers are copied in numpy into one
preallocated buffer that becomes the Arrow column without another copy.

Turns arrive sorted by conversation and turn; a conversation is written in parts of bounded size, so
one of any length passes through without being gathered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

# The control strings, and each role's header and footer.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
FRAMES = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]\n"), "assistant": ("<s>", "</s>\n")}
OTHER = ("<s>[INST]", "\n", "[/INST]</s>\n")

_ESCAPED = re.compile(r"(?:(<)\\(\\*(?:/?s>|</?SYS>>)))|(?:(\[)\\(\\*/?INST\]))")
_TURN = re.compile(r"<<SYS>>\n(.*?)\n<</SYS>>\n|\[INST\] (.*?) \[/INST\]\n|<s>\[INST\](.*?)\n(.*?)\[/INST\]</s>\n|<s>(.*?)</s>\n", re.S)
#: Turns assembled at a time, and bytes of their contents.
TURNS, BYTES = 2048, 4 << 20


def escape(column: pa.Array) -> pa.Array:
    out = pc.replace_substring_regex(column, r"<(\\*/?s>|\\*</?SYS>>)", r"<\\\1")
    return pc.replace_substring_regex(out, r"\[(\\*/?INST\])", r"[\\\1")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: (m[1] or m[3]) + (m[2] or m[4]), text)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_string array."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), at


def _scatter(out: np.ndarray, where: np.ndarray, source: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
    """Copy source[starts[i] : starts[i] + sizes[i]] to out[where[i]:] for all i at once."""
    before = np.cumsum(sizes) - sizes
    index = np.arange(int(sizes.sum()))
    out[index + np.repeat(where - before, sizes)] = source[index + np.repeat(starts - before, sizes)]


def assemble(roles: list[str], texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of the formatted turns; where each turn begins and ends in it, and its content's span."""
    frames: dict[str, int] = {}
    codes = np.array([frames.setdefault(r, len(frames)) for r in roles], np.int64)
    parts: list[tuple[bytes, bytes]] = []
    for r in frames:
        if r in FRAMES:
            head, foot = FRAMES[r]
        else:
            name = escape(pa.array([r.replace("\\", "\\\\").replace("\n", "\\n")], pa.large_string()))[0].as_py()
            head, foot = OTHER[0] + name + OTHER[1], OTHER[2]
        parts.append((head.encode(), foot.encode()))
    sizes = np.array([[len(h), len(f)] for h, f in parts], np.int64).reshape(-1, 2)
    fixed = np.frombuffer(b"".join(h + f for h, f in parts), np.uint8)
    at = np.cumsum(sizes.sum(1)) - sizes.sum(1)
    data, offsets = _buffers(escape(texts.cast(pa.large_string())))
    length = np.diff(offsets)
    head, foot = sizes[codes, 0], sizes[codes, 1]
    total = head + length + foot
    ends = np.cumsum(total)
    starts = ends - total
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    _scatter(out, starts, fixed, at[codes], head)
    _scatter(out, starts + head, data, offsets[:-1], length)
    _scatter(out, starts + head + length, fixed, at[codes] + head, foot)
    return out, starts, ends, np.stack([starts + head, starts + head + length])


_SCHEMA = "conv_id long, part long, n_turns int, formatted string, loss array<struct<start:int,end:int>>"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        sizes = np.cumsum([0, *pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()])
        while at < batch.num_rows:
            to = min(batch.num_rows, at + TURNS, max(at + 1, int(np.searchsorted(sizes, sizes[at] + BYTES))))
            yield batch.slice(at, to - at)
            at = to


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Conversations as text with a loss mask: conv_id, part, n_turns, formatted, loss.

    A conversation's parts, in the order of ``part``, make up its text; ``loss`` has byte spans of a
    part's assistant contents. Null texts and roles count as empty; turns are ordered by turn (nulls
    first), ties by role and text; rows of a null conv_id are one conversation; repeated rows are
    repeated turns; an empty table gives no rows; other columns play no part.
    """
    spark = conversations.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, part = None, -1
        fresh = True
        for batch in _chunks(batches):
            ids, roles = batch.column("conv_id").to_pylist(), batch.column("role").to_pylist()
            out, starts, ends, spans = assemble(roles, batch.column("text"))
            firsts = [i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]]
            names, nths, sizes, offsets, loss = [], [], [], [0], []
            for a, b in zip(firsts, [*firsts[1:], len(ids)], strict=True):
                part = part + 1 if not fresh and ids[a] == conv else 0
                conv, fresh = ids[a], False
                names.append(conv)
                nths.append(part)
                sizes.append(b - a)
                offsets.append(int(ends[b - 1]))
                loss.append([{"start": int(spans[0, i] - starts[a]), "end": int(spans[1, i] - starts[a])} for i in range(a, b) if roles[i] == "assistant"])
            formatted = pa.Array.from_buffers(pa.string(), len(names), [None, pa.py_buffer(np.array(offsets, np.int32)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(nths, pa.int64()), pa.array(sizes, pa.int32()), formatted, pa.array(loss, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["conv_id", "part", "n_turns", "formatted", "loss"])

    clean = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = clean.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, _SCHEMA)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted part."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text between turns")
        at = m.end()
        system, user, role, other, assistant = m.groups()
        if system is not None:
            out.append(("system", unescape(system)))
        elif user is not None:
            out.append(("user", unescape(user)))
        elif assistant is not None:
            out.append(("assistant", unescape(assistant)))
        else:
            name = re.sub(r"\\(.)", lambda x: "\n" if x[1] == "n" else x[1], unescape(role))
            out.append((name, unescape(other)))
    if at != len(formatted):
        raise ValueError("text after the last turn")
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from the formatted text and its mask alone.

    Parts of a conversation stand together in a task, as :func:`format_conversations` yields them;
    the hashes run on from part to part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        conv, state = None, None

        def close() -> None:
            n, turns, chars, loss, size = state
            rows.append([conv, n, turns.hexdigest(), chars, loss.hexdigest(), size])

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            rows.clear()
            return out

        for batch in batches:
            for r in batch.to_pylist():
                if state is None or r["part"] == 0:
                    if state is not None:
                        close()
                    conv, state = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                raw = r["formatted"].encode()
                state[4] += len(r["formatted"])
                for role, text in parse(r["formatted"]):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for s in r["loss"]:
                    text = unescape(raw[s["start"] : s["end"]].decode())
                    state[2] += len(text)
                    state[3].update(text.encode())
            yield flush()
        if state is not None:
            close()
            yield flush()

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
