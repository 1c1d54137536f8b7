"""Conversations as training text, assembled column by column.

Each batch of turns becomes one preallocated Arrow buffer: lengths of all segments (header, role, line break, content, end) give offsets
by a running sum, and one scatter by those offsets copies them. Control strings inside contents are escaped reversibly: `<`, any number of backslashes and `|`
get one backslash more, so neither mark of the template can stand inside a turn.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bounded_batches
from .words import text_buffer

# The template's marks.
START, BREAK, STOP = b"<|im_start|>", b"\n", b"<|im_end|>\n"
FORMATTED = "conv_id long, n_turns long, formatted string, loss array<long>"


def escaped(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\1\\|")


def unescaped(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\\\|", r"<\1|")


def escaped_role(roles: pa.Array) -> pa.Array:
    """Roles end at the line break, so theirs is escaped too: ~ as ~0, line break as ~1."""
    return escaped(pc.replace_substring(pc.replace_substring(roles, "~", "~0"), "\n", "~1"))


def unescaped_role(roles: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(unescaped(roles), "~1", "\n"), "~0", "~")


def _spread(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Joins column after column, row by row. parts: (bytes, n + 1 offsets) of each column. Returns the bytes and all segments' offsets, by row and column."""
    lengths = np.stack([np.diff(o) for _, o in parts], 1)
    at = np.zeros(lengths.size + 1, np.int64)
    np.cumsum(lengths.reshape(-1), out=at[1:])
    out = np.empty(at[-1], np.uint8)
    first = at[:-1].reshape(lengths.shape)
    for k, (data, o) in enumerate(parts):
        n = lengths[:, k]
        out[np.arange(len(data)) + np.repeat(first[:, k] - o[:-1], n)] = data
    return out, at


def _same(mark: bytes, rows: int) -> tuple[np.ndarray, np.ndarray]:
    return np.tile(np.frombuffer(mark, np.uint8), rows), np.arange(rows + 1, dtype=np.int64) * len(mark)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all turns, the n + 1 offsets of turns in it, and first and end byte of each content."""
    n = len(roles)
    columns = [_same(START, n), text_buffer(escaped_role(roles)), _same(BREAK, n), text_buffer(escaped(texts)), _same(STOP, n)]
    out, at = _spread(columns)
    grid = at[:-1].reshape(n, 5)
    return out, np.append(grid[:, 0], at[-1]), grid[:, 3], grid[:, 4]


def _conversations(batches):
    """Turns sorted by conversation to whole conversations; of one that goes on in the next batch, the turns wait."""
    waiting = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if waiting is not None:
            t = pa.concat_tables([waiting, t])
        ids = t["conv_id"].combine_chunks()
        last = ids[len(ids) - 1] if len(ids) else None
        same = pc.is_null(ids) if last is None or not last.is_valid else pc.fill_null(pc.equal(ids, last), False)
        keep = len(ids) - int(pc.sum(same).as_py() or 0)
        waiting = t.slice(keep)
        if keep:
            yield _format(t.slice(0, keep))
    if waiting is not None and len(waiting):
        yield _format(waiting)


def _format(t: pa.Table) -> pa.RecordBatch:
    t = t.combine_chunks()
    ids, roles, texts = (t[c].combine_chunks() for c in ("conv_id", "role", "text"))
    roles, texts = (pc.fill_null(c, "").cast(pa.large_string()) for c in (roles, texts))
    out, turns, begin, end = assemble(roles, texts)
    value, none = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), np.asarray(pc.is_null(ids))
    first = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (none[1:] != none[:-1])]))
    bound = np.append(first, len(value))
    whole = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(turns[bound].astype(np.int64)), pa.py_buffer(out))
    # The loss mask: bytes of each assistant's content, from the start of its conversation.
    mine = np.flatnonzero(np.asarray(pc.equal(roles, "assistant")))
    conv = np.searchsorted(first, mine, "right") - 1
    spans = np.stack([begin[mine], end[mine]], 1) - turns[first][conv][:, None]
    lists = pa.ListArray.from_arrays(pa.array((np.searchsorted(conv, np.arange(len(first) + 1)) * 2).astype(np.int32)), pa.array(spans.reshape(-1), pa.int64()))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array(np.diff(bound), pa.int64()), whole.cast(pa.string()), lists], ["conv_id", "n_turns", "formatted", "loss"])


def formatted_chats(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of conversations (conv_id, turn, role, text; other columns are ignored): conv_id, n_turns, formatted, loss.

    Turns are in order of turn, then role, then text; a null turn comes first. Null roles and texts count as empty; turns of a null conv_id are one
    conversation. loss holds the bounds in bytes, in pairs, of the contents of turns whose role is `assistant`. No rows give no rows.
    Conversations are dealt out by conv_id and sorted on disk; a task holds a batch and the conversation at its end.
    """
    bounded_batches(conversations.sparkSession)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_conversations, FORMATTED)


def parsed(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """Role and content of each turn of a formatted conversation, as escaped."""
    turns = []
    for turn in formatted.split(STOP)[:-1]:
        role, _, content = turn[len(START) :].partition(BREAK)
        turns.append((role, content))
    return turns


def _read_back(batches):
    for batch in batches:
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        rows = []
        for raw, loss in zip(texts, batch.column(3).to_pylist(), strict=True):
            turns = parsed(raw)
            roles = unescaped_role(pa.array([r for r, _ in turns], pa.binary()).cast(pa.large_string()))
            contents = unescaped(pa.array([c for _, c in turns], pa.binary()).cast(pa.large_string()))
            whole = hashlib.sha256()
            for r, c in zip(roles.to_pylist(), contents.to_pylist(), strict=True):
                whole.update(f"{r}\n{c}\n".encode())
            masked = unescaped(pa.array([raw[a:b] for a, b in zip(loss[::2], loss[1::2], strict=True)], pa.binary()).cast(pa.large_string()))
            held, chars = hashlib.sha256(), 0
            for c in masked.to_pylist():
                held.update(c.encode())
                chars += len(c)
            rows.append((len(turns), whole.hexdigest(), chars, held.hexdigest(), len(raw.decode())))
        n, whole, chars, held, size = zip(*rows, strict=True) if rows else ((),) * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(whole, pa.string()), pa.array(chars, pa.int64()), pa.array(held, pa.string()), pa.array(size, pa.int64())],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def read_back(formatted: DataFrame) -> DataFrame:
    """What the rows of formatted_chats say when parsed and unescaped: turns, text under the loss mask and their digests."""
    kind = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "n_turns", "formatted", "loss").mapInArrow(_read_back, kind)
