"""Passages that repeat, found by level-wise doubling of window lengths.

Level one looks at windows of a quarter of the length: of each whole window, the quarter with the least hash (its anchor) stands for it,
so equal windows have equal anchors. Windows whose anchor repeats alone are extended to half the length, and those that repeat there to
the whole length. Texts of one word sequence are told first and searched once. What moves between tasks are hashes; texts move once, and only those that hold
a repeated anchor or lose words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bits import bitmap, bits_for, marked, passing
from .keep import with_groups
from .scratch import Scratch, bounded_batches
from .words import SPACED, U, Words, lists, mix, pieces, signed, text_buffer

LIST = pa.list_(pa.int64())


def _levels(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of size / 4, size / 2 and size words, each from two of the level below."""
    out = [w.windows(size // 4)]
    for k in (1, 2):
        half = size // 4 * k
        h = out[-1]
        out.append(mix(h[: len(h) - half] * U(0x9E3779B97F4A7C15) + h[half:]) if len(h) > half else np.zeros(0, U))
    return tuple(out)


def _whole(w: Words, size: int) -> np.ndarray:
    """Starts of the windows of `size` words that lie within one text."""
    return np.flatnonzero(w.left() >= size)


def _anchors(quarter: np.ndarray, starts: np.ndarray, size: int, part: int) -> np.ndarray:
    """The place of the least part (windows of `part` words) in each window that starts at starts; the leftmost of equals."""
    if not len(starts):
        return starts
    span = size - part + 1  # parts in a window
    best, at = quarter.copy(), np.arange(len(quarter))
    done = 1
    while done < span:  # minima over spans of doubling width
        step = min(done, span - done)
        a, b = best[: len(best) - step], best[step:]
        right = b < a
        best = np.where(right, b, a)
        at = np.where(right, at[step:], at[: len(at) - step])
        done += step
    return at[starts]


def _sequence(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's whole sequence of words."""
    n = np.diff(w.first)
    place = np.arange(len(w.hash)) - np.repeat(w.first[:-1], n)
    out = []
    for k, h in enumerate((w.hash, w.hash2)):
        total = np.concatenate([[U(0)], np.cumsum(mix(h + mix(place + (k << 40))))])
        out.append(mix(total[w.first[1:]] - total[w.first[:-1]] + n.astype(U)))
    return tuple(out)


def _candidates(w: Words, levels: tuple, known: list[np.ndarray] | None, size: int) -> np.ndarray:
    """Starts of the whole windows whose anchor one level down is among its text's known ones (all windows where known is None)."""
    starts = _whole(w, size)
    if known is None or not len(starts):
        return starts
    quarter_or_half, span = levels
    anchor = signed(quarter_or_half[_anchors(quarter_or_half, starts, size, span)])
    edge = np.searchsorted(starts, w.first)
    some = [np.isin(anchor[edge[i] : edge[i + 1]], v) for i, v in enumerate(known)]
    return starts[np.concatenate(some)]


def _columns(batch: pa.RecordBatch, *names: str) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def _known(column: pa.Array, a: int, b: int) -> list[np.ndarray]:
    mine = column.slice(a, b - a)
    bound, values = np.asarray(mine.offsets), mine.values.to_numpy(zero_copy_only=False)
    return [values[bound[i] : bound[i + 1]] for i in range(b - a)]


def _first_level(size: int):
    """Texts to their words' number and sequence, and their anchors of a quarter's length, as often as they stand at another place."""

    def run(batches):
        for batch in batches:
            text, *ids = _columns(batch, "text", "doc_id", "o", "th")
            data, offsets = text_buffer(text)
            for a, b, x, y in pieces(data, offsets):
                w = Words(x, y, SPACED, False, twice=True)
                s1, s2 = _sequence(w)
                quarter = _levels(w, size)[0]
                at = np.unique(_anchors(quarter, _whole(w, size), size, size // 4))
                held = [pa.array(np.diff(w.first), pa.int64()), pa.array(signed(s1)), pa.array(signed(s2)), lists(signed(quarter[at]), np.searchsorted(at, w.first), pa.int64())]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in ids), *held], ["doc_id", "o", "th", "n_words", "s1", "s2", "anchors"])

    return run


def _next_level(size: int):
    """Texts with their repeated anchors of a quarter's length to their anchors of half the length."""

    def run(batches):
        for batch in batches:
            text, known, *ids = _columns(batch, "text", "repeated", "o", "th")
            data, offsets = text_buffer(text)
            for a, b, x, y in pieces(data, offsets):
                w = Words(x, y, SPACED, False)
                quarter, half, _ = _levels(w, size)
                starts = _candidates(w, (quarter, size // 4), _known(known, a, b), size)
                at = np.unique(_anchors(half, starts, size, size // 2))
                held = lists(signed(half[at]), np.searchsorted(at, w.first), pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in ids), held], ["o", "th", "anchors"])

    return run


def _last_level(size: int):
    """Texts with their repeated anchors of half the length to the whole windows that have one: a row for each."""

    def run(batches):
        for batch in batches:
            text, known, *ids = _columns(batch, "text", "repeated", "o", "th")
            data, offsets = text_buffer(text)
            for a, b, x, y in pieces(data, offsets):
                w = Words(x, y, SPACED, False)
                _, half, whole = _levels(w, size)
                starts = _candidates(w, (half, size // 2), _known(known, a, b), size)
                mine = w.text_of()[starts]
                take = pa.array(mine + a)
                held = [pa.array(starts - w.first[mine], pa.int64()), pa.array(signed(half[starts])), pa.array(signed(whole[starts]))]
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in ids), *held], ["o", "th", "place", "left", "h"])

    return run


def _cover(size: int):
    """Texts with the starts of the windows to remove to the words that stay."""

    def run(batches):
        for batch in batches:
            text, gone, every, *ids = _columns(batch, "text", "gone", "every", "doc_id", "o", "th")
            data, offsets = text_buffer(text)
            every = every.to_numpy(zero_copy_only=False)
            for a, b, x, y in pieces(data, offsets):
                w, rows = Words(x, y, SPACED, False), []
                for i, v in enumerate(_known(gone, a, b)):
                    n = int(w.first[i + 1] - w.first[i])
                    mark = np.zeros(n + size + 1, np.int64)
                    np.add.at(mark, v, 1)
                    np.add.at(mark, v + size, -1)
                    lost = np.cumsum(mark)[:n] > 0
                    if every[a + i] and n >= size:
                        lost[:] = True
                    kept = _join(w, w.first[i] + np.flatnonzero(~lost))
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], lost, [0]]))) if lost.any() else []
                    rows.append((n, int(lost.sum()), kept, hashlib.sha256(kept).hexdigest(), list(map(int, edge))))
                n, lost, kept, sha, edge = zip(*rows, strict=True)
                held = [pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sha), pa.array(edge, LIST)]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in ids), *held], ["doc_id", "o", "th", "n_words", "n_removed", "kept_text", "kept_sha256", "removed"])

    return run


def _join(w: Words, kept: np.ndarray) -> bytes:
    """The words numbered kept, joined by one space."""
    if not len(kept):
        return b""
    length = w.end[kept] - w.start[kept] + 1
    at = np.cumsum(length)
    index = np.arange(at[-1]) + np.repeat(w.start[kept] - at + length, length)
    out = w.data[np.minimum(index, len(w.data) - 1)]
    out[at - 1] = 0x20
    return out[:-1].tobytes()


KEY = ["o", "th"]
COVERED = "doc_id long, o long, th long, n_words long, n_removed long, kept_text string, kept_sha256 string, removed array<long>"


def _repeated(rows: DataFrame) -> DataFrame:
    """Rows with anchors (o, th, anchors) to those of their anchors that stand at two places or more: o, th, repeated."""
    each = rows.select(*KEY, F.explode("anchors").alias("h"))
    often = each.groupBy("h").agg(F.count("*").alias("times")).filter("times > 1").select("h")
    return each.join(often, "h").groupBy(*KEY).agg(F.collect_set("h").alias("repeated"))


def repeated_passages(docs: DataFrame, size: int = 20) -> DataFrame:
    """Removes every word covered by a window of `size` words that also starts earlier: in a smaller doc_id, or earlier in the same text.

    Takes doc_id and text of docs, other columns are ignored. Returns one row for each row: doc_id, n_words, n_removed, kept_text
    (kept words joined by one space), kept_sha256 and removed (bounds of the removed ranges of words, in pairs). size is a multiple of
    four, 4 at least. Null and empty texts have no words; texts shorter than a window keep all. A null doc_id comes after all others.
    Rows that tie in doc_id are ordered by a hash of their texts, and of rows that tie in both, any one counts as the earlier. No rows
    give no rows.
    """
    if size < 4 or size % 4:
        raise ValueError("size must be a multiple of 4, and not 0")
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "passages")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("doc_id", F.lit(2**63 - 1)).cast("long").alias("o"), F.xxhash64("text").alias("th"), "text")
    found = scratch.table(docs.mapInArrow(_first_level(size), "doc_id long, o long, th long, n_words long, s1 long, s2 long, anchors array<long>"))
    # Of texts with one sequence of words the earliest is searched; the others repeat it as a whole.
    long = found.filter(F.col("n_words") >= size)
    groups = long.groupBy("s1", "s2").agg(F.min(F.struct(*KEY)).alias("lead"), F.count("*").alias("rows"))
    many = scratch.table(groups.filter("rows > 1"))
    told = with_groups(long.select(*KEY, "s1", "s2"), many, ["s1", "s2"], "rows", scratch)
    copies = scratch.table(told.filter(F.struct(*KEY) != F.col("lead")).select(*KEY).distinct())
    level = scratch.table(_repeated(long.join(copies, KEY, "left_anti")))
    for step, schema in ((_next_level, "o long, th long, anchors array<long>"), (_last_level, "o long, th long, place long, left long, h long")):
        bits = bits_for(level.count())
        texts = passing(docs, *KEY, within=bitmap(level, *KEY, bits=bits), bits=bits).join(level.hint("shuffle_hash"), KEY)
        rows = scratch.table(texts.select(*KEY, "text", "repeated").mapInArrow(step(size), schema))
        level = scratch.table(_repeated(rows)) if step is _next_level else rows
        scratch.keep_only(found, copies, level)
    place = F.struct(*KEY, "place")
    first = scratch.table(level.groupBy("left", "h").agg(F.min(place).alias("first"), F.count("*").alias("times")).filter("times > 1"))
    later = with_groups(level, first, ["left", "h"], "times", scratch).filter(place != F.col("first"))
    gone = later.groupBy(*KEY).agg(F.collect_set("place").alias("gone")).withColumn("every", F.lit(False))
    gone = scratch.table(gone.unionByName(copies.select(*KEY, F.array().cast("array<long>").alias("gone"), F.lit(True).alias("every"))))
    scratch.keep_only(found, gone)
    bits = bits_for(gone.count())
    told = marked(docs, *KEY, within=bitmap(gone, *KEY, bits=bits), bits=bits)
    none = [F.array().cast("array<long>").alias("gone"), F.lit(False).alias("every")]
    some = told.filter("_in").join(gone.hint("shuffle_hash"), KEY, "left")
    some = some.select("doc_id", *KEY, "text", F.coalesce("gone", none[0]).alias("gone"), F.coalesce("every", none[1]).alias("every"))
    out = told.filter("not _in").select("doc_id", *KEY, "text", *none).unionByName(some).mapInArrow(_cover(size), COVERED)
    # Of rows that tie in doc_id and text, all but one repeat that one.
    ties = scratch.table(long.groupBy(*KEY).count().filter("count > 1").select(*KEY, F.lit(True).alias("tie")))
    if not ties.isEmpty():
        nth = F.row_number().over(Window.partitionBy(*KEY).orderBy("n_words"))
        tied = out.join(ties, KEY).drop("tie").withColumn("again", nth > 1)
        for name, value in (("n_removed", F.col("n_words")), ("kept_text", F.lit("")), ("kept_sha256", F.lit(hashlib.sha256(b"").hexdigest())), ("removed", F.array(F.lit(0).cast("long"), F.col("n_words")))):
            tied = tied.withColumn(name, F.when(F.col("again"), value).otherwise(F.col(name)))
        out = out.join(ties, KEY, "left_anti").unionByName(tied.drop("again"))
    return out.drop(*KEY)
