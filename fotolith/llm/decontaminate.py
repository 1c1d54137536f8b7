"""Benchmark passages in documents, found in suffix arrays of the documents.

A shard is a run of whole documents in one task. Its suffix array orders the suffixes that begin with two words with which a test suffix
begins (others match none far enough), by as many words as a window has; every test suffix is searched in it by bisection, all at once.
Places that follow one another on the same item are joined to the longest verbatim matches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, bounded_batches
from .words import ALNUM, U, Words, mix, pieces, text_buffer

#: Words of test items that are compiled and broadcast at once: about 100 MB. More items are searched in further passes.
BLOCK_WORDS = 1 << 20
SHARD_BYTES = 2 << 20
MARKS = 1 << 20
MATCHES = "array<struct<item:string,item_word:int,word:int,words:int>>"


class Block:
    """Some test items, compiled: the first `window` words of each of their suffixes that has as many; shorter items whole."""

    def __init__(self, names: list[str], texts: list[str], window: int):
        data, offsets = text_buffer(pa.array(texts, pa.large_string()))
        w = Words(data, offsets, ALNUM, True)
        item, place, size = [], [], []
        for i, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
            k = min(window, int(b - a))
            if k:
                n = int(b - a) - k + 1
                item.append(np.full(n, i))
                place.append(np.arange(n))
                size.append(np.full(n, k))
        self.names, self.window = names, window
        self.item, self.place, self.size = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (item, place, size))
        padded = np.concatenate([w.hash, np.zeros(window, U)])
        self.keys = padded[w.first[self.item][:, None] + self.place[:, None] + np.arange(window)]
        self.keys[np.arange(window) >= self.size[:, None]] = 0
        # Marks by the first two words, or by the only one.
        self.single = bool((self.size == 1).any())
        self.marks = np.zeros(MARKS, bool)
        for k in (1, 2):
            some = self.keys[(self.size == 1) if k == 1 else (self.size > 1)]
            self.marks[_mark(some[:, 0], some[:, 1] if k == 2 else None)] = True


def _mark(first: np.ndarray, second: np.ndarray | None) -> np.ndarray:
    x = first * U(0x9E3779B97F4A7C15) + (U(0) if second is None else second)
    return (mix(x) & U(MARKS - 1)).astype(np.int64)


def _bisect(array: np.ndarray, keys: np.ndarray, inside: np.ndarray, upper: bool) -> np.ndarray:
    """For each key the first row of the sorted array that isn't less (upper: that is greater) in the key's own words."""
    low, high = np.zeros(len(keys), np.int64), np.full(len(keys), len(array), np.int64)
    rows = np.arange(len(keys))
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        held = array[np.minimum(mid, len(array) - 1)]
        differs = (held != keys) & inside
        at = differs.argmax(1)
        unlike = differs[rows, at]
        less = np.where(unlike, held[rows, at] < keys[rows, at], upper)
        low = np.where(open_ & less, mid + 1, low)
        high = np.where(open_ & ~less, mid, high)
    return low


def _search(w: Words, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(test suffix, word) of all places where a document has the window with which the test suffix begins."""
    none = np.zeros(0, np.int64)
    if not len(w.hash) or not len(block.keys):
        return none, none
    left = w.left()
    following = np.concatenate([w.hash[1:], np.zeros(1, U)])
    following[left == 1] = 0
    some = block.marks[_mark(w.hash, following)] & (left > 1)
    if block.single:
        some |= block.marks[_mark(w.hash, None)]
    suffix = np.flatnonzero(some)
    if not len(suffix):
        return none, none
    padded = np.concatenate([w.hash, np.zeros(block.window, U)])
    array = padded[suffix[:, None] + np.arange(block.window)]
    array[np.arange(block.window) >= left[suffix][:, None]] = 0
    order = np.lexsort(array.T[::-1])
    suffix, array = suffix[order], array[order]
    # Of the test suffixes those are searched whose first word begins a suffix of this shard.
    heads = array[np.concatenate([[True], array[1:, 0] != array[:-1, 0]]), 0]
    asked = np.flatnonzero(heads[np.minimum(np.searchsorted(heads, block.keys[:, 0]), len(heads) - 1)] == block.keys[:, 0])
    keys, inside = block.keys[asked], np.arange(block.window) < block.size[asked][:, None]
    low, high = (_bisect(array, keys, inside, upper) for upper in (False, True))
    times = high - low
    which = np.repeat(asked, times)
    at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
    return which, suffix[at]


def _longest(block: Block, which: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places joined along an item to the longest matches: item, word in the item, word in the shard, words."""
    item, place, size = block.item[which], block.place[which], block.size[which]
    order = np.lexsort((word, word - place, item))
    item, place, size, word = item[order], place[order], size[order], word[order]
    new = np.ones(len(word), bool)
    new[1:] = (item[1:] != item[:-1]) | (word[1:] - place[1:] != word[:-1] - place[:-1]) | (word[1:] != word[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first, len(word))[1:] - 1
    return item[first], place[first], word[first], word[last] - word[first] + size[last]


def _pass(block, text_at: int, schema: pa.Schema):
    """Adds to each row what the block's items match: `_spans` (bounds of words hit, in pairs) and `_matches`."""

    def run(batches):
        b = block.value
        for batch in batches:
            data, offsets = text_buffer(batch.column(text_at))
            words, matches = [], []
            for _, _, x, y in pieces(data, offsets, SHARD_BYTES):
                w = Words(x, y, ALNUM, True)
                item, place, word, n = _longest(b, *_search(w, b))
                text = np.searchsorted(w.first, word, "right") - 1
                found = [[] for _ in range(len(y) - 1)]
                for t, i, p, s, k in zip(text, item, place, word - w.first[text], n, strict=True):
                    found[t].append({"item": b.names[i], "item_word": int(p), "word": int(s), "words": int(k)})
                words.append(np.diff(w.first))
                matches += found
            held = batch.columns[:-2]
            old = batch.column(batch.num_columns - 1).to_pylist()
            n_words = np.concatenate(words) if words else np.zeros(0, np.int64)
            merged = [(o or []) + m for o, m in zip(old, matches, strict=True)]
            yield pa.RecordBatch.from_arrays([*held, pa.array(n_words, pa.int64()), pa.array(merged, schema.field(len(schema) - 1).type)], [f.name for f in schema])

    return run


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The columns of docs (text among them), `n_words`, `n_hit` and `matches`: the longest verbatim matches with test items.

    Texts are lower-cased for A-Z; words are runs of letters, digits and all that isn't ASCII. A document word is hit if it lies in
    `window` consecutive words of an item of benchmark (item_id, text), or in all words of an item that has fewer. matches has the
    item's id as a string, the first word in the item and in the document, and the number of words. Texts that are null or without words
    have no match and are matched by nothing; item ids may repeat, a null one reads 'null'. Columns of docs named n_words, n_hit or
    matches are replaced. An empty benchmark matches nothing; no rows give no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.drop("n_words", "n_hit", "matches", "_words")
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "matches": F.array().cast(MATCHES)})
    kind = T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema])
    element = pa.struct([("item", pa.string()), ("item_word", pa.int32()), ("word", pa.int32()), ("words", pa.int32())])
    schema = pa.schema([pa.field(f.name, pa.null()) for f in docs.schema] + [pa.field("n_words", pa.int64()), pa.field("matches", pa.list_(element))])
    scratch = Scratch(spark, "matches")
    for k, block in enumerate(_blocks(benchmark, window)):
        if k:
            out = scratch.table(out)  # one block in memory at a time
        shared = spark.sparkContext.broadcast(block)
        out = out.mapInArrow(_pass(shared, docs.columns.index("text"), schema), kind)
    span = "transform(array_sort(transform(matches, m -> struct(m.word AS a, m.word + m.words AS b))), x -> x)"
    hit = f"aggregate({span}, struct(0 AS n, 0 AS e), (s, x) -> struct(s.n + greatest(0, x.b - greatest(x.a, s.e)) AS n, greatest(s.e, x.b) AS e), s -> cast(s.n AS bigint))"
    return out.withColumn("n_hit", F.expr(hit))


def _blocks(benchmark: DataFrame, window: int):
    """Compiled blocks of the benchmark, of BLOCK_WORDS words or one item; the driver holds one at a time."""
    names, texts, held, any_ = [], [], 0, False
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce("text", F.lit("")).alias("text")).toLocalIterator():
        names.append(r.item)
        texts.append(r.text)
        held += len(r.text) // 2 + 1
        if held >= BLOCK_WORDS:
            yield Block(names, texts, window)
            names, texts, held, any_ = [], [], 0, True
    if names or not any_:
        yield Block(names, texts, window)
