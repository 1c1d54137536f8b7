"""Quality scores by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Words are runs of letters, of digits and of other signs, in their own case. A text's row is sparse: the share of each hashed n-gram
(n up to ORDER) among all of the text's; its score is the dot product of the row with the weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import bounded_batches
from .words import U, Words, constants, lists, mix, pieces, text_buffer

#: Kinds of bytes: 0 separates; letters and all beyond ASCII, capitals, digits, other signs.
KINDS = np.full(256, 4, np.uint8)
KINDS[[*range(0x00, 0x21), 0x7F]] = 0
KINDS[0x61:0x7B] = KINDS[0x41:0x5B] = KINDS[0x80:] = 1
KINDS[0x30:0x3A] = 3
ORDER = 2
#: N-grams of up to SPAN + 1 words count by their pattern.
SPAN = 4
#: At most so many labelled rows are learnt from, those of least hash: the bound of what the task that learns holds.
TRAIN_ROWS = 6000
DIMENSIONS = 1 << 18
#: Scores from here on count as good.
GOOD = 0.7


def _features(w: Words, dimensions: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its features and their shares; of a text without words one feature that stands for that."""
    h, out = w.hash, []
    grams = [h]
    for _ in range(ORDER - 1):
        last = grams[-1]
        grams.append(mix(last[:-1] * U(0x9E3779B97F4A7C15) + h[len(h) - len(last) + 1 :]) if len(last) else last)
    grams = [(g % U(dimensions - 1)).astype(np.int32) + 1 for g in grams]
    # An n-gram that ends with the word it begins with also counts by that pattern, whatever the word.
    again = [np.flatnonzero(h[k:] == h[:-k]) for k in range(1, SPAN + 1)]
    pattern = (constants(11, SPAN) % U(dimensions - 1)).astype(np.int32) + 1
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if a == b:
            out.append((np.zeros(1, np.int32), np.ones(1, np.float32)))
            continue
        times = [np.searchsorted(at, b - k) - np.searchsorted(at, a) for k, at in enumerate(again, 1)]
        x, n = np.unique(np.concatenate([*(g[a : b - k] for k, g in enumerate(grams)), np.repeat(pattern, np.maximum(times, 0))]), return_counts=True)
        out.append((x, np.sqrt(n / n.sum()).astype(np.float32)))
    return out


def _rows(dimensions: int):
    """label, text, doc_id to label, features, shares, doc_id."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b, x, y in pieces(data, offsets):
                rows = _features(Words(x, y, KINDS, False), dimensions)
                bound = np.concatenate([[0], np.cumsum([len(i) for i, _ in rows])])
                columns = [lists(np.concatenate([i for i, _ in rows]), bound, pa.int32()), lists(np.concatenate([v for _, v in rows]), bound, pa.float32())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns, batch.column(2).slice(a, b - a)], ["label", "features", "shares", "doc_id"])

    return run


def follow_leader(rows, dimensions: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.001, l2: float = 0.01) -> np.ndarray:
    """Weights after FTRL-proximal updates over sparse rows; the bias is the last weight.

    rows: labels, features and shares of all rows one after the other, the n + 1 bounds of rows in them, and the order of rows.
    """
    z, n = np.zeros(dimensions + 1), np.zeros(dimensions + 1)

    def weights(i):
        small = np.abs(z[i]) <= l1
        return np.where(small, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    labels, features, shares, bound, order = rows
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(order)):
            k = order[k]
            i = np.append(features[bound[k] : bound[k + 1]], dimensions)
            v = np.append(shares[bound[k] : bound[k + 1]].astype(float), 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ v, -35, 35))) - labels[k]) * v
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - step * w
            n[i] += g * g
    return weights(np.arange(dimensions + 1))


def _learnt(dimensions: int):
    """label, features, shares, doc_id of all rows to the weights, as bytes of doubles."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        got = pa.Table.from_batches(held).combine_chunks()
        del held
        label, features, shares, doc_id = (got[c].chunk(0) for c in ("label", "features", "shares", "doc_id"))
        # One order whatever the partitions, so that the same rows give the same weights. Arrow's buffers are used as they are.
        order = np.argsort(doc_id.to_numpy(zero_copy_only=False), kind="stable")
        rows = label.to_numpy(zero_copy_only=False), features.values.to_numpy(), shares.values.to_numpy(), np.asarray(features.offsets, np.int64), order
        weights = follow_leader(rows, dimensions)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], ["weights"])

    return run


def train(docs: DataFrame, labels: DataFrame, dimensions: int = DIMENSIONS, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learnt from the rows of docs (doc_id, text) that labels (doc_id, label) covers with 0 or 1.

    At most `rows` labels are used, those whose doc_id has the least hash. Of rows that tie in doc_id the least text is learnt, of several labels of a
    doc_id the largest. Null doc_ids are not learnt, null texts count as empty. Without any row, all weights are 0.
    """
    bounded_batches(docs.sparkSession)
    some = labels.filter("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # a bounded table, so it may be broadcast
    held = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text"))
    rows = held.select("label", "text", "doc_id").mapInArrow(_rows(dimensions), "label int, features array<int>, shares array<float>, doc_id long")
    # The rows meet in one task, which their bound allows; the driver gets the weights alone.
    got = rows.repartition(1).mapInArrow(_learnt(dimensions), "weights binary").first()
    return np.frombuffer(bytes(got.weights)) if got else np.zeros(dimensions + 1)


def _score(weights, text_at: int, names: list[str]):
    def run(batches):
        w_ = weights.value
        for batch in batches:
            data, offsets = text_buffer(batch.column(text_at))
            out = []
            for _, _, x, y in pieces(data, offsets):
                rows = _features(Words(x, y, KINDS, False), len(w_) - 1)
                out += [float(w_[i] @ v + w_[-1]) for i, v in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(np.array(out, float), -35, 35))))], names)

    return run


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs with a column `score`, 0 to 1: how likely label 1 is. It depends on the text alone; null counts as empty, and texts without
    words have one score. Rows that tie or repeat are scored alike; a column named score is replaced; no rows give no rows."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kind = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(_score(shared, docs.columns.index("text"), [*docs.columns, "score"]), kind)
