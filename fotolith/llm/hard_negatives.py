"""Hard negatives by exact search for large inner products, with a pivot table.

A vector x gets one more component, sqrt(M² - |x|²), with M the largest norm, and a query q gets a zero; then |q - x|² = |q|² + M² - 2 q·x,
so large products are small distances. The table holds each row's distances to a few pivots and is ordered by the nearest of them. In a
group of rows the ranges of these distances bracket, by the triangle inequality, the distance of every anchor to every row of it: groups
that can't reach an anchor's worst kept score, or that lie above its bound, are left out, and the others' products are computed exactly.

Anchors are a stated set of queries. They are searched block by block, and every task keeps a bounded list for each anchor of the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, bounded_batches

#: Pivots, and rows by the lowest hashes that they are taken from and that the first bounds come from; both only steer how much is left out.
PIVOTS, SEEDS = 8, 2048
#: Rows of a group that is bracketed as a whole; bytes of vectors in a block of anchors.
GROUP, BLOCK_BYTES = 64, 4 << 20
#: Rows (anchor, row, score) that a task holds before it keeps the best of them.
MOST_HELD = 1 << 19
#: Products up to here are exact in doubles; bounds of a search that has none.
EXACT, NO_BOUND = float(1 << 53), 1 << 62


def prepared(rows: DataFrame) -> DataFrame:
    """vec_id, label and v (components in steps of 1/256, whole doubles) of the rows that take part, one for each vec_id."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    bad = F.exists("_x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    known = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").alias("_e"), x.alias("_x"))
    known = known.filter("vec_id IS NOT NULL AND label IS NOT NULL AND _x IS NOT NULL").filter(~bad)
    one = known.groupBy("vec_id").agg(F.min(F.struct("label", "_e")).alias("_r"))
    return one.select("vec_id", F.col("_r.label").alias("label"), F.transform("_r._e", lambda c: F.floor(c.cast("double") * 256).cast("double")).alias("v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A column of lists as rows of dims components, short ones filled with zeros."""
    n, flat, ends = len(column), column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.value_lengths())
    if n and (ends == dims).all():
        return flat.reshape(n, dims)
    out = np.zeros((n, dims))
    row = np.repeat(np.arange(n), ends)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)] = flat
    return out


@dataclass(frozen=True)
class Space:
    """The augmented space: M², components, and the pivots with their last component."""

    most: float
    dims: int
    pivots: np.ndarray
    last: np.ndarray

    def to_pivots(self, v: np.ndarray, augmented: bool) -> np.ndarray:
        """Distances of rows, or of queries (whose last component is 0), to the pivots."""
        norm = (v * v).sum(1)
        last = np.sqrt(np.maximum(0.0, self.most - norm)) if augmented else np.zeros(len(v))
        square = norm[:, None] + (self.pivots**2).sum(1) - 2 * (v @ self.pivots.T) + (last[:, None] - self.last) ** 2
        return np.sqrt(np.maximum(0.0, square))


def space_of(rows: DataFrame, seeds: pa.Table) -> Space:
    """M and the components from all rows; pivots far from one another, out of the seeds."""
    most, dims = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)), F.max(F.size("v"))).first()
    most, dims = most or 0.0, max(dims or 0, 1)
    v = matrix(seeds.column("v").combine_chunks(), dims) if seeds.num_rows else np.zeros((1, dims))
    last = np.sqrt(np.maximum(0.0, most - (v * v).sum(1)))
    chosen, far = [0], None
    for _ in range(min(PIVOTS, len(v)) - 1):
        d = ((v - v[chosen[-1]]) ** 2).sum(1) + (last - last[chosen[-1]]) ** 2
        far = d if far is None else np.minimum(far, d)
        chosen.append(int(far.argmax()))
    return Space(most, dims, v[chosen], last[chosen])


def pivot_table(rows: DataFrame, space: Space) -> DataFrame:
    """rows with d, the distances to the pivots, ordered by label, nearest pivot and distance to it. Equal rows are parted by vec_id."""
    dims = space.dims

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = space.to_pivots(matrix(b.column("v"), dims), True)
            near = d.argmin(1) if len(d) else np.zeros(0, np.int64)
            ends = pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1])
            cols = [*b.columns, pa.ListArray.from_arrays(ends, pa.array(d.ravel())), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "label", "v", "d", "near", "away"])

    held = rows.mapInArrow(told, "vec_id long, label int, v array<double>, d array<double>, near int, away double")
    key = ["label", "near", "away", "vec_id"]
    return held.repartitionByRange(*key).sortWithinPartitions(*key).select("vec_id", "label", "v", "d")


@dataclass
class Search:
    """A block of anchors with `slots` searches each: the best `keep` rows with a score from low to high, rows of the anchor's label (same) or of others."""

    ids: np.ndarray
    label: np.ndarray
    v: np.ndarray
    space: Space
    same: bool
    keep: int
    low: np.ndarray  # by anchor and slot
    high: np.ndarray

    def __post_init__(self):
        self.norm = (self.v * self.v).sum(1)
        self.d = self.space.to_pivots(self.v, False)
        self.slack = 1.0 + 1e-5 * (self.norm + self.space.most)  # above the error of short distances, which is the root of the rounding of their squares
        # Where doubles would round, longs are multiplied.
        self.exact = bool((self.norm * self.space.most < EXACT * EXACT / 4).all())

    def products(self, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        if self.exact:
            return (x @ self.v[of].T).astype(np.int64)
        return x.astype(np.int64) @ self.v[of].astype(np.int64).T

    def best(self, anchor: np.ndarray, slot: np.ndarray, score: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
        """The first `keep` of each anchor's slot: higher scores first, ties by smaller vec_id."""
        cell = anchor * self.low.shape[1] + slot
        order = np.lexsort((row, -score, cell))
        cell = cell[order]
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
        nth = np.arange(len(cell)) - np.repeat(starts, np.diff(np.r_[starts, len(cell)]))
        order = order[nth < self.keep]
        return anchor[order], slot[order], score[order], row[order]

    def over(self, blocks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
        """(anchor, slot, score, vec_id) over blocks of rows (vec_id, label, v, d)."""
        slots = self.low.shape[1]
        held = [np.zeros(0, np.int64)] * 4
        low = self.low.copy()  # rises to the worst kept score
        more: list[list[np.ndarray]] = []
        waiting = 0

        def kept() -> None:
            nonlocal held, more, waiting
            held = list(self.best(*(np.concatenate(c) for c in zip(held, *more, strict=True))))
            cell = held[0] * slots + held[1]
            last = np.flatnonzero(np.r_[cell[1:] != cell[:-1], True]) if len(cell) else np.zeros(0, np.int64)
            full = last[np.bincount(cell, minlength=low.size)[cell[last]] == self.keep]
            low.ravel()[cell[full]] = np.maximum(low.ravel()[cell[full]], held[2][full])
            more, waiting = [], 0

        for vec_id, label, v, d in blocks:
            change = np.r_[0, np.flatnonzero(label[1:] != label[:-1]) + 1, len(label)]
            for a, b in zip(change[:-1], change[1:], strict=True):
                of = np.flatnonzero((self.label == label[a]) == self.same)
                for g in range(a, b, GROUP) if len(of) else ():
                    part = slice(g, min(b, g + GROUP))
                    near, far = d[part].min(0), d[part].max(0)
                    least = np.maximum(np.maximum(near - self.d[of], self.d[of] - far).max(1), 0.0)
                    most = (self.d[of] + far).min(1)
                    whole = self.norm[of] + self.space.most
                    above, below = (whole - least * least) / 2 + self.slack[of], (whole - most * most) / 2 - self.slack[of]
                    some = of[((above[:, None] >= low[of]) & (below[:, None] <= self.high[of])).any(1)]
                    if not len(some):
                        continue
                    score = self.products(v[part], some)
                    hit = (score >= low[some].min(1)) & (score <= self.high[some].max(1))
                    r, s = np.nonzero(hit)
                    own = vec_id[part][r] != self.ids[some[s]]
                    r, s = r[own], s[own]
                    value = score[r, s]
                    fits = (value[:, None] >= low[some[s]]) & (value[:, None] <= self.high[some[s]])
                    i, slot = np.nonzero(fits)
                    more.append([some[s[i]], slot, value[i], vec_id[part][r[i]]])
                    waiting += len(i)
                    if waiting > MOST_HELD:
                        kept()
            if waiting:
                kept()
        return tuple(held)


def _searched(table: DataFrame, search: Search, seeds: tuple[np.ndarray, ...]) -> DataFrame:
    """anchor_id, slot, score and vec_id of the whole search."""
    # The seeds are rows of the table: the worst that an anchor keeps of them is a bound for all.
    order = np.argsort(seeds[1], kind="stable")
    anchor, slot, score, _ = search.over(iter([tuple(c[order] for c in seeds)]))
    n = np.bincount(anchor * search.low.shape[1] + slot, minlength=search.low.size)
    worst = np.full(search.low.size, NO_BOUND)
    np.minimum.at(worst, anchor * search.low.shape[1] + slot, score)
    search.low = np.where(n == search.keep, np.maximum(search.low.ravel(), worst), search.low.ravel()).reshape(search.low.shape)
    dims = search.space.dims
    told = table.sparkSession.sparkContext.broadcast(search)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = told.value
        blocks = ((b.column("vec_id").to_numpy(), b.column("label").to_numpy(), matrix(b.column("v"), dims), matrix(b.column("d"), len(search.space.pivots))) for b in batches)
        anchor, slot, score, row = search.over(blocks)
        cols = [search.ids[anchor], slot.astype(np.int32), score, row]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor_id", "slot", "score", "vec_id"])

    out = table.mapInArrow(f, "anchor_id long, slot int, score long, vec_id long")
    w = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "vec_id")
    out = out.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= search.keep)
    out._told = told
    return out


def hard_negatives(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score (ranks from 1), found exactly.

    rows: vec_id, label, embedding; further columns have no influence. Rows with a null vec_id, label or vector, or with a null or non-finite
    component, take no part; of rows with one vec_id the first by label and vector does. Scores are products of components in steps of 1/256;
    shorter vectors count as filled with zeros. Anchors are the rows whose vec_id is divisible by `every`; an anchor's positives are its best
    other rows of its label, its negatives for a positive the best rows of other labels whose score is from low to high percent of the
    positive's. Ties go to the smaller vec_id. An anchor without positives or negatives, and a table without rows, give no rows. Scores must
    be below 2^61.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "negatives")
    start = scratch.table(prepared(rows))
    lowest = start.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEEDS).toArrow()  # a bounded sample, for pivots and first bounds only
    space = space_of(start, lowest)
    table = scratch.table(pivot_table(start, space))
    scratch.drop(start)
    v = matrix(lowest.column("v").combine_chunks(), space.dims) if lowest.num_rows else np.zeros((0, space.dims))
    seeds = (lowest.column("vec_id").to_numpy(), lowest.column("label").to_numpy(), v, space.to_pivots(v, True))
    anchors = table.filter(F.col("vec_id") % every == 0).select("vec_id", "label", "v")
    blocks = -(-anchors.count() * space.dims * 8 // BLOCK_BYTES)
    anchors = scratch.table(anchors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks))).cast("int")), ["block"])
    found = []
    for block in range(blocks):
        held = anchors.filter(F.col("block") == block).toArrow()
        ids, label, q = held.column("vec_id").to_numpy(), held.column("label").to_numpy(), matrix(held.column("v").combine_chunks(), space.dims)
        bound = lambda value, slots: np.full((len(ids), slots), value, np.int64)  # noqa: B023, E731
        near = _searched(table, Search(ids, label, q, space, True, positives, bound(-NO_BOUND, 1), bound(NO_BOUND, 1)), seeds)
        near_rows = scratch.table(near.select("anchor_id", "nth", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
        near._told.destroy()
        best = near_rows.toArrow()  # at most `positives` rows for each anchor of the block
        at = np.searchsorted(np.sort(ids), best.column("anchor_id").to_numpy())
        at, slot, score = np.argsort(ids)[at], best.column("nth").to_numpy() - 1, best.column("positive_score").to_numpy()
        floor, top = bound(NO_BOUND, positives), bound(-NO_BOUND, positives)  # a slot without a positive fits nothing
        whole, rest = np.divmod(score, 100)  # percent of a score without overflow
        floor[at, slot], top[at, slot] = low * whole - (-low * rest // 100), high * whole + high * rest // 100
        far = _searched(table, Search(ids, label, q, space, False, negatives, floor, top), seeds)
        far_rows = far.select("anchor_id", (F.col("slot") + 1).alias("nth"), F.col("nth").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        out = near_rows.join(scratch.table(far_rows), ["anchor_id", "nth"])
        far._told.destroy()
        found.append(out.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score"))
    if not found:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
