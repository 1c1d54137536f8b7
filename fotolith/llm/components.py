"""Connected components of a table of edges, by rounds of small joins; nothing is gathered on the driver but counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


#: Tables of so many edges at most are flattened by one task, in 100 MB of arrays; rounds of joins over them would cost more in tasks than in work.
FEW = 1 << 20


def _flattened(batches):
    """Edges (a, b) to (node, root): every node takes the least root of its neighbours, then its root's root, until nothing changes."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not held:
        return
    nodes, ends = np.unique(np.concatenate([np.concatenate(side) for side in zip(*held, strict=True)]), return_inverse=True)
    a, b = np.split(ends, 2)
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        for side in (root[a], root[b]):
            np.minimum.at(new, side, least)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    for k in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + (1 << 16)]), pa.array(nodes[root[k : k + (1 << 16)]])], ["node", "root"])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of edges (a, b), longs: root is the least node that it reaches.

    Each round every node takes the least root among its own and its neighbours', then its root's root; nodes' sums are
    combined before they are dealt out, so a node with very many edges doesn't meet them in one task. An edge between nodes of one root
    is dropped, the others are rewritten to join roots, so the edges shrink with each round.
    """
    links = scratch.table(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a != b").distinct())
    if links.count() <= FEW:
        return scratch.table(links.coalesce(1).mapInArrow(_flattened, "node long, root long"))
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    labels = scratch.table(nodes.withColumn("root", F.col("node")))
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        # Each root hooks onto its least neighbour if that is less; the hooks form trees, which two jumps a round flatten.
        hooks = told = scratch.table(best.filter("least < node").select(F.col("node").alias("from"), F.col("least").alias("to")))
        if told.isEmpty():
            return labels
        for _ in range(2):
            up = told.select(F.col("from").alias("to"), F.col("to").alias("up"))
            hooks = hooks.join(up, "to", "left").select("from", F.coalesce("up", "to").alias("to"))
        step = hooks.select(F.col("from").alias("root"), F.col("to").alias("up"))
        moved = scratch.table(labels.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        a = hooks.select(F.col("from").alias("a"), F.col("to").alias("a2"))
        b = hooks.select(F.col("from").alias("b"), F.col("to").alias("b2"))
        kept = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b"))
        kept = scratch.table(kept.filter("a != b").distinct())
        scratch.drop(labels, links, told)
        labels, links = moved, kept
