"""What each of five quality filters takes away, in every order of applying them.

A document's failures are five bits. A table of 32 by 120 tells for each set of failures and each order the step that removes it; tasks
look their rows up, count them by part, order and step, and the counts of all tasks are summed. Documents are read once: what follows
works on a row of some 50 bytes for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import bitmap, bits_for, marked
from .keep import with_groups
from .scratch import Scratch, bounded_batches
from .words import SPACED, Words, pieces, text_buffer

#: A: few words, B: repeated words, C: capitals, D: marks, E: an exact copy of a document with a smaller doc_id.
LETTERS = "ABCDE"
REPEATED = 1 << LETTERS.index("E")
#: Parts whose counts a task holds before it sends them.
MOST_PARTS = 1024
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@dataclass(frozen=True)
class Limits:
    """fewest: words below which A fails; distinct: percent of words below which B fails; capitals: percent of characters above which C fails; marks: characters on which D fails."""

    fewest: int = 50
    distinct: int = 65
    capitals: int = 5
    marks: str = "#$%&*|"


def first_failures(k: int) -> tuple[np.ndarray, np.ndarray]:
    """All orders of k filters (k! by k, in lexical order), and for each set of failures and order the step, from 0, that removes; k where none does."""
    orders = np.array(list(permutations(range(k))), np.int64)
    fails = (np.arange(1 << k)[:, None, None] >> orders[None]) & 1
    return orders, np.where(fails.any(2), fails.argmax(2), k)


def _masks(column: pa.Array, limits: Limits) -> np.ndarray:
    """The bits of A to D for each text of a column."""
    out = [np.zeros(0, np.int64)]
    capital, mark = np.zeros(256, bool), np.zeros(256, bool)
    capital[0x41:0x5B], mark[list(limits.marks.encode("ascii"))] = True, True
    for a, b, data, offsets in pieces(*text_buffer(column)):
        w = Words(data, offsets, SPACED, lower=False)
        text, words = w.text_of(), np.diff(w.first)
        order = np.lexsort((w.hash, text))
        new = np.ones(len(order), bool)
        new[1:] = (text[order][1:] != text[order][:-1]) | (w.hash[order][1:] != w.hash[order][:-1])
        distinct = np.bincount(text[order][new], minlength=b - a)
        within = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
        chars = within((data & 0xC0) != 0x80)
        fails = (words < limits.fewest, 100 * distinct < limits.distinct * words, 100 * within(capital[data]) > limits.capitals * chars, within(mark[data]) > 0)
        out.append(sum(f.astype(np.int64) << k for k, f in enumerate(fails)))
    return np.concatenate(out)


def failures(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """_id, _part, _sha (of the text) and _mask, the bits of A to D, for each row of docs."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("source", F.lit("")).alias("_part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("_sha"), text.alias("_text"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = pa.array(_masks(batch.column("_text"), limits).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_part"), batch.column("_sha"), mask], ["_id", "_part", "_sha", "_mask"])

    return rows.mapInArrow(told, "_id long, _part string, _sha binary, _mask int")


def with_copies(facts: DataFrame, scratch: Scratch) -> DataFrame:
    """_id, _part and _mask with the bit of E; facts must be a written table. Only rows whose text may occur twice are dealt out."""
    groups = facts.filter("_id IS NOT NULL").groupBy("_sha").agg(F.count("*").alias("_n"), F.min("_id").alias("_first")).filter("_n > 1")
    groups = scratch.table(groups)
    bits = bits_for(groups.count())
    asked = scratch.table(marked(facts, "_sha", within=bitmap(groups, "_sha", bits=bits), bits=bits))
    found = with_groups(asked.filter("_in").drop("_in"), groups, "_sha", "_n", scratch)
    bit = F.when(F.col("_first") < F.col("_id"), REPEATED).otherwise(0)
    return asked.filter("NOT _in").select("_id", "_part", "_mask").unionByName(found.select("_id", "_part", (F.col("_mask") + bit).alias("_mask")))


def with_labels(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """_part, _mask, _good and _toxic; only removed rows are joined, and only with labels that count. masks must be a written table."""
    good, toxic = F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False))
    marks = labels.select(F.col("doc_id").cast("long").alias("_id"), good.alias("_good"), toxic.alias("_toxic")).filter("_id IS NOT NULL AND (_good OR _toxic)")
    marks = marks.groupBy("_id").agg(F.max("_good").alias("_good"), F.max("_toxic").alias("_toxic"))
    lost = F.expr("_mask > 0 AND _id IS NOT NULL")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    found = masks.filter(lost).join(marks, "_id", "left").select("_part", "_mask", flag("_good"), flag("_toxic"))
    return found.unionByName(masks.filter(~lost).select("_part", "_mask", F.lit(False).alias("_good"), F.lit(False).alias("_toxic")))


def _counted(k: int, orders: np.ndarray, table: np.ndarray):
    """The function that counts a task's rows: batches of (_part, _mask, _good, _toxic) to rows (_part, _order, _step and COUNTS), all orders and steps of each part it saw."""
    n = len(orders)

    def rows(part: str, steps: np.ndarray, masks: np.ndarray) -> pa.RecordBatch:
        """steps: removals by label (all, good, toxic), order and step, of which the last stands for none; masks: rows by set of failures."""
        removed, good, toxic = steps[:, :, :k]
        kept = removed.sum(1, keepdims=True) + steps[0, :, k:] - np.cumsum(removed, 1)
        bits = (np.arange(1 << k)[:, None] >> np.arange(k)) & 1
        fails, only = masks @ bits, masks[1 << np.arange(k)]
        whole = np.bincount(orders.ravel(), removed.ravel(), k).astype(np.int64)
        values = (kept, removed, fails[orders] - removed, only[orders], good, toxic, whole[orders])
        places = pa.array(np.repeat(np.arange(n, dtype=np.int32), k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n))
        columns = [pa.array([part] * (n * k), pa.string()), *places, *(pa.array(v.ravel().astype(np.int64)) for v in values)]
        return pa.RecordBatch.from_arrays(columns, ["_part", "_order", "_step", *COUNTS])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            parts = batch.column("_part").dictionary_encode()
            codes, names = parts.indices.to_numpy(zero_copy_only=False), parts.dictionary.to_pylist()
            mask = batch.column("_mask").to_numpy(zero_copy_only=False).astype(np.int64)
            cell = (codes.astype(np.int64)[:, None] * n + np.arange(n)) * (k + 1) + table[mask]
            by_label = [cell, *(cell[batch.column(c).to_numpy(zero_copy_only=False).astype(bool)] for c in ("_good", "_toxic"))]
            size = len(names) * n * (k + 1)
            steps = np.stack([np.bincount(c.ravel(), minlength=size).reshape(len(names), n, k + 1) for c in by_label], 1)
            masks = np.bincount(codes * (1 << k) + mask, minlength=len(names) << k).reshape(len(names), 1 << k)
            for i, name in enumerate(names):
                if name in held:
                    held[name][0] += steps[i]
                    held[name][1] += masks[i]
                else:
                    held[name] = [steps[i].copy(), masks[i].copy()]
            if len(held) > MOST_PARTS:
                yield from (rows(name, *v) for name, v in held.items())
                held = {}
        yield from (rows(name, *v) for name, v in held.items())

    return counted


def filter_audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """part, filter_order, step and COUNTS: a row for each source, each of the 120 orders of ABCDE and each step of it, zeros included.

    docs: doc_id, text, source; labels: doc_id, quality, toxic; further columns of either have no influence. A null text is empty, a null
    source the part ''. Rows that repeat count each; a row without doc_id never fails E, makes no other row fail it, and has no label. A
    document with several rows in labels is good, or toxic, if one of them says so. Filters that tie are parted by the order. No rows give no
    rows. Words are told apart by 64-bit hashes within a text and texts by SHA-256.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    facts = scratch.table(failures(docs, limits))
    rows = with_labels(scratch.table(with_copies(facts, scratch)), labels)
    k = len(LETTERS)
    orders, table = first_failures(k)
    schema = "_part string, _order int, _step int, " + ", ".join(f"{c} long" for c in COUNTS)
    sums = rows.mapInArrow(_counted(k, orders, table), schema).groupBy("_part", "_order", "_step").agg(*(F.sum(c).alias(c) for c in COUNTS))
    names = F.array(*(F.lit("".join(LETTERS[i] for i in o)) for o in orders))
    return sums.select(F.col("_part").alias("part"), F.element_at(names, F.col("_order") + 1).alias("filter_order"), F.col("_step").alias("step"), *COUNTS)
