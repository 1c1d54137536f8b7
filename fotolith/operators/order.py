"""Numbers along one order of all rows, without a task that has all of them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: About so many rows are numbered in one task, as long as no more than so many ranges are needed; beyond, ranges grow.
ROWS, RANGES = 10_000, 512
#: Keys that ranges are told from, for each range.
KEYS = 20


def _held(values: list, kind: str) -> Column:
    """A literal array, made by one call whatever its length; it is folded before rows are read."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _range_of(key: Column, bounds: list[list[str]]) -> Column:
    """How many of the bounds, which ascend, aren't above key. By halves, with the key told once for all of them."""
    n, held = len(bounds), _held(bounds, "array<array<string>>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(n.bit_length()))))

    def step(s: Column, by: Column) -> Column:
        to = s["at"] + by
        below = (to <= n) & (F.get(held, to - 1) <= s["key"])
        return F.struct(F.when(below, to).otherwise(s["at"]).alias("at"), s["key"].alias("key"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), key.alias("key")), step, lambda s: s["at"])


def running(rows: DataFrame, name: str, key: Column, order: list[Column], value: Column) -> DataFrame:
    """rows with the running sum of value (a long) along order, whose first part is key (an array of strings).

    Ranges of keys are told from keys of least hash, so that they are the same in every pass; each range is summed by itself and starts at the
    sum of those before it. Rows of one key are in one range.
    """
    total = rows.count()
    ranges = min(RANGES, -(-total // ROWS))
    bounds = []
    if ranges > 1:
        step = max(1, total // (ranges * KEYS))
        some = [r[0] for r in rows.select(key.alias("k")).filter(F.pmod(F.xxhash64("k"), F.lit(step)) == 0).distinct().orderBy("k").collect()]
        bounds = [some[i * len(some) // ranges] for i in range(1, ranges)] if len(some) >= ranges else some
    rows = rows.withColumn("_range", _range_of(key, bounds) if bounds else F.lit(0))
    sums = {r["_range"]: r["n"] for r in rows.groupBy("_range").agg(F.sum(value).alias("n")).collect()}
    starts = [sum(sums.get(j, 0) for j in range(i)) for i in range(len(bounds) + 1)]
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.get(_held(starts, "array<bigint>"), F.col("_range"))
    return rows.withColumn(name, F.sum(value).over(w) + before).drop("_range")
