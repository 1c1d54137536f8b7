"""Decisions on rows, applied to the rows: only rows that may go are dealt out, the others stay where they are read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bits import bitmap, bits_for, marked
from .scratch import Scratch


#: Groups with more than this share of all rows are joined by broadcast, so there are fewer of them than its inverse.
HOT = 1e-5


def with_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, scratch: Scratch) -> DataFrame:
    """rows with the columns of groups, which has one row for each key and its number of rows (size); null where a key has no group.

    The largest groups are joined where their rows are read, so that no task gets a whole one; groups must be a written table.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    large = scratch.table(groups.filter(F.col(size) > max(1000.0, HOT * total)))  # fewer rows than 1 / HOT
    placed = rows.join(F.broadcast(large), key, "left")
    small = groups.filter(F.col(size) <= max(1000.0, HOT * total))
    rest = placed.filter(F.col(size).isNull()).select(*rows.columns).join(small, key, "left")
    return placed.filter(F.col(size).isNotNull()).unionByName(rest)


def aside(docs: DataFrame, names: tuple[str, ...], f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of docs after f, which adds columns of these names; columns of docs that are called so are kept out of its way."""
    moved = {c: "_" * (1 + max(map(len, docs.columns))) + c for c in docs.columns if c in names}
    out = f(docs.withColumnsRenamed(moved))
    return out.select(*(F.col(moved.get(c, c)).alias(c) for c in docs.columns))


def kept_rows(docs: DataFrame, decisions: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of docs whose decision (the keys' names, kept) is to stay. keys are told from the columns of docs and hold no null.

    Of rows with one key of which some stay and some go, one stays. Columns of docs may have any names.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    gone = decisions.groupBy(*keys).agg(F.max("kept").alias("_stays"), F.count("*").alias("_rows")).filter("NOT _stays OR _rows > 1")
    gone = scratch.table(gone.select(*keys, "_stays"))
    bits = bits_for(gone.count())
    rows = docs.select(F.struct("*").alias("_row"), *(c.alias(k) for k, c in keys.items()))
    told = marked(rows, *keys, within=bitmap(gone, *keys, bits=bits), bits=bits)
    asked = told.filter("_in").drop("_in").join(gone.hint("shuffle_hash"), [*keys], "left").select("_row", *keys, "_stays")
    out = told.filter("NOT _in").select("_row").unionByName(asked.filter("_stays IS NULL").select("_row"))
    if not gone.filter("_stays").isEmpty():
        out = out.unionByName(asked.filter("_stays").dropDuplicates([*keys]).select("_row"))
    return out.select("_row.*")
