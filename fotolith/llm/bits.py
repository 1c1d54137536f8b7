"""A bounded bitmap over keys, built and asked with SQL functions: it may let a row pass that has no key in it, and never loses one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter, at least and at most: 128 KB to 32 MB are broadcast. A fuller filter lets more rows pass and stays right.
FEWEST_BITS, MOST_BITS = 1 << 20, 1 << 28
FILTER_BITS = 1 << 25
PAGE = 32768


def bits_for(keys: int) -> int:
    """The size of a filter over so many keys: 16 bits for each, within the bounds."""
    return min(MOST_BITS, max(FEWEST_BITS, 1 << (16 * max(keys, 1) - 1).bit_length()))


def _slot(keys: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits))


def bitmap(keys: DataFrame, *names: str, bits: int = FILTER_BITS, by: list[str] | None = None) -> DataFrame:
    """(page, bitmap) rows, bits / 32768 of them at most, with the bit of every row of keys; a bitmap for each value of the columns by."""
    slot = keys.select(*(by or []), _slot(list(names), bits).alias("slot"))
    return slot.groupBy(*(by or []), F.expr(f"slot div {PAGE}").alias("_page")).agg(F.bitmap_construct_agg(F.col("slot") % PAGE).alias("_bits"))


def either(bitmaps: DataFrame) -> DataFrame:
    """One bitmap with the bits of all."""
    return bitmaps.groupBy("_page").agg(F.bitmap_or_agg("_bits").alias("_bits"))


def marked(rows: DataFrame, *names: str, within: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows with a column `_in`: whether the key's bit is set in the bitmap."""
    held = rows.withColumn("_slot", _slot(list(names), bits)).join(F.broadcast(within), F.expr(f"_slot div {PAGE}") == F.col("_page"), "left")
    at = f"cast(_slot % {PAGE} as int)"
    byte = f"cast(conv(hex(substring(_bits, {at} div 8 + 1, 1)), 16, 10) as int)"
    return held.select(*rows.columns, F.expr(f"coalesce(shiftright({byte}, {at} % 8) & 1 = 1, false)").alias("_in"))


def passing(rows: DataFrame, *names: str, within: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose key's bit is set in the bitmap; columns as before."""
    return marked(rows, *names, within=within, bits=bits).filter("_in").drop("_in")
