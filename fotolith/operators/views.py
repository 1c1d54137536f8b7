"""What a library view shows: filters, orders and ranges over listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import natural_key
from .catalogue import COLLECTIONS

FILTERS = {"all": lambda: F.lit(True), "picks": lambda: F.col("flag") == 1, "rated3": lambda: F.col("rating") >= 3}
#: Collections that hold what the catalogue chose, whatever the marks.
CHOSEN = ("recent", "edited")


def visible(rows: DataFrame, filter_: str = "all", collection: str | None = None, label: int | None = None) -> DataFrame:
    """The rows of a listing (rating, flag, label) that a view shows."""
    where = FILTERS[filter_]()
    if collection is not None and collection not in CHOSEN:
        where = where & COLLECTIONS[collection](0)
    return rows.filter(where if label is None else where & (F.col("label") == label))


def order(sort: str, name: Column) -> list[Column]:
    """The columns of an order: captured, newest, name or rating. Unknown times come last; ties go by name and path."""
    by_name = [natural_key(name), F.col("path")]
    time = F.col("captured_at")
    return {
        "captured": [time.asc_nulls_last(), *by_name],
        "newest": [time.desc_nulls_last(), *by_name],
        "name": by_name,
        "rating": [F.col("rating").desc(), time.asc_nulls_last(), *by_name],
    }[sort]


def ticked(shown: DataFrame, anchor: str | None, path: str) -> DataFrame:
    """The rows (place, path) from anchor to path, either way round; path alone without an anchor on show; none if path isn't shown."""
    ends = shown.filter(F.col("path").isin([p for p in (anchor, path) if p is not None]))
    at = ends.agg(F.max(F.when(F.col("path") == path, F.col("place"))).alias("_to"), F.max(F.when(F.col("path") == anchor, F.col("place"))).alias("_from"))  # one row
    held = shown.join(F.broadcast(at))
    start = F.coalesce("_from", "_to")
    return held.filter(F.col("place").between(F.least(start, "_to"), F.greatest(start, "_to"))).drop("_to", "_from")
