"""Incremental indexing: what a folder's snapshot says against the catalogue, as one plan without a loop over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STAT = ("size", "modified_ns")


def outcomes(known: DataFrame, snapshot: DataFrame, elsewhere: DataFrame | None = None) -> DataFrame:
    """id, path, outcome (unchanged, changed, moved, new or missing) and from_path of moved files.

    known: id, path, size, modified_ns, fingerprint and, if any, missing. snapshot: the same without id and missing. A file of a path that isn't known takes over
    a known file of equal size and fingerprint whose path is gone: one each, missing ones first, then by id; new paths in order. elsewhere: paths (path) outside the
    snapshot that still exist, whose files keep their place.
    """
    known = known.select("id", "path", *STAT, "fingerprint", (F.col("missing") if "missing" in known.columns else F.lit(False)).alias("gone"))
    k, s = known.alias("k"), snapshot.alias("s")
    both = k.join(s, F.col("k.path") == F.col("s.path"), "full")
    seen = both.filter("k.path IS NOT NULL AND s.path IS NOT NULL")
    same = (F.col("k.size") == F.col("s.size")) & (F.col("k.modified_ns") == F.col("s.modified_ns"))
    settled = seen.select("k.id", "k.path", F.when(same, "unchanged").otherwise("changed").alias("outcome"), F.lit(None).cast("string").alias("from_path"))
    lost = both.filter("s.path IS NULL").select("k.id", "k.path", "k.size", "k.fingerprint", "k.gone")
    if elsewhere is not None:
        lost = lost.join(elsewhere.select("path"), "path", "left_anti")
    fresh = both.filter("k.path IS NULL").select("s.path", "s.size", "s.fingerprint")
    key = ["size", "fingerprint"]
    old = lost.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("gone").desc(), "id")))
    new = fresh.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("path")))
    pairs = new.alias("n").join(old.alias("o"), [*key, "nth"], "full").select("o.id", F.col("n.path").alias("to_path"), F.col("o.path").alias("old_path"))
    moved, gone = F.col("to_path").isNotNull() & F.col("old_path").isNotNull(), F.col("to_path").isNull()
    outcome = F.when(moved, "moved").when(gone, "missing").otherwise("new")
    rest = pairs.select("id", F.coalesce("to_path", "old_path").alias("path"), outcome.alias("outcome"), F.when(moved, F.col("old_path")).alias("from_path"))
    return settled.unionByName(rest)


def summary(found: DataFrame) -> DataFrame:
    """How many files had each outcome, as one row."""
    kinds = ("new", "changed", "moved", "unchanged", "missing")
    return found.agg(*(F.count_if(F.col("outcome") == k).alias(f"n_{k}") for k in kinds))


def next_scan(files: DataFrame) -> DataFrame:
    return files.agg((F.coalesce(F.max("last_seen_scan"), F.lit(0)) + 1).cast("long").alias("scan"))


def orphans(photos: DataFrame, files: DataFrame) -> DataFrame:
    """Photos without any file."""
    return photos.join(files.select(F.col("photo_id").alias("id")), "id", "left_anti")


def without_folder(files: DataFrame, folder_id: int) -> DataFrame:
    return files.filter(F.col("folder_id") != folder_id)
