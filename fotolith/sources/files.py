"""Folders of photos as tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fingerprint import file_fingerprint
from ..functions.text import natural_key

# Formats by extension.
FORMATS = {"jpg": "jpeg", "jpeg": "jpeg", "png": "png", "tif": "tiff", "tiff": "tiff"}


def decoder_for(path: Column) -> Column:
    """The format of a file by its extension; raw for all others that cameras write."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    out = F.when(ext != "", "raw")
    for e, name in FORMATS.items():
        out = F.when(ext == e, name).otherwise(out)
    return out


def walk(spark: SparkSession, root: str, extensions: list[str], content: bool = False) -> DataFrame:
    """path, size, modified_ms of all files below root with one of the extensions, whatever their case; names that begin with a dot and what is below them are left out.

    The listing reads no bytes; with content, a column has them and fingerprint their hash. root may be a URI; paths of local files have no scheme,
    those of other file systems keep theirs.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root)
    held = files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_ms"), *(["content"] if content else []))
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    # What is below the root, whatever scheme, host and slashes either is written with.
    bare = F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
    at = re.sub("^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", root).rstrip("/")
    below = F.when(bare.startswith(at + "/"), F.substr(bare, F.lit(len(at) + 1))).otherwise(bare)
    held = held.filter(ext.isin([e.lower() for e in extensions]) & ~below.rlike(r"/\."))
    return held.withColumn("fingerprint", file_fingerprint(F.col("content"), F.col("size"))) if content else held


def listing(files: DataFrame, folder: str) -> DataFrame:
    """The files of one folder in natural order."""
    return files.filter(F.regexp_replace("path", r"/[^/]*$", "") == folder.rstrip("/")).orderBy(natural_key(F.col("path")), "path")


def folders_in(files: DataFrame, folder: str) -> DataFrame:
    """The folders directly in a folder that have a file below, with the number of those, in natural order."""
    at = folder.rstrip("/") + "/"
    below = files.filter(F.col("path").startswith(at)).select(F.substr(F.col("path"), F.lit(len(at) + 1)).alias("rest")).filter(F.col("rest").contains("/"))
    found = below.groupBy(F.concat(F.lit(at), F.substring_index("rest", "/", 1)).alias("path")).agg(F.count("*").alias("n"))
    return found.orderBy(natural_key(F.col("path")), "path")


def walked(entries: DataFrame, extensions: list[str]) -> DataFrame:
    """How many entries (path, size) of a listing are photos, how many others were skipped, and how many hidden ones: one row."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1)).isin([e.lower() for e in extensions])
    hidden = F.col("path").rlike(r"/\.")
    return entries.agg(F.count_if(ext & ~hidden).alias("photos"), F.count_if(~ext & ~hidden).alias("skipped"), F.count_if(hidden).alias("hidden"))
