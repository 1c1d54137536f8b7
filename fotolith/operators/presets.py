"""Presets: built-in looks, stored ones, and files of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import recipe as R

# The built-in looks, in their order, and what a file says.
BUILTIN = (
    ("natural", "Natural", {"vibrance": 12, "contrast": 8, "shadows": 10}),
    ("vivid", "Vivid", {"contrast": 25, "vibrance": 35, "saturation": 10, "clarity": 15}),
    ("warm-film", "Warm film", {"temperature": 30, "contrast": -10, "blacks": 25, "saturation": -10, "vignette": -25, "highlights": -20}),
    ("matte", "Matte", {"contrast": -25, "blacks": 40, "saturation": -15}),
    ("mono", "Mono", {"saturation": -100, "contrast": 30, "clarity": 20}),
    ("cool-fade", "Cool fade", {"temperature": -30, "tint": 6, "blacks": 30, "contrast": -15}),
)
#: The format that files name unless a caller names another one, for files that other programs read.
FORMAT, FORMAT_VERSION = "fotolith-preset", 1


def builtin(spark) -> DataFrame:
    """place, id, name and recipe of the built-in looks."""
    rows = [(n, i, name, "{" + ",".join(f'"{k}":{v}' for k, v in ({"version": R.VERSION} | look).items()) + "}") for n, (i, name, look) in enumerate(BUILTIN)]
    return spark.createDataFrame(rows, "place long, id string, name string, json string").select("place", "id", "name", R.parsed(F.col("json")).alias("recipe"))


def listed(stored: DataFrame) -> DataFrame:
    """id (as text), name and recipe: the built-in looks, then those of stored (id, name, recipe as JSON, created_at_ms), the oldest first.

    Stored ones that can't be read or are of a newer version are left out of the list; they stay in the table.
    """
    own = stored.select(F.col("created_at_ms").alias("place"), F.col("id").alias("_n"), F.col("id").cast("string").alias("id"), "name", R.parsed(F.col("recipe")).alias("recipe"))
    own = own.filter("recipe IS NOT NULL").withColumn("recipe", R.look_only(F.col("recipe"))).withColumn("_own", F.lit(True))
    first = builtin(stored.sparkSession).withColumns({"_n": F.lit(0).cast("long"), "_own": F.lit(False)})
    return first.unionByName(own).orderBy("_own", "place", "_n").select("id", "name", "recipe")


def to_file(name: Column, recipe: Column) -> Column:
    """A preset as the text of a file: its name and its look."""
    said = F.struct(F.lit(FORMAT).alias("format"), F.lit(FORMAT_VERSION).alias("formatVersion"), name.alias("name"), R.look_only(recipe).alias("recipe"))
    return F.to_json(said, {"ignoreNullFields": "true"})


def from_file(text: Column) -> Column:
    """name, recipe (its look) and outcome of a file's text: read, newer or no preset."""
    text = F.regexp_replace(text, "^﻿", "")
    version = F.get_json_object(text, "$.formatVersion").cast("int")
    inner = F.get_json_object(text, "$.recipe")
    ours = F.coalesce((F.get_json_object(text, "$.format") == FORMAT) & version.isNotNull(), F.lit(False))
    newer = (version > FORMAT_VERSION) | (F.get_json_object(inner, "$.version").cast("int") > R.VERSION)

    def told(r: Column) -> Column:
        outcome = F.when(ours & F.coalesce(newer, F.lit(False)), "newer").when(ours & r.isNotNull(), "read").otherwise("no preset")
        return F.struct(outcome.alias("outcome"), F.when(outcome == "read", F.coalesce(F.get_json_object(text, "$.name"), F.lit(""))).alias("name"), F.when(outcome == "read", R.look_only(r)).alias("recipe"))

    return R.bound(R.parsed(inner), told)
