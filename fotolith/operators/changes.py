"""Changes to a library's tables. Each returns a new version of a table; a writer overwrites the old one as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import recipe as R

from ..functions.text import KEYWORD_CHARS, ascii_lower, name_of, tidy

MARKS = ("rating", "flag", "label")
#: The longest name of an album, preset or smart collection.
NAME_CHARS = 60


def set_marks(photos: DataFrame, change: DataFrame) -> DataFrame:
    """photos with the marks of change (id, rating, flag, label); a null mark stays as it is."""
    new = change.select("id", *(F.col(m).alias(f"_{m}") for m in MARKS))
    return photos.join(new, "id", "left").withColumns({m: F.coalesce(f"_{m}", m) for m in MARKS}).drop(*(f"_{m}" for m in MARKS))


def import_marks(photos: DataFrame, found: DataFrame) -> DataFrame:
    """Marks of sidecars (id, rating, flag, label), taken only where a photo has none."""
    new = found.select("id", *(F.col(m).alias(f"_{m}") for m in MARKS))
    bare = (F.col("rating") == 0) & (F.col("flag") == 0) & (F.col("label") == 0)
    return photos.join(new, "id", "left").withColumns({m: F.when(bare, F.coalesce(f"_{m}", m)).otherwise(F.col(m)) for m in MARKS}).drop(*(f"_{m}" for m in MARKS))


def latest(events: DataFrame, key: str, order: list[str], gone: Column | None = None) -> DataFrame:
    """The last event of each key; keys whose last event says gone have none. Partial maxima are merged, so a hot key is no burden."""
    rest = [c for c in events.columns if c != key]
    held = events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("e")).select(key, "e.*")
    return held if gone is None else held.filter(~gone)


def fresh_links(links: DataFrame, new: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """The pairs of new that links lacks, each once; owners (one column) names those that exist, such as albums."""
    fresh = new.select(*links.columns).distinct().join(links, links.columns, "left_anti")
    return fresh if owners is None else fresh.join(owners, owners.columns, "left_semi")


def add_links(links: DataFrame, new: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """links with the pairs of new that it lacks."""
    return links.unionByName(fresh_links(links, new, owners))


def touched(table: DataFrame, fresh: DataFrame, key: str, now: int) -> DataFrame:
    """table (key, updated_at_ms) with the time of its last change where fresh has a row of it."""
    new = fresh.select(key).distinct().withColumn("_now", F.lit(now).cast("long"))
    return table.join(new, key, "left").withColumn("updated_at_ms", F.coalesce("_now", "updated_at_ms")).drop("_now")


def remove_links(links: DataFrame, gone: DataFrame) -> DataFrame:
    return links.join(gone.select(*[c for c in links.columns if c in gone.columns]).distinct(), [c for c in links.columns if c in gone.columns], "left_anti")


def add_keywords(names: DataFrame, typed: DataFrame) -> DataFrame:
    """Keyword names (name) with those typed (name) that are new but for case; of several spellings typed, the least is kept."""
    tidied = typed.select(name_of(F.col("name"), KEYWORD_CHARS).alias("name")).filter("name IS NOT NULL")
    fresh = tidied.groupBy(ascii_lower(F.col("name")).alias("lowered")).agg(F.min("name").alias("name"))
    held = names.select(ascii_lower(F.col("name")).alias("lowered"))
    return names.select("name").unionByName(fresh.join(held, "lowered", "left_anti").select("name"))


def used_keywords(names: DataFrame, links: DataFrame) -> DataFrame:
    """Keyword names that a photo has."""
    return names.join(links.select("name"), "name", "left_semi")


def set_text(photos: DataFrame, change: DataFrame, field: str) -> DataFrame:
    """photos with a text field of change (id, text) as it is kept; empty text clears it."""
    new = change.select("id", tidy(F.col("text"), field).alias("_t"), F.lit(True).alias("_set"))
    return photos.join(new, "id", "left").withColumn(field, F.when(F.col("_set"), F.col("_t")).otherwise(F.col(field))).drop("_t", "_set")


def paired(photos: list[int], texts: DataFrame) -> DataFrame:
    """A row for each photo asked for, in the order asked, with its texts or none."""
    spark = texts.sparkSession
    asked = spark.createDataFrame(list(enumerate(photos)), "pos long, id long")
    return asked.join(texts, "id", "left").orderBy("pos")


# Tables of named things (id, name, ..., created_at_ms, updated_at_ms): albums, presets, smart collections.


def create(table: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """table with the rows of new (nth from 1 on, name and any other columns), numbered on from the last id. Names that aren't valid are left out."""
    last = table.agg(F.coalesce(F.max("id"), F.lit(0).cast("long")).alias("_last"))  # one row
    rows = new.withColumn("name", name_of(F.col("name"), NAME_CHARS)).filter("name IS NOT NULL").join(F.broadcast(last))
    rows = rows.withColumns({"id": F.col("_last") + F.col("nth"), "created_at_ms": F.lit(now).cast("long"), "updated_at_ms": F.lit(now).cast("long")})
    return table.unionByName(rows.drop("_last", "nth"), allowMissingColumns=True)


def update(table: DataFrame, change: DataFrame, now: int) -> DataFrame:
    """table with the columns of change (id and those to set; a null stays as it is), and the time of the change. Unknown ids are ignored."""
    names = [c for c in change.columns if c != "id"]
    new = change.select("id", *(F.col(c).alias(f"_{c}") for c in names), F.lit(True).alias("_set"))
    out = table.join(new, "id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in names})
    return out.withColumn("updated_at_ms", F.when(F.col("_set"), F.lit(now).cast("long")).otherwise(F.col("updated_at_ms"))).select(*table.columns)


def delete(table: DataFrame, gone: DataFrame) -> DataFrame:
    """table without the ids of gone; what refers to them goes by remove_orphans."""
    return table.join(gone.select("id").distinct(), "id", "left_anti")


def remove_orphans(links: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """links whose key is still an id of table."""
    return links.join(table.select(F.col("id").alias(key)), key, "left_semi")


# Keywords of photos. names: one column, name; links: photo_id and name.


def _spelt(names: DataFrame, typed: DataFrame) -> DataFrame:
    """typed (photo_id, name) as keywords: valid ones, each once for a photo, spelt as names has them or else as the first of them in order."""
    rows = typed.select("photo_id", name_of(F.col("name"), KEYWORD_CHARS).alias("name")).filter("name IS NOT NULL").withColumn("_l", ascii_lower(F.col("name")))
    known = names.select(F.col("name").alias("_known"), ascii_lower(F.col("name")).alias("_l"))
    first = rows.groupBy("_l").agg(F.min("name").alias("_first")).join(known, "_l", "left").select("_l", F.coalesce("_known", "_first").alias("name"))
    return rows.select("photo_id", "_l").distinct().join(first, "_l").select("photo_id", "name")


def link_keywords(names: DataFrame, links: DataFrame, typed: DataFrame) -> DataFrame:
    """links with the keywords typed (photo_id, name); an existing keyword keeps its spelling. New names are those of the links."""
    return add_links(links, _spelt(names, typed))


def unlink_keywords(links: DataFrame, typed: DataFrame) -> DataFrame:
    """links without the keywords typed (photo_id, name), whatever their case. Names that no photo has any more go with used_keywords."""
    gone = typed.select("photo_id", ascii_lower(name_of(F.col("name"), KEYWORD_CHARS)).alias("_l")).filter("_l IS NOT NULL").distinct()
    return links.withColumn("_l", ascii_lower(F.col("name"))).join(gone, ["photo_id", "_l"], "left_anti").select(*links.columns)


def import_keywords(names: DataFrame, links: DataFrame, found: DataFrame) -> DataFrame:
    """links with the keywords found in sidecars (photo_id, name), taken only by photos that have none."""
    return link_keywords(names, links, found.join(links.select("photo_id").distinct(), "photo_id", "left_anti"))


# Details of photos, library folders.

METADATA_VERSION = 1


def set_details(photos: DataFrame, read: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """photos with details as read (id and columns); a file that couldn't be read has nulls, and counts as read until it changes."""
    new = read.select("id", *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_set"))
    set_ = F.coalesce("_set", F.lit(False))
    out = photos.join(new, "id", "left").withColumns({c: F.when(set_, F.col(f"_{c}")).otherwise(F.col(c)) for c in columns})
    return out.withColumn("metadata_version", F.when(set_, METADATA_VERSION).otherwise(F.col("metadata_version"))).select(*photos.columns)


def add_folder(folders: DataFrame, path: str, now: int) -> DataFrame:
    """folders (id, path, added_at_ms) with one more; one that is there stays as it is."""
    last = folders.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast("long").alias("id"), F.coalesce(F.bool_or(F.col("path") == path), F.lit(False)).alias("_has"))
    return folders.unionByName(last.filter("NOT _has").select("id", F.lit(path).alias("path"), F.lit(now).cast("long").alias("added_at_ms")))


def remove_folder(folders: DataFrame, files: DataFrame, photos: DataFrame, folder_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without a folder, its files, and photos without any other file."""
    kept = files.filter(F.col("folder_id") != folder_id)
    return folders.filter(F.col("id") != folder_id), kept, photos.join(kept.select(F.col("photo_id").alias("id")), "id", "left_semi")


def finish_scan(files: DataFrame, folder_id: int, scan: int, within: str | None = None) -> DataFrame:
    """files of which those of a folder (within: at or below that path) that the scan didn't see are missing."""
    mine = (F.col("folder_id") == folder_id) & (F.col("last_seen_scan") != scan)
    if within is not None:
        at = within.rstrip("/\\")
        mine = mine & ((F.col("dir") == at) | F.col("dir").startswith(at + "/"))
    return files.withColumn("missing", F.col("missing") | mine)


def save_edits(edits: DataFrame, new: DataFrame, now: int, version: int) -> DataFrame:
    """edits (photo_id, recipe_version, recipe, updated_at_ms) after saving new (photo_id, recipe as JSON, plain: whether it changes nothing).

    A plain recipe removes the edit; an edit of a newer version is left alone.
    """
    put = new.select("photo_id", F.col("recipe").alias("_recipe"), "plain")
    both = edits.join(put, "photo_id", "full")
    newer = F.coalesce(F.col("recipe_version") > version, F.lit(False))
    takes = F.col("plain").isNotNull() & ~newer
    out = both.filter(~takes | ~F.col("plain")).select(
        "photo_id", F.when(takes, version).otherwise(F.col("recipe_version")).cast("int").alias("recipe_version"), F.when(takes, F.col("_recipe")).otherwise(F.col("recipe")).alias("recipe"),
        F.when(takes, F.lit(now).cast("long")).otherwise(F.col("updated_at_ms")).alias("updated_at_ms"),
    )
    return out.filter("recipe IS NOT NULL")


def save_recipes(edits: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """save_edits() of recipes (photo_id, recipe as JSON) that aren't taken on trust: read, put in range, told whether they change anything, and kept as one text for one edit.

    Recipes that can't be read, or are of a newer version, are left out.
    """
    read = new.select("photo_id", R.parsed(F.col("recipe")).alias("_r")).filter("_r IS NOT NULL")
    return save_edits(edits, read.select("photo_id", R.to_json(F.col("_r")).alias("recipe"), R.is_identity(F.col("_r")).alias("plain")), now, R.VERSION)


def refused(edits: DataFrame, new: DataFrame, version: int) -> DataFrame:
    """The photos (photo_id) of new whose edit is of a newer version."""
    return new.select("photo_id").join(edits.filter(F.col("recipe_version") > version).select("photo_id"), "photo_id", "left_semi")
