"""Collections, rules, albums, keywords and listings over a library's tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower
from .search import below_library, matching, terms

RECENT_MS = 30 * 24 * 60 * 60 * 1000
DETAILS = ("camera_make", "camera_model", "lens", "captured_at", "iso", "aperture", "shutter", "focal_length", "width", "height", "rotation")
#: Details that are numbers; listings show them as doubles, so that unknown ones stay apart from 0.
NUMBERS = ("iso", "aperture", "shutter", "focal_length", "width", "height", "rotation")
ENTRY = ("id", "path", "size", "modified_ns", "rating", "flag", "label", "edited")
#: Whether a collection holds a photo, by name; `now` is in ms. Recently edited goes by the edits.
COLLECTIONS = {
    "all": lambda now: F.lit(True),
    "picks": lambda now: F.col("flag") == 1,
    "rated": lambda now: F.col("rating") > 0,
    "favourites": lambda now: F.col("rating") == 5,
    "rejected": lambda now: F.col("flag") == -1,
    "recent": lambda now: F.col("created_at_ms") >= now - RECENT_MS,
    "edited": lambda now: F.col("edited_at_ms") >= now - RECENT_MS,
}


class Catalogue:
    """The queries of one library (an object with photos(), files(), folders(), edits(), ... as DataFrames)."""

    def __init__(self, library):
        self.library = library

    def present(self) -> DataFrame:
        """Photos with their present files and whether they are edited: the base of all listings."""
        files = self.library.files().filter("NOT missing").select("photo_id", "folder_id", "path", "dir", "size", "modified_ns")
        edits = self.library.edits().select(F.col("photo_id").alias("id"), F.col("updated_at_ms").alias("edited_at_ms"))
        held = self.library.photos().join(files, F.col("id") == F.col("photo_id")).drop("photo_id").join(edits, "id", "left")
        return held.withColumn("edited", F.col("edited_at_ms").isNotNull())

    def once(self) -> DataFrame:
        """Photos that have a present file, once however many they have, with their edits: what counts need."""
        files = self.library.files().filter("NOT missing").select(F.col("photo_id").alias("id"))
        edits = self.library.edits().select(F.col("photo_id").alias("id"), F.col("updated_at_ms").alias("edited_at_ms"))
        return self.library.photos().join(files, "id", "left_semi").join(edits, "id", "left").withColumn("edited", F.col("edited_at_ms").isNotNull())

    def entries(self, rows: DataFrame, order: Sequence[Column] | None = None) -> DataFrame:
        """The columns of a listing: details only where they were read, gps only with both coordinates; by capture, unknown last."""
        read = F.col("metadata_version") > 0
        shown = [F.when(read, F.col(c).cast("double") if c in NUMBERS else F.col(c)).alias(c) for c in DETAILS]
        both = read & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
        gps = [F.when(both, F.col(c)).alias(c) for c in ("latitude", "longitude")]
        order = order or (F.col("captured_at").asc_nulls_last(), F.col("path"))
        return rows.orderBy(*order).select(*ENTRY, *shown, *gps)

    def collection(self, kind: str, now: int) -> DataFrame:
        rows = self.present().filter(COLLECTIONS[kind](now))
        return self.entries(rows, (F.col("edited_at_ms").desc(), F.col("path")) if kind == "edited" else None)

    def counts(self, now: int) -> DataFrame:
        """The sizes of all collections in one pass; photos count once however many files they have."""
        return self.once().agg(*(F.count_if(where(now)).alias(f"n_{kind}") for kind, where in COLLECTIONS.items()))

    def _names(self) -> DataFrame | None:
        """The keyword names, where the library keeps them apart from the links."""
        return self.library.keywords() if hasattr(self.library, "keywords") else None

    def searchable(self) -> DataFrame:
        roots = self.library.folders().select(F.col("id").alias("folder_id"), F.col("path").alias("root"))
        return self.present().join(roots, "folder_id").withColumn("below", below_library(F.col("path"), F.col("root")))

    def search(self, query: str) -> DataFrame:
        """Present photos that match every word; none for a query without words."""
        found = terms(query)
        rows = self.searchable()
        return self.entries(matching(rows, found, self.library.photo_keywords(), self._names()) if found else rows.limit(0))

    def matching(self, rules: Rules) -> DataFrame:
        return self.entries(self._ruled(rules))

    def _ruled(self, rules: Rules) -> DataFrame:
        rows = self.searchable().filter(rules.predicate())
        found = terms(rules.words)
        if found:
            rows = matching(rows, found, self.library.photo_keywords(), self._names())
        if rules.keyword and rules.keyword.strip():
            named = self.library.photo_keywords().filter(ascii_lower(F.col("name")) == ascii_lower(F.lit(rules.keyword.strip())))
            rows = rows.join(named.select(F.col("photo_id").alias("id")), "id", "left_semi")
        return rows

    def rule_counts(self, stored: dict[str, Rules]) -> DataFrame:
        """name, n for each set of rules. Rules over marks and edits are counted in one pass, those with words by a plan of their own."""
        plain = {k: r for k, r in stored.items() if not r.words and not r.keyword}
        out = None
        if plain:
            one = self.once().agg(*(F.count_if(r.predicate()).alias(k) for k, r in plain.items()))
            out = one.selectExpr(f"stack({len(plain)}, {', '.join(f"'{k}', `{k}`" for k in plain)}) AS (name, n)")
        for k, r in stored.items():
            if k not in plain:
                n = self._ruled(r).agg(F.count_distinct("id").alias("n")).select(F.lit(k).alias("name"), "n")
                out = n if out is None else out.unionByName(n)
        return out

    def albums(self) -> DataFrame:
        """Albums with the number of present photos and the cover, the first of them by capture."""
        files = self.library.files().filter("NOT missing").select("photo_id", "path")
        rows = self.library.album_photos().join(files, "photo_id").join(self.library.photos().select(F.col("id").alias("photo_id"), "captured_at"), "photo_id")
        first = F.min(F.struct(F.col("captured_at").isNull().alias("none"), "captured_at", "path"))
        held = rows.groupBy(F.col("album_id").alias("id")).agg(F.count_distinct("photo_id").alias("n"), first.alias("c"))
        return self.library.albums().join(held, "id", "left").select("id", "name", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.col("c.path").alias("cover"))

    def album(self, album_id: int) -> DataFrame:
        inside = self.library.album_photos().filter(F.col("album_id") == album_id).select(F.col("photo_id").alias("id"))
        return self.entries(self.present().join(inside, "id", "left_semi"))

    def keywords(self) -> DataFrame:
        """Keywords in use, with their numbers of photos, by name."""
        return self.library.photo_keywords().groupBy("name").agg(F.count("*").alias("n")).orderBy(ascii_lower(F.col("name")), "name")

    def keywords_on(self, photos: DataFrame) -> DataFrame:
        """Keywords of the photos (id), with the number of those that have each."""
        links = self.library.photo_keywords().join(photos.select(F.col("id").alias("photo_id")), "photo_id", "left_semi")
        return links.groupBy("name").agg(F.count("*").alias("n")).orderBy(ascii_lower(F.col("name")), "name")

    def suggestions(self, typed: str, photos: DataFrame, limit: int = 6) -> DataFrame:
        """Keywords that hold what is typed: prefixes first, then by use and name; without those that all the photos have."""
        typed = typed.strip().lower()
        lowered = ascii_lower(F.col("name"))
        rank = F.when(lowered.startswith(typed), 0).otherwise(1)
        full = self.keywords_on(photos).join(photos.agg(F.count_distinct("id").alias("total")), F.col("n") == F.col("total")).select("name")
        rows = self.keywords().filter(lowered.contains(typed)).join(full, "name", "left_anti")
        return rows.withColumn("rank", rank).orderBy("rank", F.col("n").desc(), "name").limit(limit)

    def marked(self) -> DataFrame:
        """Present photos with a mark or a keyword."""
        tagged = self.library.photo_keywords().select(F.col("photo_id").alias("id")).distinct().withColumn("tagged", F.lit(True))
        rows = self.present().join(tagged, "id", "left")
        return self.entries(rows.filter("rating > 0 OR flag <> 0 OR label <> 0 OR tagged"))

    # Single photos and folders; each is a filter, so that Spark reads only what it needs.

    def photo_at(self, path: str) -> DataFrame:
        """The photo (id) whose file is at a path, and whether the file is missing."""
        return self.library.files().filter(F.col("path") == path).select(F.col("photo_id").alias("id"), "missing")

    def marks(self, photos: DataFrame) -> DataFrame:
        """Marks of the photos (id)."""
        return self.library.photos().select("id", "rating", "flag", "label").join(photos.select("id").distinct(), "id", "left_semi")

    def marks_in(self, folder: str) -> DataFrame:
        """path, rating, flag and label of files of one folder whose photo has a mark."""
        marked = self.library.photos().filter("rating > 0 OR flag <> 0 OR label <> 0").select(F.col("id").alias("photo_id"), "rating", "flag", "label")
        return self.files_in(folder, False).select("photo_id", "path").join(marked, "photo_id").drop("photo_id")

    def details(self, photos: DataFrame) -> DataFrame:
        """Details of the photos (id) whose files were read."""
        return self._details(self.library.photos().join(photos.select("id").distinct(), "id", "left_semi"), "id")

    def details_in(self, folder: str) -> DataFrame:
        """path and details of files of one folder that were read."""
        files = self.files_in(folder, False).select(F.col("photo_id").alias("id"), "path")
        return self._details(self.library.photos().join(files, "id"), "path")

    def _details(self, rows: DataFrame, key: str) -> DataFrame:
        shown = [F.col(c).cast("double").alias(c) if c in NUMBERS else F.col(c) for c in DETAILS]
        both = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
        return rows.filter("metadata_version > 0").select(key, *shown, *(F.when(both, F.col(c)).alias(c) for c in ("latitude", "longitude")))

    def edits_of(self, photos: DataFrame) -> DataFrame:
        """The saved edits of the photos (id)."""
        return self.library.edits().join(photos.select(F.col("id").alias("photo_id")).distinct(), "photo_id", "left_semi")

    def edits_in(self, folder: str, recursive: bool) -> DataFrame:
        """path and saved edit of present files of a folder."""
        return self.files_in(folder, recursive).filter("NOT missing").select("photo_id", "path").join(self.library.edits(), "photo_id").drop("photo_id")

    def texts(self, photos: DataFrame) -> DataFrame:
        """id, title and caption of the photos (id); null for those that aren't known."""
        return photos.select("id").distinct().join(self.library.photos().select("id", "title", "caption"), "id", "left")

    def files_in(self, folder: str, recursive: bool) -> DataFrame:
        """Files of a folder, or of all below it; the path is taken literally."""
        folder = folder.rstrip("/\\")
        inside = F.col("dir") == folder
        if recursive:
            inside = inside | F.col("dir").startswith(folder + "/")
        return self.library.files().filter(inside)

    def listing(self, folder: str) -> DataFrame:
        """A folder's files with details, marks and whether they are edited; photos that aren't known have none."""
        known = self.library.photos().select(F.col("id").alias("photo_id"), "rating", "flag", "label", "camera_model", "captured_at", "metadata_version")
        edits = self.library.edits().select("photo_id", F.lit(True).alias("has_edit"))
        rows = self.files_in(folder, True).select("photo_id", "path", "size").join(known, "photo_id", "left").join(edits, "photo_id", "left")
        read = F.col("metadata_version") > 0
        return rows.select("path", "size", "rating", "flag", "label", F.when(read, F.col("camera_model")).alias("camera_model"), F.when(read, F.col("captured_at")).alias("captured_at"), F.coalesce("has_edit", F.lit(False)).alias("edited"))

    def details_queue(self, folder: str, limit: int) -> DataFrame:
        """Present photos of a folder whose details aren't read yet, the first by id."""
        files = self.files_in(folder, True).filter("NOT missing").select("photo_id", "path")
        rows = self.library.photos().filter("metadata_version < 1").select("id").join(files, F.col("id") == F.col("photo_id"))
        return rows.select("id", "path").orderBy("id").limit(limit)

    def within(self, roots: Sequence[str]) -> DataFrame:
        """Files under a granted root, with the deepest of those; paths that step up are refused.

        Roots are a short list that a user granted, so they are told by expressions on each file; nothing is joined or dealt out.
        """
        root = F.lit(None).cast("string")
        for r in sorted({r.rstrip("/\\") for r in roots}, key=len):
            root = F.when((F.col("path") == r) | F.col("path").startswith(r + "/"), r).otherwise(root)
        files = self.library.files().select("id", "path").filter(~F.col("path").rlike(r"(^|/)\.\.(/|$)"))
        return files.withColumn("root", root).filter("root IS NOT NULL")

    def neighbours(self, rows: DataFrame) -> DataFrame:
        """Each row's neighbours in the listing of its folder, by capture and path."""
        w = Window.partitionBy("dir").orderBy(F.col("captured_at").asc_nulls_last(), "path")
        return rows.select("id", "dir", F.lag("id").over(w).alias("before"), F.lead("id").over(w).alias("after"))


@dataclass(frozen=True)
class Rules:
    """Rules of a smart collection; None stands for any. rating 0 is unrated; flag 2 is not rejected."""

    rating: int | None = None
    flag: int | None = None
    label: int | None = None
    edited: bool | None = None
    words: str = ""
    keyword: str | None = None

    def is_empty(self) -> bool:
        return (self.rating, self.flag, self.label, self.edited) == (None,) * 4 and not (self.keyword or "").strip() and not terms(self.words)

    def predicate(self) -> Column:
        """What the rules say on marks and edits."""
        out = F.lit(True)
        if self.rating is not None:
            out = out & ((F.col("rating") == 0) if self.rating == 0 else (F.col("rating") >= self.rating))
        if self.flag is not None:
            out = out & ((F.col("flag") != -1) if self.flag == 2 else (F.col("flag") == self.flag))
        if self.label is not None:
            out = out & (F.col("label") == self.label)
        if self.edited is not None:
            out = out & (F.col("edited") == self.edited)
        return out


def checked_rules(name: str, rules: Rules) -> tuple[str, Rules]:
    """A smart collection as it is saved: name and words squashed; refused without a name or a rule."""
    name = " ".join(name.split())[:200]
    if not name or rules.is_empty():
        raise ValueError("a smart collection needs a name and a rule")
    return name, Rules(rules.rating, rules.flag, rules.label, rules.edited, " ".join(rules.words.split())[:200], rules.keyword)
