"""Backups to keep, and free names for exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import running

DAY_MS = 86_400_000
# The newest backups kept of either kind, days with one each, and days up to which weeks have one each.
NEWEST, UPGRADES, DAYS, WEEK_DAYS = 3, 2, 7, 35
#: A numbered name, and all numbers at a name's end.
NUMBERED, LEVELS = r"(?s)^(.+)-([2-9]|[1-9]\d{1,8})$", r"(?:-(?:[2-9]|[1-9]\d{1,8}))+$"


def to_prune(backups: DataFrame, now: int) -> DataFrame:
    """backups (path, taken_at_ms, kind) that go. Kept: the newest few, the newest of each recent day and week, and the newest before upgrades.

    Ranks over all backups would meet in one task, so the newest are told by a bounded top-n and joined; buckets are windows of their own.
    """
    upgrade = F.col("kind") == "pre-upgrade"
    order = [F.col("taken_at_ms").desc(), F.col("path")]
    newest = backups.filter(~upgrade).orderBy(*order).limit(NEWEST).unionByName(backups.filter(upgrade).orderBy(*order).limit(UPGRADES)).select("path")
    age = F.lit(now) - F.col("taken_at_ms")
    day, week = F.floor(F.col("taken_at_ms") / DAY_MS), F.floor(F.col("taken_at_ms") / (7 * DAY_MS))
    bucket = F.when(age < DAYS * DAY_MS, F.concat(F.lit("day"), day)).when(age < WEEK_DAYS * DAY_MS, F.concat(F.lit("week"), week))
    held = backups.filter(~upgrade).withColumn("bucket", bucket).filter("bucket IS NOT NULL")
    first = held.withColumn("nth", F.row_number().over(Window.partitionBy("bucket").orderBy(*order))).filter("nth = 1").select("path")
    return backups.join(newest.union(first).distinct(), "path", "left_anti")


def newest_valid(backups: DataFrame) -> DataFrame:
    """The newest backup that passed its check (valid)."""
    return backups.filter("valid").agg(F.max_by("path", F.struct("taken_at_ms", "path")).alias("path"))


def listed(files: DataFrame) -> DataFrame:
    """Backups by the names of files (name): catalogue-<13 digits>-<kind>.sqlite, newest first; other names are left out."""
    pattern = r"^catalogue-(\d{13})-(auto|manual|pre-upgrade-v\d+)\.sqlite$"
    at, kind = (F.regexp_extract("name", pattern, i) for i in (1, 2))
    held = files.filter(F.col("name").rlike(pattern))
    return held.select("name", at.cast("long").alias("taken_at_ms"), F.regexp_replace(kind, r"-v\d+$", "").alias("kind")).orderBy(F.col("taken_at_ms").desc(), "name")


def export_names(sources: DataFrame, extension: str, taken: DataFrame) -> DataFrame:
    """path and a free name each, as if one source after the other, by path, took the first free one of stem, stem-2, stem-3 and so on.

    sources: path; taken: names (name) that exist. No two sources get one name. A number of a stem is lost to it if its name is taken, or if it is the stem of other
    sources and the first of them comes before the source that would get it; if that one comes first, the other stem loses its own name. Stems are
    settled with those whose numbered names they are first, so there are as many rounds as a stem has such numbers at its end.
    """
    stem = F.coalesce(F.nullif(F.regexp_extract("path", r"([^/\\]+?)(?:\.[^./\\]*)?$", 1), F.lit("")), F.lit("Photo"))
    rows = sources.select("path", stem.alias("stem"))
    ends = "." + extension
    names = taken.filter(F.col("name").endswith(ends)).select(F.expr(f"substr(name, 1, length(name) - {len(ends)})").alias("stem")).distinct()
    own = rows.groupBy("stem").agg(F.min("path").alias("path"))
    # Each stem that is a numbered name of another one stands in that one's order where its first source is.
    number = F.regexp_extract("stem", NUMBERED, 2)
    parent, k = F.regexp_extract("stem", NUMBERED, 1), F.when(number != "", number.try_cast("int"))
    numbered = own.filter(k.isNotNull()).select("path", parent.alias("stem"), k.alias("k"))
    marks = numbered.join(own.select("stem"), "stem", "left_semi").select("path", "stem", "k")
    placed = rows.withColumn("k", F.lit(None).cast("int")).unionByName(marks)
    order = [F.col("stem"), F.col("path"), F.col("k")]
    nth = running(placed, "nth", F.array("stem", "path"), order, F.when(F.col("k").isNull(), F.lit(1)).otherwise(F.lit(0)).cast("long"))
    first = nth.filter("k IS NULL").groupBy("stem").agg((F.min("nth") - 1).alias("before"))
    nth = nth.join(first, "stem").withColumn("nth", F.col("nth") - F.col("before")).drop("before")
    # Numbers of a stem that may be lost, each with how many of its sources come before who else wants it.
    own_taken = names.select("stem", F.lit(1).alias("k"), F.lit(0).cast("long").alias("ahead"))
    lost = own_taken.unionByName(names.filter(k.isNotNull()).select(parent.alias("stem"), k.alias("k"), F.lit(0).cast("long").alias("ahead")))
    lost = lost.join(own.select("stem"), "stem", "left_semi").unionByName(nth.filter("k IS NOT NULL").select("stem", "k", F.col("nth").alias("ahead")))
    lost = lost.groupBy("stem", "k").agg(F.min("ahead").alias("ahead")).withColumn("level", F.regexp_count(F.regexp_extract("stem", LEVELS, 0), F.lit("-")))
    deepest = lost.agg(F.max("level")).first()[0]
    # A number k that is lost with c free ones below it is skipped by all sources after the c-th; the others go to sources of the stem.
    free = lambda s, x: x["k"] - 1 - F.size(s["skips"])
    step = lambda s, x: F.when(free(s, x) >= x["ahead"], F.struct(F.array_append(s["skips"], free(s, x)).alias("skips"), s["won"].alias("won"))).otherwise(F.struct(s["skips"].alias("skips"), F.array_append(s["won"], x["k"]).alias("won")))
    none = F.array().cast("array<int>")
    skips = above = sources.sparkSession.createDataFrame([], "stem string, k int, ahead long")
    skips = skips.select("stem", none.alias("skips"))
    for at in range(deepest + 2 if deepest is not None else 0):
        here = lost.filter(F.col("level") == at).select("stem", "k", "ahead").unionByName(above).groupBy("stem", "k").agg(F.min("ahead").alias("ahead"))
        known = here.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("k", "ahead"))).alias("all"))
        known = known.select("stem", F.aggregate("all", F.struct(none.alias("skips"), none.alias("won")), step).alias("s"))
        skips = skips.unionByName(known.select("stem", "s.skips"))
        # Stems called like a number that went to another stem have lost their own name.
        won = known.select("stem", F.explode("s.won").alias("k"))
        above = won.select(F.concat_ws("-", "stem", "k").alias("stem"), F.lit(1).alias("k"), F.lit(0).cast("long").alias("ahead"))
    held = nth.filter("k IS NULL").join(skips, "stem", "left")
    k = F.col("nth") + F.coalesce(F.size(F.filter("skips", lambda c: c < F.col("nth"))), F.lit(0))
    name = F.when(k == 1, F.col("stem")).otherwise(F.concat_ws("-", "stem", k.cast("string")))
    return held.select("path", F.concat(name, F.lit(ends)).alias("name"))
