"""Word search: a query becomes terms, terms become one column predicate over photos, files and keyword links."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower

# Words used of a query, years and the names of months.
MAX_TERMS = 8
YEARS = range(1900, 2201)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


@dataclass(frozen=True)
class Term:
    """One word: kind is text, year, month, day or date; value the number of a month, else the word."""

    kind: str
    word: str
    value: str = ""


def terms(query: str) -> list[Term]:
    """The first MAX_TERMS words, in lower case without quotes, commas and dots around them, by what they can mean."""
    words = [w for w in (x.strip(",.\"'").lower() for x in query.split()) if w]
    return [_term(w) for w in words[:MAX_TERMS]]


def _term(w: str) -> Term:
    if re.fullmatch(r"[0-9]{4}", w) and int(w) in YEARS:
        return Term("year", w, w)
    if re.fullmatch(r"[0-9]{1,2}", w) and 1 <= int(w) <= 31:
        return Term("day", w, f"{int(w):02}")
    if re.fullmatch(r"[0-9-]{4}-[0-9-]{2,}", w):
        return Term("date", w, w)
    if len(w) >= 3:
        month = next((i for i, m in enumerate(MONTHS, 1) if m.startswith(w)), 0)
        if month:
            return Term("month", w, f"{month:02}")
    return Term("text", w)


PARTS = {"year": (1, 4), "month": (6, 2), "day": (9, 2)}
FIELDS = ("below", "camera_make", "camera_model", "lens", "title", "caption")


def below_library(path: Column, root: Column) -> Column:
    """A file's path from its library folder's own name down."""
    return F.substr(path, F.length(F.regexp_replace(root, r"[^/\\]+$", "")) + 1)


#: Parts the fields of a photo where they are searched as one text; no word holds it.
BETWEEN = "\x00"
#: Up to so many keyword names that match are asked for by name; more are told by the words again.
MOST_NAMES = 1000


def folded(c: Column) -> Column:
    """Lower case for A-Z alone, by the fast way where a text is ASCII."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(ascii_lower(c))


def matching(rows: DataFrame, found: list[Term], links: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """The rows (id, captured_at and FIELDS) that match every term; links holds photo_id and keyword name.

    A row's fields are folded once, as one text. names, the keyword names (name), are searched before any link is read: without a match no link is,
    else each photo gets the set of words that its keywords hold.
    """
    asked = sorted({t.word for t in found if t.kind != "date"})
    by_keyword: list[str] = []
    if asked:
        lowered = folded(F.col("name"))
        some = F.lit(False)
        for w in asked:
            some = some | lowered.contains(w)
        hits = None if names is None else [r.name for r in names.filter(some).select("name").distinct().limit(MOST_NAMES + 1).collect()]
        if hits is None or len(hits) > MOST_NAMES:
            by_keyword, links = asked, links.filter(some)
        elif hits:
            by_keyword, links = [w for w in asked if any(w in _lower(n) for n in hits)], links.filter(F.col("name").isin(hits))
        if by_keyword:
            words = [F.max(lowered.contains(w)).alias(f"k{asked.index(w)}") for w in by_keyword]
            rows = rows.join(links.groupBy(F.col("photo_id").alias("id")).agg(*words), "id", "left")
    rows = rows.withColumn("_text", folded(F.concat_ws(BETWEEN, *FIELDS)))
    where = F.lit(True)
    for t in found:
        if t.kind == "date":
            where = where & F.col("captured_at").startswith(t.value)
            continue
        hit = F.col("_text").contains(t.word)
        if t.word in by_keyword:
            hit = hit | F.coalesce(F.col(f"k{asked.index(t.word)}"), F.lit(False))
        if t.kind in PARTS:
            hit = hit | F.coalesce(F.substring("captured_at", *PARTS[t.kind]) == t.value, F.lit(False))
        where = where & hit
    return rows.filter(where).drop("_text", *(f"k{asked.index(w)}" for w in by_keyword))


def _lower(name: str) -> str:
    return name.translate({c: c + 32 for c in range(65, 91)})
