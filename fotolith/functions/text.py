"""Text as the catalogue keeps and compares it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The longest values kept, in characters.
MAX_CHARS = {"title": 200, "creator": 200, "copyright": 200, "caption": 2000}
KEYWORD_CHARS, ALBUM_CHARS, SMART_CHARS = 100, 60, 200


def ascii_lower(c: Column) -> Column:
    """Lower case for A-Z alone, as case is ignored when names and words are compared."""
    return F.translate(c, UPPER, LOWER)


def squash(c: Column) -> Column:
    """On one line: runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+", " "))


def _cut(c: Column, chars: int) -> Column:
    cut = F.regexp_replace(F.substring(c, 1, chars), r"\s+$", "")
    return F.when(cut != "", cut)


def tidy(c: Column, field: str) -> Column:
    """A text field as it is kept: squashed and cut; null if nothing is left. Captions keep lines, with one empty line in a row at most."""
    if field != "caption":
        return _cut(squash(c), MAX_CHARS[field])
    lines = F.transform(F.split(F.regexp_replace(c, r"\r\n", "\n"), "\n"), squash)
    joined = F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")
    return _cut(F.regexp_replace(joined, r"^\s+|\s+$", ""), MAX_CHARS["caption"])


def name_of(c: Column, chars: int) -> Column:
    """A name of a keyword or album: squashed, control characters too; null if empty or too long."""
    tidied = F.trim(F.regexp_replace(c, r"[\s\p{Cc}]+", " "))
    return F.when((tidied != "") & (F.length(tidied) <= chars), tidied)


def camera_name(make: Column, model: Column) -> Column:
    """Make and model as one name; the make isn't said twice."""
    make, model = (F.when(F.trim(c) != "", F.trim(c)) for c in (make, model))
    return F.when(make.isNull(), model).when(model.isNull(), make).when(F.lower(model).startswith(F.lower(make)), model).otherwise(F.concat_ws(" ", make, model))


def natural_key(c: Column) -> Column:
    """A sort key in which runs of digits compare by value, then by length, and letters without case: DSC_2 before DSC_10.

    The key is the row of the text's runs, digits as (length without zeros, digits, length), so that arrays compare as the texts should.
    """
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D)"), F.lit(1))
    value = lambda r: F.regexp_replace(r, "^0+", "")
    digits = lambda r: F.concat(F.lit("0"), F.lpad(F.length(value(r)).cast("string"), 6, "0"), value(r), F.lpad(F.length(r).cast("string"), 6, "0"))
    return F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), digits(r)).otherwise(r))


def keywords_in(c: Column) -> Column:
    """The names in a typed list, parted by comma, semicolon or line break: tidied, the first spelling of each."""
    names = F.filter(F.transform(F.split(c, "[,;\n]"), lambda x: name_of(x, KEYWORD_CHARS)), lambda x: x.isNotNull())
    seen = F.transform(names, lambda x: ascii_lower(x))
    return F.filter(names, lambda x, i: F.array_position(seen, ascii_lower(x)) == i + 1)


def bytes_shown(n: Column) -> Column:
    """A size in decimal units, with one decimal below 10: 950 B, 1.5 kB, 24 MB."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((1, "kB"), (2, "MB"), (3, "GB"), (4, "TB")):
        x = n / F.lit(float(1000**power))
        shown = F.when(x < 10, F.format_string("%.1f", F.round(x, 1))).otherwise(F.format_string("%.0f", F.round(x, 0)))
        out = F.when(n >= 1000**power, F.concat(shown, F.lit(f" {unit}"))).otherwise(out)
    return out


def shutter_shown(seconds: Column) -> Column:
    """An exposure time: 1/250 s below half a second, else seconds with one decimal at most."""
    below = F.concat(F.lit("1/"), F.round(1.0 / seconds, 0).cast("long").cast("string"), F.lit(" s"))
    above = F.concat(F.regexp_replace(F.format_string("%.1f", seconds), r"\.0$", ""), F.lit(" s"))
    return F.when(seconds > 0, F.when(seconds < 0.5, below).otherwise(above))


def scene_ev(iso: Column, aperture: Column, shutter: Column) -> Column:
    """The exposure value of the scene at ISO 100; null unless all are positive."""
    return F.when((iso > 0) & (aperture > 0) & (shutter > 0), F.log2(aperture * aperture / shutter) - F.log2(iso / F.lit(100.0)))
