"""What is shown of a photo's details: sizes, shutter, aperture, focal length, exposure, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fixed(c: Column, digits: int) -> Column:
    """A number with so many decimals, halves rounded up."""
    return F.format_string(f"%.{digits}f", F.round(c, digits))


def _short(c: Column) -> Column:
    """A whole number as such, others with one decimal."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(_fixed(c, 1))


def file_size(n: Column) -> Column:
    """A size in decimal units: 950 B, 1.5 KB, 24 MB; one decimal below 10."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        x = n / F.lit(float(1000**power))
        out = F.when(n >= 1000**power, F.concat(F.when(x < 10, _fixed(x, 1)).otherwise(F.floor(x + 0.5).cast("string")), F.lit(f" {unit}"))).otherwise(out)
    return out


def shutter(seconds: Column) -> Column:
    """1/250 s where that is within a twentieth of the time, else seconds; null for none."""
    below = F.floor(1.0 / seconds + 0.5)
    near = F.abs(1.0 / below - seconds) / seconds < 0.05
    return F.when(seconds >= 1, F.concat(_short(seconds), F.lit(" s"))).when(seconds > 0, F.when(near, F.concat(F.lit("1/"), below.cast("string"), F.lit(" s"))).otherwise(F.concat(_fixed(seconds, 1), F.lit(" s"))))


def aperture(f: Column) -> Column:
    return F.when(f > 0, F.concat(F.lit("f/"), _short(f)))


def focal(mm: Column) -> Column:
    return F.when(mm > 0, F.concat(F.floor(mm + 0.5).cast("string"), F.lit(" mm")))


def exposure(iso: Column, mm: Column, f: Column, seconds: Column) -> Column:
    """ISO, focal length, aperture and shutter, as far as they are known."""
    return F.concat_ws(" · ", F.when(iso > 0, F.concat(F.lit("ISO "), F.floor(iso + 0.5).cast("string"))), focal(mm), aperture(f), shutter(seconds))


def stars(rating: Column) -> Column:
    return F.repeat(F.lit("★"), F.greatest(F.lit(0), F.least(F.lit(5), rating)).cast("int"))
