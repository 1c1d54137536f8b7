"""EXIF fields of an export, as structs; bytes are left to writers of image formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENSIONS = {"jpeg": ("jpg", "jpeg"), "png": ("png",), "tiff": ("tif", "tiff")}


def _rational(a: Column, b: Column) -> Column:
    return F.struct(a.cast("long").alias("n"), b.cast("long").alias("d"))


def tenths(v: Column) -> Column:
    """A positive number as tenths."""
    return F.when((v > 0) & (v < 4e8), _rational(F.floor(v * 10 + 0.5), F.lit(10)))


def exposure_time(s: Column) -> Column:
    """1/250 for times below a second where that is within a hundredth, else ten-thousandths; tenths from a second on."""
    below = F.floor(1.0 / s + 0.5)
    near = F.abs(1.0 / below - s) / s < 0.01
    return F.when((s > 0) & (s < 1), F.when(near, _rational(F.lit(1), below)).otherwise(_rational(F.floor(s * 10_000 + 0.5), F.lit(10_000)))).otherwise(tenths(s))


def degrees(v: Column) -> Column:
    """Degrees, minutes and thousandths of seconds of an angle's amount."""
    v = F.abs(v)
    d, m = F.floor(v), F.floor((v - F.floor(v)) * 60)
    return F.array(_rational(d, F.lit(1)), _rational(m, F.lit(1)), _rational(F.floor(((v - d) * 60 - m) * 60 * 1000 + 0.5), F.lit(1000)))


def date(captured: Column) -> Column:
    """2026-09-24T06:41:12 as 2026:09:24 06:41:12; null if it isn't such a time."""
    return F.when(captured.rlike(r"^\d{4}.\d\d.\d\d.\d\d.\d\d.\d\d"), F.concat_ws(":", F.substring(captured, 1, 4), F.substring(captured, 6, 2), F.concat(F.substring(captured, 9, 2), F.lit(" "), F.substring(captured, 12, 8))))


def _said(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def entries(width: Column, height: Column, srgb: Column, place: Column) -> Column:
    """The fields for a photo (camera_make, camera_model, lens, captured_at, iso, aperture, shutter, focal_length, latitude, longitude, caption).

    place: whether the location may be written. Pixels are upright, so the orientation is 1; a colour space other than sRGB is 65535.
    """
    lat, lon = F.col("latitude"), F.col("longitude")
    known = place & (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    main = F.struct(_said(F.col("camera_make")).alias("make"), _said(F.col("camera_model")).alias("model"), F.lit(1).alias("orientation"), _said(F.col("caption")).alias("description"))
    shot = F.struct(
        F.lit("0232").alias("version"), exposure_time(F.col("shutter")).alias("exposure_time"), tenths(F.col("aperture")).alias("f_number"), F.when(F.col("iso") > 0, F.least(F.col("iso"), F.lit(65535))).cast("int").alias("iso"),
        date(F.col("captured_at")).alias("taken"), tenths(F.col("focal_length")).alias("focal_length"), F.when(srgb, 1).otherwise(65535).alias("colour_space"), width.alias("width"), height.alias("height"), _said(F.col("lens")).alias("lens"),
    )
    gps = F.when(known, F.struct(F.when(lat < 0, "S").otherwise("N").alias("lat_ref"), degrees(lat).alias("lat"), F.when(lon < 0, "W").otherwise("E").alias("lon_ref"), degrees(lon).alias("lon")))
    return F.struct(main.alias("main"), shot.alias("exif"), gps.alias("gps"))


def refused(target: Column, source: Column, format_: Column) -> Column:
    """Why an export may not be written there: 'extension' if it isn't the format's, 'source' if it is the photo itself; null if it may."""
    ext = F.lower(F.regexp_extract(target, r"\.([^./\\]+)$", 1))
    ok = F.lit(False)
    for name, exts in EXTENSIONS.items():
        ok = ok | ((format_ == name) & ext.isin(*exts))
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, r"/(\./)+", "/"), r"/{2,}", "/")
    return F.when(~ok, "extension").when(clean(target) == clean(source), "source")
