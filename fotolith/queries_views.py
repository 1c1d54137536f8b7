"""Queries over what is shown and exported: views, display strings, EXIF fields, targets, pace and output sharpening."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import oracle as O
from .adapters import Library
from .functions import display as X
from .functions import exif as E
from .operators import views
from .operators.catalogue import Catalogue
from .operators.order import running
from .plans import detail as D
from .plans import geometry as G
from .plans import statistics as S
from .registry import query

_ENTRIES = "FROM photos p JOIN files f ON f.photo_id = p.id WHERE NOT f.missing"


@query("view_visible", O.with_tables(O.PHOTOS, O.FILES, body=f"SELECT p.id, f.path {_ENTRIES} AND rating >= 3 AND rating = 5 AND label = 5"))
def view_visible(s, d):
    return views.visible(Catalogue(Library(s, d)).present(), "rated3", "favourites", 5).select("id", "path")


@query("view_filter_picks", O.with_tables(O.PHOTOS, O.FILES, body=f"SELECT p.id, f.path {_ENTRIES} AND flag = 1"))
def view_filter_picks(s, d):
    return views.visible(Catalogue(Library(s, d)).present(), "picks", "recent").select("id", "path")


_TEN = "p.id, f.path {} LIMIT 50"
_NAME = "CAST(regexp_extract(f.path, '(\\d+)\\.NEF$', 1) AS INT)"
for _sort, _by in (("captured", f"captured_at NULLS LAST, {_NAME}, f.path"), ("newest", f"captured_at DESC NULLS LAST, {_NAME}, f.path"), ("name", f"{_NAME}, f.path"), ("rating", f"rating DESC, captured_at NULLS LAST, {_NAME}, f.path")):
    query(f"view_sort_{_sort}", O.with_tables(O.PHOTOS, O.FILES, body=f"SELECT p.id, f.path {_ENTRIES} ORDER BY {_by} LIMIT 50"))(
        lambda s, d, k=_sort: Catalogue(Library(s, d)).present().orderBy(*views.order(k, F.substring_index("path", "/", -1))).limit(50).select("id", "path"))


_PLACED = f"t AS (SELECT f.path, row_number() OVER (ORDER BY f.path) AS place {_ENTRIES})"


@query("view_range", O.with_tables(O.PHOTOS, O.FILES, _PLACED, body="SELECT path, place FROM t WHERE place BETWEEN 5 AND 40"))
def view_range(s, d):
    rows = Catalogue(Library(s, d)).present().select("path")
    placed = running(rows, "place", F.array("path"), [F.col("path")], F.lit(1).cast("long"))
    ends = [r.path for r in rows.orderBy("path").limit(40).collect()]
    return views.ticked(placed, ends[39], ends[4]).select("path", "place")


_N = "(CASE o_orderkey % 5 WHEN 0 THEN o_orderkey % 1000 WHEN 1 THEN 1000 + o_orderkey * 7 % 98000 WHEN 2 THEN 1000000 + o_orderkey * 7919 % 900000000 WHEN 3 THEN 9940000 + o_orderkey * 13 % 20000 ELSE 1000000000000 + o_orderkey * 1000000000 END)::BIGINT"
_UNIT = " ".join(f"WHEN n >= {1000**p}::BIGINT THEN CASE WHEN n < {10 * 1000**p}::BIGINT THEN printf('%.1f', round(n / {1000.0**p}::DOUBLE, 1)) ELSE floor(n / {1000.0**p}::DOUBLE + 0.5)::BIGINT::VARCHAR END || ' {u}'" for p, u in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")))


@query("file_sizes_shown", f"SELECT id, CASE {_UNIT} ELSE n || ' B' END AS shown FROM (SELECT o_orderkey AS id, {_N} AS n FROM orders)")
def file_sizes_shown(s, d):
    n = F.expr("cast(CASE o_orderkey % 5 WHEN 0 THEN o_orderkey % 1000 WHEN 1 THEN 1000 + o_orderkey * 7 % 98000 WHEN 2 THEN 1000000 + o_orderkey * 7919 % 900000000 WHEN 3 THEN 9940000 + o_orderkey * 13 % 20000 ELSE 1000000000000 + o_orderkey * 1000000000 END AS bigint)")
    return Library(s, d)._read("orders").select(F.col("o_orderkey").alias("id"), X.file_size(n).alias("shown"))


@query("exposures_shown", O.with_tables(O.PHOTOS, body="SELECT id, concat_ws(' · ', 'ISO ' || iso, CASE WHEN id % 7 > 0 THEN focal_length::INT || ' mm' END, 'f/' || printf('%.1f', aperture), CASE id % 4 WHEN 0 THEN '1/' || (50 + id % 10) || ' s' WHEN 1 THEN '0.4 s' WHEN 2 THEN '2 s' ELSE '2.5 s' END) AS shown, repeat('★', rating::INT) AS stars FROM photos"))
def exposures_shown(s, d):
    seconds = F.when(F.col("id") % 4 == 0, F.col("shutter")).when(F.col("id") % 4 == 1, 0.4).when(F.col("id") % 4 == 2, 2.0).otherwise(2.5)
    photos = Library(s, d).photos()
    return photos.select("id", X.exposure(F.col("iso"), F.when(F.col("id") % 7 > 0, F.col("focal_length")), F.col("aperture"), seconds).alias("shown"), X.stars(F.col("rating")).alias("stars"))


@query("exif_entries", O.with_tables(O.PHOTOS, body="""SELECT id, camera_make AS make, camera_model AS model, 1 AS exposure_n, 50 + id % 10 AS exposure_d, 14 + 10 * (id % 5) AS f_tenths, iso::INT AS iso, replace(substr(captured_at, 1, 10), '-', ':') || ' ' || substr(captured_at, 12, 8) AS taken,
CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL AND longitude <= 180 THEN 'N ' || latitude::INT || ' 30 0' END AS lat, id % 2 = 0 AS srgb FROM photos"""))
def exif_entries(s, d):
    photos = Library(s, d).photos().withColumn("latitude", F.col("latitude") + 0.5)
    e = E.entries(F.lit(6000), F.lit(4000), F.col("id") % 2 == 0, F.lit(True))
    held = photos.select("id", e.alias("e"))
    lat = F.concat_ws(" ", "e.gps.lat_ref", *(F.col("e.gps.lat")[i]["n"].cast("string") for i in range(3)))
    return held.select("id", "e.main.make", "e.main.model", F.col("e.exif.exposure_time.n").alias("exposure_n"), F.col("e.exif.exposure_time.d").alias("exposure_d"), F.col("e.exif.f_number.n").alias("f_tenths"), "e.exif.iso", "e.exif.taken", F.when(F.col("e.gps").isNotNull(), lat).alias("lat"), (F.col("e.exif.colour_space") == 1).alias("srgb"))


@query("export_targets", O.with_tables(O.FILES, body="SELECT id, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'extension' WHEN 2 THEN NULL ELSE 'source' END AS refused FROM files"))
def export_targets(s, d):
    rows = Library(s, d).files().selectExpr("id", "concat(path, '.tif') AS source", "CASE id % 4 WHEN 0 THEN concat(path, '.JPG') WHEN 1 THEN concat(path, '.png') WHEN 2 THEN concat(path, '.TIFF') ELSE concat(replace(path, '/lib/', '//lib/./'), '.tif') END AS target", "CASE id % 4 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'jpeg' ELSE 'tiff' END AS format")
    return rows.select("id", E.refused(F.col("target"), F.col("source"), F.col("format")).alias("refused"))


@query("drag_pace", "SELECT user_id AS viewer, round(list_reduce(list(value / (1 + event_id % 3) ORDER BY event_id), lambda m, c: m + 0.5 * (c - m)), 6) AS cost FROM events GROUP BY user_id")
def drag_pace(s, d):
    renders = Library(s, d)._read("events").selectExpr("user_id AS viewer", "event_id AS nth", "value AS ms", "1.0D + event_id % 3 AS megapixels")
    return S.pace(renders, 0.5).select("viewer", F.round("cost", 6).alias("cost"))


@query("drag_steps", "SELECT user_id AS viewer, CASE WHEN c * 1.5 > 14 THEN 1 ELSE 0 END AS steps FROM (SELECT user_id, list_reduce(list(value / (1 + event_id % 3) ORDER BY event_id), lambda m, c: m + 0.5 * (c - m)) AS c FROM events GROUP BY user_id)")
def drag_steps(s, d):
    renders = Library(s, d)._read("events").selectExpr("user_id AS viewer", "event_id AS nth", "value AS ms", "1.0D + event_id % 3 AS megapixels")
    return S.pace(renders, 0.5).select("viewer", S.steps_down(F.col("cost"), F.lit(0), F.lit(1.5), F.lit(0.4), 14.0, 0.8).alias("steps"))


_E8 = "CAST(floor((CASE WHEN {v} <= 0.0031308 THEN {v} * 12.92 ELSE 1.055 * pow({v}, 1 / 2.4::DOUBLE) - 0.055 END) * 255 + 0.5) AS INT)"
_G = "e AS (SELECT image_id, y, x, " + ", ".join(_E8.format(v=f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {c}))") + f" / 255.0::DOUBLE AS {c}" for c in "rgb") + " FROM pixels), el AS (SELECT *, 0.2126 * r + 0.7152 * g + 0.0722 * b AS l FROM e)"
_KW = [f"exp(-{k * k}::DOUBLE / (2 * 0.36))" for k in (-2, -1, 0, 1, 2)]
_KS = f"({' + '.join(_KW)})"


def _line(src: str, col: str, axis: str, line: str) -> str:
    w = f"OVER (PARTITION BY image_id, {line} ORDER BY {axis})"
    at = {-2: f"coalesce(lag({col}, 2) {w}, first_value({col}) {w})", -1: f"coalesce(lag({col}, 1) {w}, {col})", 0: col, 1: f"coalesce(lead({col}, 1) {w}, {col})"}
    last = f"last_value({col}) OVER (PARTITION BY image_id, {line} ORDER BY {axis} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    at[2] = f"coalesce(lead({col}, 2) {w}, {last})"
    return "(" + " + ".join(f"{k} * {at[i]}" for k, i in zip(_KW, (-2, -1, 0, 1, 2))) + f") / {_KS}"


_SH = f"s1 AS (SELECT *, {_line('el', 'l', 'x', 'y')} AS a FROM el), s2 AS (SELECT *, l - {_line('s1', 'a', 'y', 'x')} AS d FROM s1), s3 AS (SELECT *, d * pow(greatest(0, least(1, (abs(d) - 0.01) / 0.01)), 2) * (3 - 2 * greatest(0, least(1, (abs(d) - 0.01) / 0.01))) * 0.45 AS k FROM s2)"


@query("px_output_sharpen", O.with_tables(O.PIXELS, _G, _SH, body="SELECT image_id, y, x, " + ", ".join(f"round(greatest(0, least(1, {c} + k)), 5) AS {c}" for c in "rgb") + " FROM s3"))
def px_output_sharpen(s, d):
    from .plans import pixels as P

    eight = Library(s, d).pixels().select("image_id", "y", "x", *((P.quantised(F.col(c)) / 255.0).alias(c) for c in "rgb"))
    return D.output_sharpened(eight, "screen").select("image_id", "y", "x", *(F.round(c, 5).alias(c) for c in "rgb"))


@query("turns_composed", "SELECT a AS first, b AS second, CASE WHEN fb = 1 THEN ((b % 4 - a % 4) % 4 + 4) % 4 ELSE (a % 4 + b % 4) % 4 END AS rotation, fa <> fb AS flip FROM (SELECT t.a, u.b, (t.a >= 4)::INT AS fa, (u.b >= 4)::INT AS fb FROM range(0, 8) t(a), range(0, 8) u(b))")
def turns_composed(s, d):
    """Every turn (0 to 3, mirrored from 4 on) after every other one, as one turn."""
    rows = [(a, b, *G.after((b % 4, b >= 4), (a % 4, a >= 4))) for a in range(8) for b in range(8)]
    return s.createDataFrame(rows, "first long, second long, rotation long, flip boolean")
