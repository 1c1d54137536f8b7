"""Queries over presets of other programs, made up from the rows of part."""

from __future__ import annotations

from pyspark.sql import functions as F

from .adapters import Library
from .operators import foreign
from .registry import query

_ROWS = "p AS (SELECT p_partkey AS id, (p_partkey % 13 - 6) / 2.0::DOUBLE AS ev, p_partkey % 250 - 125 AS con, p_partkey % 7 AS kind, p_name AS name FROM part)"
#: kind 0: no settings that have a counterpart; 1: no preset; 2: black and white; 3: with masks and a profile; others: plain.
_SQL = f"""WITH {_ROWS} SELECT id, CASE kind WHEN 0 THEN 'nothing usable' WHEN 1 THEN 'no preset' ELSE 'read' END AS outcome, CASE WHEN kind > 1 THEN name || ' & <' || id || '>' END AS name,
CASE WHEN kind > 1 THEN greatest(-5, least(5, ev)) + 0.0 END::DOUBLE AS exposure, CASE WHEN kind > 1 THEN greatest(-100, least(100, con)) END::DOUBLE AS contrast, CASE WHEN kind = 2 THEN -100 WHEN kind > 1 THEN 0 END::DOUBLE AS saturation,
CASE WHEN kind = 2 THEN 0 WHEN kind > 1 THEN id % 50 END::DOUBLE AS green_hue, CASE WHEN kind > 1 THEN 51 / 255.0::DOUBLE END AS curve_y, CASE WHEN kind > 1 THEN CASE WHEN kind = 3 THEN 'Masks and healing|Profile' ELSE '' END END AS left_out FROM p"""


def _rows(s, d):
    return Library(s, d)._read("part").selectExpr("p_partkey AS id", "(p_partkey % 13 - 6) / 2.0D AS ev", "p_partkey % 250 - 125 AS con", "p_partkey % 7 AS kind", "p_name AS name")


def _shown(found):
    recipe = lambda path: F.get_json_object(path[0], path[1]).cast("double")
    read = F.col("recipe").isNotNull()
    hue = F.when(read, F.coalesce(recipe((F.col("recipe.mixer"), "$.green.hue")), F.lit(0.0)))
    return found.select("id", "outcome", "name", "recipe.exposure", "recipe.contrast", "recipe.saturation", hue.alias("green_hue"), recipe((F.col("recipe.pointCurve"), "$[1][1]")).alias("curve_y"), F.array_join("left_out", "|").alias("left_out"))


@query("preset_xmp", _SQL)
def preset_xmp(s, d):
    head = '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">'
    tail = "</rdf:RDF></x:xmpmeta>"
    part = lambda *p: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in p))
    text = lambda c: F.col(c).cast("string")
    name = part('<crs:Name><rdf:Alt><rdf:li xml:lang="x-default">', F.col("name"), " &amp; &lt;", text("id"), "&gt;</rdf:li></rdf:Alt></crs:Name>")
    curve = "<crs:ToneCurvePV2012><rdf:Seq><rdf:li>0, 0</rdf:li><rdf:li>64, 51</rdf:li><rdf:li>255, 255</rdf:li></rdf:Seq></crs:ToneCurvePV2012>"
    masks = F.when(F.col("kind") == 3, "<crs:RetouchAreas><rdf:Seq><rdf:li><crs:Inner>1</crs:Inner></rdf:li></rdf:Seq></crs:RetouchAreas>").otherwise("")
    extra = F.when(F.col("kind") == 2, ' crs:ConvertToGrayscale="True"').when(F.col("kind") == 3, ' crs:CameraProfile="Plain"').otherwise("")
    full = part(head, '<rdf:Description xmlns:crs="http://ns.adobe.com/camera-raw-settings/1.0/" crs:Exposure2012="', text("ev"), '" crs:HueAdjustmentGreen="', (F.col("id") % 50).cast("string"), '"', extra, "><crs:Contrast2012>", text("con"), "</crs:Contrast2012>", name, curve, masks, "</rdf:Description>", tail)
    bare = part(head, '<rdf:Description xmlns:crs="urn:x" crs:Version="', text("id"), '"/>', tail)
    files = _rows(s, d).select("id", F.when(F.col("kind") == 0, bare).when(F.col("kind") == 1, part(head, tail)).otherwise(full).alias("text"))
    return _shown(foreign.presets(files))


@query("preset_lua", _SQL)
def preset_lua(s, d):
    part = lambda *p: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in p))
    text = lambda c: F.col(c).cast("string")
    extra = F.when(F.col("kind") == 2, "ConvertToGrayscale = true,").when(F.col("kind") == 3, 'CameraProfile = "Plain", RetouchAreas = { },').otherwise("")
    settings = part("Exposure2012 = ", text("ev"), ", Contrast2012 = ", text("con"), "; -- the rest\n HueAdjustmentGreen = ", (F.col("id") % 50).cast("string"), ", ", extra, " ToneCurvePV2012 = { 0, 0, 64, 51, 255, 255, },")
    title = part('title = "$$$/Own/Key=', F.col("name"), " & <", text("id"), '>",')
    full = part("s = {\n id = 'x', ", title, " value = { settings = { ", settings, " }, uuid = \"\\\"q\\\"\" },\n version = 0,\n}\n")
    bare = "s = { title = 'x', value = { settings = { Version = 1 } } }"
    files = _rows(s, d).select("id", F.when(F.col("kind") == 0, bare).when(F.col("kind") == 1, "s = { title = 'x' ").otherwise(full).alias("text"))
    return _shown(foreign.presets(files))
