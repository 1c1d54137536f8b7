"""Queries over changes to a library: sidecars, edits, keyword links, albums, presets, folders, and lookups of single photos."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import oracle as O
from .adapters import NOW_MS, Library
from .operators import changes, presets
from .operators.catalogue import DETAILS, NUMBERS, Catalogue
from .plans import recipe as R
from .registry import query
from .sources import sidecars

# Lookups.

_AT = "'/lib/Photos/1995/'"
_IN = "f.dir LIKE '/lib/Photos/1995/%'"


@query("photo_at", O.with_tables(O.FILES, body="SELECT photo_id AS id, missing FROM files WHERE path = (SELECT min(path) FROM files)"))
def photo_at(s, d):
    lib = Library(s, d)
    return Catalogue(lib).photo_at(lib.files().agg(F.min("path")).first()[0])


@query("marks_of", O.with_tables(O.PHOTOS, body="SELECT id, rating, flag, label FROM photos WHERE id % 5 = 0"))
def marks_of(s, d):
    lib = Library(s, d)
    return Catalogue(lib).marks(lib.photos().filter("id % 5 = 0"))


def _some_dir(lib: Library) -> str:
    """The folder with most files, the least of those."""
    return lib.files().groupBy("dir").count().orderBy(F.col("count").desc(), "dir").first()["dir"]


_DIR = "(SELECT dir FROM files GROUP BY dir ORDER BY count(*) DESC, dir LIMIT 1)"


@query("marks_in_dir", O.with_tables(O.PHOTOS, O.FILES, body=f"SELECT f.path, rating, flag, label FROM files f JOIN photos p ON p.id = f.photo_id WHERE f.dir = {_DIR} AND (rating > 0 OR flag <> 0 OR label <> 0)"))
def marks_in_dir(s, d):
    lib = Library(s, d)
    return Catalogue(lib).marks_in(_some_dir(lib))


_SHOWN = ", ".join(f"{c}{'::DOUBLE' if c in NUMBERS else ''} AS {c}" for c in DETAILS) + ", CASE WHEN longitude IS NOT NULL THEN latitude END AS latitude, CASE WHEN latitude IS NOT NULL THEN longitude END AS longitude"


@query("details_of", O.with_tables(O.PHOTOS, body=f"SELECT id, {_SHOWN} FROM photos WHERE metadata_version > 0 AND id % 6 = 0"))
def details_of(s, d):
    lib = Library(s, d)
    return Catalogue(lib).details(lib.photos().filter("id % 6 = 0"))


@query("details_in_dir", O.with_tables(O.PHOTOS, O.FILES, body=f"SELECT f.path, {_SHOWN} FROM files f JOIN photos p ON p.id = f.photo_id WHERE f.dir = {_DIR} AND metadata_version > 0"))
def details_in_dir(s, d):
    lib = Library(s, d)
    return Catalogue(lib).details_in(_some_dir(lib))


@query("edits_of", O.with_tables(O.EDITS, body="SELECT photo_id, updated_at_ms, value, event_type FROM edits WHERE photo_id % 5 = 0"))
def edits_of(s, d):
    lib = Library(s, d)
    return Catalogue(lib).edits_of(lib.photos().filter("id % 5 = 0")).select("photo_id", "updated_at_ms", "value", "event_type")


@query("edits_in", O.with_tables(O.FILES, O.EDITS, body="SELECT f.path, updated_at_ms, value, event_type FROM files f JOIN edits e ON e.photo_id = f.photo_id WHERE NOT f.missing AND starts_with(f.dir, '/lib/Archive/')"))
def edits_in(s, d):
    return Catalogue(Library(s, d)).edits_in("/lib/Archive", True).select("path", "updated_at_ms", "value", "event_type")


@query("photo_text", O.with_tables(O.PHOTOS, body="SELECT id, title, caption FROM photos WHERE id % 5 = 0 UNION ALL SELECT -1, NULL, NULL"))
def photo_text(s, d):
    lib = Library(s, d)
    return Catalogue(lib).texts(lib.photos().filter("id % 5 = 0").select("id").union(s.createDataFrame([(-1,)], "id long")))


@query("details_queue_archive", O.with_tables(O.PHOTOS, O.FILES, body="SELECT p.id, f.path FROM photos p JOIN files f ON f.photo_id = p.id WHERE NOT f.missing AND metadata_version < 1 AND starts_with(f.dir, '/lib/Archive/') ORDER BY p.id LIMIT 100"))
def details_queue_archive(s, d):
    return Catalogue(Library(s, d)).details_queue("/lib/Archive", 100)


# Changes.


@query("set_details", O.with_tables(O.PHOTOS, body="SELECT id, 1 AS metadata_version, CASE WHEN metadata_version > 0 THEN camera_model WHEN id % 20 = 0 THEN 'Read' END AS camera_model, CASE WHEN metadata_version > 0 THEN iso WHEN id % 20 = 0 THEN 400 END AS iso FROM photos"))
def set_details(s, d):
    photos = Library(s, d).photos()
    read = photos.filter("metadata_version < 1").selectExpr("id", *(f"cast(NULL AS {dict(photos.dtypes)[c]}) AS {c}" for c in DETAILS if c not in ("camera_model", "iso")), "IF(id % 20 = 0, 'Read', NULL) AS camera_model", "IF(id % 20 = 0, 400L, NULL) AS iso")
    return changes.set_details(photos, read, DETAILS).select("id", "metadata_version", "camera_model", "iso")


@query("add_folder", "SELECT 1 AS id, '/lib/Photos' AS path UNION ALL SELECT 2, '/lib/Archive' UNION ALL SELECT 3, '/lib/New'")
def add_folder(s, d):
    folders = changes.add_folder(Library(s, d).folders(), "/lib/New", NOW_MS)
    return changes.add_folder(folders, "/lib/Archive", NOW_MS).select("id", "path")


@query("remove_folder", O.with_tables(O.PHOTOS, O.FILES, body="SELECT id FROM photos WHERE id IN (SELECT photo_id FROM files WHERE folder_id <> 2)"))
def remove_folder(s, d):
    lib = Library(s, d)
    return changes.remove_folder(lib.folders(), lib.files(), lib.photos(), 2)[2].select("id")


@query("finish_scan_subtree", O.with_tables(O.FILES, body="SELECT id, missing OR (folder_id = 1 AND id % 3 <> 0 AND starts_with(dir, '/lib/Photos/1995/')) AS missing FROM files"))
def finish_scan_subtree(s, d):
    files = Library(s, d).files().withColumn("last_seen_scan", F.expr("IF(id % 3 = 0, 2L, 1L)"))
    return changes.finish_scan(files, 1, 2, "/lib/Photos/1995/").select("id", "missing")


_TYPED = "(SELECT o_orderkey AS photo_id, CASE o_orderkey % 3 WHEN 0 THEN ' New  name ' WHEN 1 THEN upper((SELECT min(p_name) FROM part)) ELSE 'new NAME' END AS name FROM orders WHERE o_orderkey % 7 = 0)"


def _typed(lib: Library):
    least = lib._read("part").agg(F.min("p_name").alias("least"))
    named = "CASE o_orderkey % 3 WHEN 0 THEN ' New  name ' WHEN 1 THEN upper(least) ELSE 'new NAME' END AS name"
    return lib._read("orders").filter("o_orderkey % 7 = 0").join(F.broadcast(least)).selectExpr("o_orderkey AS photo_id", named)  # least: one row


@query("link_keywords", O.with_tables(O.KEYWORDS, body=f"SELECT photo_id, name FROM photo_keywords UNION SELECT photo_id, CASE photo_id % 3 WHEN 1 THEN (SELECT min(p_name) FROM part) ELSE 'New name' END FROM {_TYPED}"))
def link_keywords(s, d):
    lib = Library(s, d)
    return changes.link_keywords(lib.keywords().select("name"), lib.photo_keywords(), _typed(lib))


@query("unlink_keywords", O.with_tables(O.KEYWORDS, body=f"SELECT photo_id, name FROM photo_keywords WHERE (photo_id, lower(name)) NOT IN (SELECT photo_id, lower(name) FROM {_TYPED})"))
def unlink_keywords(s, d):
    lib = Library(s, d)
    return changes.unlink_keywords(lib.photo_keywords(), _typed(lib))


@query("used_keywords", O.with_tables(O.KEYWORDS, body="SELECT name FROM keywords WHERE name IN (SELECT name FROM photo_keywords WHERE photo_id % 50 = 1)"))
def used_keywords(s, d):
    lib = Library(s, d)
    return changes.used_keywords(lib.keywords().select("name"), lib.photo_keywords().filter("photo_id % 50 = 1"))


@query("import_keywords", O.with_tables(O.KEYWORDS, body="SELECT photo_id, name FROM photo_keywords WHERE photo_id % 2 = 0 UNION SELECT o_orderkey, 'Found' FROM orders WHERE o_orderkey NOT IN (SELECT photo_id FROM photo_keywords WHERE photo_id % 2 = 0)"))
def import_keywords(s, d):
    lib = Library(s, d)
    found = lib.photos().select(F.col("id").alias("photo_id"), F.lit(" Found").alias("name"))
    return changes.import_keywords(lib.keywords().select("name"), lib.photo_keywords().filter("photo_id % 2 = 0"), found)


def _named(lib: Library):
    """Albums with times, as a table of named things."""
    return lib.albums().selectExpr("id", "name", "0L AS created_at_ms", "0L AS updated_at_ms")


@query("albums_changed", O.with_tables(O.ALBUMS, body=f"""SELECT id, CASE WHEN id % 4 = 1 THEN 'Renamed ' || id ELSE name END AS name, CASE WHEN id % 4 = 1 THEN {NOW_MS} ELSE 0 END AS updated_at_ms FROM albums WHERE id % 4 <> 2
UNION ALL SELECT (SELECT max(id) FROM albums) + 1, 'New one', {NOW_MS} UNION ALL SELECT (SELECT max(id) FROM albums) + 3, 'New three', {NOW_MS}"""))
def albums_changed(s, d):
    albums = _named(Library(s, d))
    made = changes.create(albums, s.createDataFrame([(1, " New  one"), (2, "  "), (3, "New three")], "nth long, name string"), NOW_MS)
    renamed = changes.update(made, albums.filter("id % 4 = 1").selectExpr("id", "concat('Renamed ', id) AS name"), NOW_MS)
    return changes.delete(renamed, albums.filter("id % 4 = 2")).select("id", "name", "updated_at_ms")


@query("album_links_after_delete", O.with_tables(O.ALBUMS, body="SELECT album_id, photo_id FROM album_photos WHERE album_id % 4 <> 2"))
def album_links_after_delete(s, d):
    lib = Library(s, d)
    albums = lib.albums()
    return changes.remove_orphans(lib.album_photos(), changes.delete(albums, albums.filter("id % 4 = 2")), "album_id")


@query("add_to_album_count", O.with_tables(O.ALBUMS, body="SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey NOT IN (SELECT photo_id FROM album_photos WHERE album_id = 1)) AS added, 0 AS unknown"))
def add_to_album_count(s, d):
    lib = Library(s, d)
    owners = lib.albums().select(F.col("id").alias("album_id"))
    new = lambda a: lib.photos().filter("id % 5 = 0").selectExpr(f"{a}L AS album_id", "id AS photo_id")
    n = [changes.fresh_links(lib.album_photos(), new(a), owners).agg(F.count("*").alias(name)) for a, name in ((1, "added"), (-7, "unknown"))]
    return n[0].join(F.broadcast(n[1]))  # one row each


def _edits(lib: Library):
    """Saved edits of several versions, and new ones, of photos by event."""
    last = lib.edits().selectExpr("photo_id", "cast(30 + photo_id % 6 AS int) AS recipe_version", "concat('{\"version\":', 30 + photo_id % 6, '}') AS recipe", "updated_at_ms")
    new = lib.photos().filter("id % 2 = 0").selectExpr("id AS photo_id", "concat('{\"version\":33,\"exposure\":', IF(id % 3 = 0, 0, 1), '}') AS recipe")
    parsed = R.parsed(F.col("recipe"))
    return last, new.withColumn("plain", R.is_identity(parsed))


_SAVED = "CASE WHEN o.photo_id IS NOT NULL AND 30 + o.photo_id % 6 > 33 THEN 'old' WHEN n.id IS NULL THEN 'old' WHEN n.id % 3 = 0 THEN 'gone' ELSE 'new' END"


@query("save_edits", O.with_tables(O.EDITS, body=f"""SELECT photo_id, recipe_version, recipe, updated_at_ms FROM (SELECT coalesce(o.photo_id, n.id) AS photo_id, {_SAVED} AS how, CASE WHEN {_SAVED} = 'new' THEN 33 ELSE 30 + o.photo_id % 6 END AS recipe_version,
CASE WHEN {_SAVED} = 'new' THEN '{{"version":33,"exposure":1}}' ELSE '{{"version":' || (30 + o.photo_id % 6) || '}}' END AS recipe, CASE WHEN {_SAVED} = 'new' THEN {NOW_MS} ELSE o.updated_at_ms END AS updated_at_ms
FROM edits o FULL JOIN (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 2 = 0) n ON n.id = o.photo_id) WHERE how <> 'gone'"""))
def save_edits(s, d):
    last, new = _edits(Library(s, d))
    return changes.save_edits(last, new, NOW_MS, R.VERSION)


_ZEROS = "".join(f',"{k}":0.0' for k in ("highlights", "shadows", "whites", "blacks", "dehaze", "temperature", "tint", "vibrance", "saturation", "texture", "clarity", "vignette"))
_TEXT = f"""'{{"version":33,"look":"standard","exposure":' || greatest(-5, least(5, e))::DOUBLE || ',"contrast":' || least(100, c)::DOUBLE || '{_ZEROS},"sharpening":40.0,"noiseReduction":0.0,"grain":0.0,"whitesFromSensor":false,"profileCorrections":true,"profileWithoutChromaticAberration":false,"unoriented":false}}'"""
_TAKEN = f"CASE WHEN 30 + o.photo_id % 6 > {R.VERSION} OR n.id IS NULL THEN 'old' WHEN e = 0 AND c = 0 THEN 'gone' ELSE 'new' END"


@query("save_recipes", O.with_tables(O.EDITS, body=f"""SELECT photo_id, recipe_version, recipe, updated_at_ms FROM (SELECT coalesce(o.photo_id, n.id) AS photo_id, {_TAKEN} AS how, CASE WHEN {_TAKEN} = 'new' THEN 33 ELSE 30 + o.photo_id % 6 END AS recipe_version,
CASE WHEN {_TAKEN} = 'new' THEN {_TEXT} ELSE '{{"version":' || (30 + o.photo_id % 6) || '}}' END AS recipe, CASE WHEN {_TAKEN} = 'new' THEN {NOW_MS} ELSE o.updated_at_ms END AS updated_at_ms
FROM edits o FULL JOIN (SELECT o_orderkey AS id, o_orderkey % 15 - 7 AS e, o_orderkey % 7 * 50 AS c FROM orders WHERE o_orderkey % 4 < 2) n ON n.id = o.photo_id) WHERE how <> 'gone'"""))
def save_recipes(s, d):
    """Recipes with values out of range, some that change nothing, some unreadable, and some of a newer version."""
    lib = Library(s, d)
    last, _ = _edits(lib)
    said = "CASE photo_id % 4 WHEN 2 THEN 'no recipe' WHEN 3 THEN '{\"version\":99,\"exposure\":1}' ELSE concat('{\"exposure\":', photo_id % 15 - 7, ',\"contrast\":', photo_id % 7 * 50, ',\"unknown\":1}') END"
    new = lib.photos().selectExpr("id AS photo_id").selectExpr("photo_id", f"{said} AS recipe")
    return changes.save_recipes(last, new, NOW_MS)


@query("save_edits_refused", O.with_tables(O.EDITS, body="SELECT photo_id FROM edits WHERE 30 + photo_id % 6 > 33 AND photo_id % 2 = 0 AND photo_id IN (SELECT o_orderkey FROM orders)"))
def save_edits_refused(s, d):
    last, new = _edits(Library(s, d))
    return changes.refused(last, new, R.VERSION)


# Presets.


@query("preset_list", """SELECT * FROM (VALUES ('natural', 'Natural', 8.0::DOUBLE, 12.0::DOUBLE, 0.0::DOUBLE), ('vivid', 'Vivid', 25.0, 35.0, 10.0), ('warm-film', 'Warm film', -10.0, 0.0, -10.0), ('matte', 'Matte', -25.0, 0.0, -15.0), ('mono', 'Mono', 30.0, 0.0, -100.0), ('cool-fade', 'Cool fade', -15.0, 0.0, 0.0)) t(id, name, contrast, vibrance, saturation)
UNION ALL SELECT s_suppkey::VARCHAR, s_name, (s_suppkey % 100)::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM supplier WHERE s_suppkey % 35 <= 33""")
def preset_list(s, d):
    stored = Library(s, d)._read("supplier").selectExpr("s_suppkey AS id", "s_name AS name", "concat('{\"version\":', IF(s_suppkey % 35 > 33, 34, 33), ',\"contrast\":', s_suppkey % 100, ',\"exposure\":2,\"masks\":[{\"id\":1}]}') AS recipe", "0L AS created_at_ms")
    return presets.listed(stored).selectExpr("id", "name", "recipe.contrast", "recipe.vibrance", "recipe.saturation")


@query("preset_files", """SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN s_name END AS name, CASE s_suppkey % 4 WHEN 0 THEN (s_suppkey % 100)::DOUBLE END AS contrast, CASE s_suppkey % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'newer' ELSE 'no preset' END AS outcome FROM supplier""")
def preset_files(s, d):
    rows = Library(s, d)._read("supplier").selectExpr("s_suppkey AS id", "s_name AS name", "concat('{\"version\":33,\"contrast\":', s_suppkey % 100, ',\"exposure\":2}') AS recipe")
    text = presets.to_file(F.col("name"), R.parsed(F.col("recipe")))
    bad = F.when(F.col("id") % 4 == 1, F.replace(text, F.lit('"formatVersion":1'), F.lit('"formatVersion":2'))).when(F.col("id") % 4 == 2, F.lit("{}")).when(F.col("id") % 4 == 3, F.lit("no JSON"))
    texts = rows.select("id", F.coalesce(bad, text).alias("text"))
    return texts.select("id", presets.from_file(F.col("text")).alias("p")).selectExpr("id", "p.name", "p.recipe.contrast", "p.outcome")


# Sidecars.

_LABEL = "CASE label WHEN 1 THEN 'Red' WHEN 2 THEN 'Yellow' WHEN 3 THEN 'Green' WHEN 4 THEN 'Blue' WHEN 5 THEN 'Purple' END"
_STARS = "CASE WHEN flag = -1 THEN '-1' WHEN rating > 0 THEN rating::VARCHAR END"
_MARKS = f"""coalesce(' xmp:Rating="' || {_STARS} || '"', '') || coalesce(' xmp:Label="' || {_LABEL} || '"', '')"""
_HEAD = """'<?xpacket begin="' || chr(65279) || '" id="W5M0MpCehiHzreSzNTczkc9d"?>' || chr(10) || '<x:xmpmeta xmlns:x="adobe:ns:meta/">' || chr(10) || ' <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">' || chr(10) || '  <rdf:Description rdf:about="" xmlns:xmp="http://ns.adobe.com/xap/1.0/"'"""
_TAIL = """chr(10) || ' </rdf:RDF>' || chr(10) || '</x:xmpmeta>' || chr(10) || '<?xpacket end="w"?>'"""
_WORDS = """' xmlns:dc="http://purl.org/dc/elements/1.1/">' || chr(10) || '   <dc:subject>' || chr(10) || '    <rdf:Bag>' || chr(10) || '     <rdf:li>' || replace(title, ' ', ' &amp; ') || '</rdf:li>' || chr(10) || '    </rdf:Bag>' || chr(10) || '   </dc:subject>' || chr(10) || '  </rdf:Description>'"""
#: A sidecar of another program: a property of one name in two namespaces, marks, and settings of its own.
THEIRS = """<x:xmpmeta xmlns:x="adobe:ns:meta/" x:xmptk="Shelf 7.1">
 <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">
  <rdf:Description rdf:about="uuid:0b7e"
    xmlns:shelf="urn:example:shelf" xmlns:xap="http://ns.adobe.com/xap/1.0/"
   shelf:Rating="low"{marks}
   shelf:Place="row 3, box 9">
   <shelf:Note>lent to a neighbour</shelf:Note>
  </rdf:Description>
 </rdf:RDF>
</x:xmpmeta>
"""


def _marked(lib: Library):
    return lib.photos().select("id", "rating", "flag", "label", F.when(F.col("title").isNotNull(), F.array(F.replace("title", F.lit(" "), F.lit(" & ")))).otherwise(F.array().cast("array<string>")).alias("names"))


@query("sidecar_packet", O.with_tables(O.PHOTOS, body=f"SELECT id, {_HEAD} || {_MARKS} || coalesce({_WORDS}, '/>') || {_TAIL} AS text FROM photos WHERE flag = -1 OR rating > 0 OR label > 0 OR title IS NOT NULL"))
def sidecar_packet(s, d):
    rows = _marked(Library(s, d)).select("id", sidecars.packet(*map(F.col, ("rating", "flag", "label", "names"))).alias("text"))
    return rows.filter("text IS NOT NULL")


def _theirs(lib: Library):
    """Photos with another program's sidecar that says their marks, as attributes or elements."""
    stars, name = F.when(F.col("flag") == -1, F.lit("-1")).otherwise(F.col("rating").cast("string")), F.element_at(F.array(*map(F.lit, ("", "RED", "yellow", "Green", "Blue", "Own"))), (F.col("label") + 1).cast("int"))
    said = F.concat(F.lit('\n   xap:Rating="'), stars, F.lit("\"\n   xap:Label='"), name, F.lit("'"))
    before, after = THEIRS.split("{marks}")
    return lib.photos().select("id", "rating", "flag", "label", F.concat(F.lit(before), said, F.lit(after)).alias("text"))


@query("sidecar_marks", O.with_tables(O.PHOTOS, body="SELECT id, CASE WHEN flag = -1 THEN 0 ELSE rating END AS rating, CASE WHEN flag = -1 THEN -1 ELSE 0 END AS flag, CASE WHEN label = 5 THEN 0 ELSE label END AS label FROM photos"))
def sidecar_marks(s, d):
    return _theirs(Library(s, d)).select("id", sidecars.marks(F.col("text")).alias("m")).select("id", "m.*")


@query("sidecar_keywords", O.with_tables(O.PHOTOS, body="SELECT id, CASE WHEN title IS NULL THEN '' ELSE replace(title, ' ', ' & ') END AS keywords FROM photos WHERE flag = -1 OR rating > 0 OR label > 0 OR title IS NOT NULL"))
def sidecar_keywords(s, d):
    return sidecar_packet(s, d).select("id", F.array_join(sidecars.keywords(F.col("text")), "|").alias("keywords"))


_NEW = """CASE WHEN id % 4 = 0 THEN '' ELSE ' xap:Rating="4" xap:Label="Blue"' END"""
_THEIRS = THEIRS.split("<rdf:Description")


@query("sidecar_update", O.with_tables(O.PHOTOS, body="SELECT id, 'written' AS action, '" + _THEIRS[0] + "<rdf:Description' || " + _NEW + " || '" + _THEIRS[1].replace("{marks}", "") + "' AS new_text FROM photos"))
def sidecar_update(s, d):
    rows = _theirs(Library(s, d)).select("id", "text", F.when(F.col("id") % 4 == 0, 0).otherwise(4).alias("rating"), F.lit(0).alias("flag"), F.when(F.col("id") % 4 == 0, 0).otherwise(4).alias("label"), F.array().cast("array<string>").alias("names"))
    return sidecars.updated(rows).select("id", "action", "new_text")


@query("sidecar_sync", O.with_tables(O.PHOTOS, O.FILES, body=f"SELECT substr(f.path, 1, length(f.path) - 3) || 'xmp' AS path, CASE WHEN p.id % 2 = 1 THEN CASE WHEN {_STARS} IS NULL AND {_LABEL} IS NULL THEN 'unchanged' ELSE 'written' END ELSE CASE WHEN {_STARS} IS NULL AND {_LABEL} IS NULL THEN 'deleted' ELSE 'written' END END AS action FROM photos p JOIN files f ON f.photo_id = p.id"))
def sidecar_sync(s, d):
    """Sidecars of all files: every other photo has one of ours, with a rating of 5 that the photo hasn't, or a label."""
    lib = Library(s, d)
    none = F.array().cast("array<string>")
    photos = lib.photos().select("id", "rating", "flag", "label", none.alias("names")).join(lib.files().select(F.col("photo_id").alias("id"), "path"), "id")
    ours = photos.filter("id % 2 = 0").select("id", sidecars.path_for(F.col("path")).alias("path"), sidecars.packet(F.lit(5), F.lit(0), F.lit(2), none).alias("text"))
    return sidecars.sync(photos, ours, ["nef"], key="id").select("path", "action")
