"""The library's queries over the test tables, and DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as O
from .adapters import NOW_MS, Library
from .functions import text as X
from .functions.fingerprint import file_fingerprint, fnv1a, source_id
from .operators import changes, index, retention
from .operators.catalogue import DETAILS, NUMBERS, RECENT_MS, Catalogue, Rules
from .operators.order import running
from .operators.search import FIELDS, PARTS, terms
from .plans import pixels as P
from .plans import recipe as R
from .registry import ORACLE, QUERIES, query  # noqa: F401
from .sources import files

CUTOFF = NOW_MS - RECENT_MS

# Catalogue: listings, collections, search, rules.

_ENTRY = ("p.id, f.path, f.size, f.modified_ns, p.rating, p.flag, p.label, e.photo_id IS NOT NULL AS edited, "
          + ", ".join(f"CASE WHEN p.metadata_version > 0 THEN p.{c}{'::DOUBLE' if c in NUMBERS else ''} END AS {c}" for c in DETAILS)
          + ", CASE WHEN p.metadata_version > 0 AND p.longitude IS NOT NULL THEN p.latitude END AS latitude, CASE WHEN p.metadata_version > 0 AND p.latitude IS NOT NULL THEN p.longitude END AS longitude")
_FROM = "FROM photos p JOIN files f ON f.photo_id = p.id LEFT JOIN edits e ON e.photo_id = p.id WHERE NOT f.missing AND "
_BASE = (O.PHOTOS, O.FILES, O.EDITS, O.KEYWORDS)


def _entries_sql(where: str) -> str:
    return O.with_tables(*_BASE, body=f"SELECT {_ENTRY} {_FROM} ({where})")


_KINDS = {"all": "1 = 1", "picks": "p.flag = 1", "rated": "p.rating > 0", "favourites": "p.rating = 5", "rejected": "p.flag = -1", "recent": f"p.created_at_ms >= {CUTOFF}", "edited": f"e.updated_at_ms >= {CUTOFF}"}
for _kind, _where in _KINDS.items():
    query(f"collection_{_kind}", _entries_sql(_where))(lambda s, d, k=_kind: Catalogue(Library(s, d)).collection(k, NOW_MS))


@query("collection_counts", O.with_tables(*_BASE, body="SELECT " + ", ".join(f"count(DISTINCT CASE WHEN {w} THEN p.id END) AS n_{k}" for k, w in _KINDS.items()) + f" {_FROM} 1 = 1"))
def collection_counts(s, d):
    return Catalogue(Library(s, d)).counts(NOW_MS)


_TEXTS = {"below": "substr(f.path, 6)", **{c: f"p.{c}" for c in FIELDS[1:]}}
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words_sql(text: str) -> str:
    out = []
    for t in terms(text):
        if t.kind == "date":
            out.append(f"starts_with(p.captured_at, '{t.value}')")
            continue
        parts = [f"coalesce(contains({_FOLD.format(c)}, '{t.word}'), false)" for c in _TEXTS.values()]
        parts.append(f"p.id IN (SELECT photo_id FROM photo_keywords WHERE contains({_FOLD.format('name')}, '{t.word}'))")
        if t.kind in PARTS:
            parts.append(f"coalesce(substr(p.captured_at, {PARTS[t.kind][0]}, {PARTS[t.kind][1]}) = '{t.value}', false)")
        out.append("(" + " OR ".join(parts) + ")")
    return " AND ".join(out) or "1 = 0"


SEARCHES = {"search_text": "trip 42", "search_flagship": "trip 42 1996", "search_year": "z 6 1995", "search_month_day": "september 12", "search_date_prefix": "1997-03", "search_keyword": "almond", "search_none": "nothing-here", "search_blank": " , "}
for _name, _text in SEARCHES.items():
    query(_name, _entries_sql(_words_sql(_text)))(lambda s, d, t=_text: Catalogue(Library(s, d)).search(t))


query("search_keyword_hit", _entries_sql(_words_sql("blue widget")))(lambda s, d: Catalogue(Library(s, d)).search("blue widget"))
# The words of this one are told by hand: text, a day of the month, and a year.
_HAND = "(SELECT id FROM hay WHERE contains(hay, 'z') AND (contains(hay, '6') OR substr(captured_at, 9, 2) = '06') AND (contains(hay, '1995') OR substr(captured_at, 1, 4) = '1995'))"
_HAY = "hay AS (SELECT p.id, p.captured_at, lower(concat_ws('|', substr(f.path, 6), camera_make, camera_model, lens, title, caption, (SELECT string_agg(name, '|') FROM photo_keywords k WHERE k.photo_id = p.id))) AS hay FROM photos p JOIN files f ON f.photo_id = p.id)"
query("search_by_hand", O.with_tables(*_BASE, _HAY, body=f"SELECT {_ENTRY} {_FROM} p.id IN {_HAND}"))(lambda s, d: Catalogue(Library(s, d)).search("Z, 6 1995."))


RULES = {
    "smart_rating": (Rules(rating=4), "p.rating >= 4"),
    "smart_unrated": (Rules(rating=0), "p.rating = 0"),
    "smart_flag_label": (Rules(flag=1, label=1), "p.flag = 1 AND p.label = 1"),
    "smart_not_rejected": (Rules(flag=2, rating=3), "p.flag <> -1 AND p.rating >= 3"),
    "smart_not_edited": (Rules(edited=False, rating=0), "e.photo_id IS NULL AND p.rating = 0"),
    "smart_edited": (Rules(edited=True), "e.photo_id IS NOT NULL"),
    "smart_rating_words": (Rules(rating=3, words="z 6 1995"), "p.rating >= 3 AND " + _words_sql("z 6 1995")),
}
for _name, (_rules, _where) in RULES.items():
    query(_name, _entries_sql(_where))(lambda s, d, r=_rules: Catalogue(Library(s, d)).matching(r))


@query("smart_counts_batch", O.with_tables(*_BASE, body=" UNION ALL ".join(f"SELECT '{k}' AS name, count(DISTINCT p.id) AS n {_FROM} ({w})" for k, (_, w) in RULES.items())))
def smart_counts_batch(s, d):
    return Catalogue(Library(s, d)).rule_counts({k: r for k, (r, _) in RULES.items()})


@query("smart_keyword", O.with_tables(*_BASE, body=f"SELECT {_ENTRY} {_FROM} p.id IN (SELECT photo_id FROM photo_keywords WHERE {_FOLD.format('name')} = (SELECT {_FOLD.format('min(p_name)')} FROM part))"))
def smart_keyword(s, d):
    name = Library(s, d)._read("part").agg(F.min("p_name")).first()[0]
    return Catalogue(Library(s, d)).matching(Rules(keyword=name.upper()))


# Albums and keywords.

_COVER = """SELECT a.id, a.name, count(DISTINCT x.photo_id) AS n, arg_min(x.path, (x.captured_at IS NULL, coalesce(x.captured_at, ''), x.path)) AS cover
FROM albums a LEFT JOIN (SELECT ap.album_id, ap.photo_id, f.path, p.captured_at FROM album_photos ap JOIN files f ON f.photo_id = ap.photo_id AND NOT f.missing JOIN photos p ON p.id = ap.photo_id) x ON x.album_id = a.id GROUP BY a.id, a.name"""


@query("album_list", O.with_tables(O.PHOTOS, O.FILES, O.ALBUMS, body=_COVER))
def album_list(s, d):
    return Catalogue(Library(s, d)).albums()


@query("album_photos", O.with_tables(*_BASE, O.ALBUMS, body=f"SELECT {_ENTRY} {_FROM} p.id IN (SELECT photo_id FROM album_photos WHERE album_id = 3)"))
def album_photos(s, d):
    return Catalogue(Library(s, d)).album(3)


@query("keyword_usage", O.with_tables(O.KEYWORDS, body="SELECT name, count(*) AS n FROM photo_keywords GROUP BY name"))
def keyword_usage(s, d):
    return Catalogue(Library(s, d)).keywords()


@query("keywords_on_selection", O.with_tables(O.KEYWORDS, body="SELECT name, count(*) AS n FROM photo_keywords WHERE photo_id % 50 = 1 GROUP BY name"))
def keywords_on_selection(s, d):
    lib = Library(s, d)
    return Catalogue(lib).keywords_on(lib.photos().filter("id % 50 = 1").select("id"))


@query("keyword_suggestions", O.with_tables(O.KEYWORDS, body="""SELECT name, n, "rank" FROM (SELECT name, count(*) AS n, CASE WHEN starts_with(lower(name), 'b') THEN 0 ELSE 1 END AS "rank" FROM photo_keywords WHERE contains(lower(name), 'b')
AND name NOT IN (SELECT name FROM photo_keywords WHERE photo_id = 1) GROUP BY name) ORDER BY "rank", n DESC, name LIMIT 6"""))
def keyword_suggestions(s, d):
    lib = Library(s, d)
    return Catalogue(lib).suggestions("B", lib.photos().filter("id = 1").select("id"))


@query("marked_photos", _entries_sql("p.rating > 0 OR p.flag <> 0 OR p.label <> 0 OR p.id IN (SELECT photo_id FROM photo_keywords)"))
def marked_photos(s, d):
    return Catalogue(Library(s, d)).marked()


# Folder listings.

_F1995 = "(f.dir = '/lib/Photos/1995' OR starts_with(f.dir, '/lib/Photos/1995/'))"


@query("files_in_recursive", O.with_tables(O.FILES, body=f"SELECT f.* FROM files f WHERE {_F1995}"))
def files_in_recursive(s, d):
    return Catalogue(Library(s, d)).files_in("/lib/Photos/1995/", True)


@query("folder_listing", O.with_tables(*_BASE, body=f"""SELECT f.path, f.size, p.rating, p.flag, p.label, CASE WHEN metadata_version > 0 THEN camera_model END AS camera_model, CASE WHEN metadata_version > 0 THEN captured_at END AS captured_at, e.photo_id IS NOT NULL AS edited
FROM files f LEFT JOIN photos p ON p.id = f.photo_id LEFT JOIN edits e ON e.photo_id = f.photo_id WHERE {_F1995}"""))
def folder_listing(s, d):
    return Catalogue(Library(s, d)).listing("/lib/Photos/1995")


@query("details_queue", O.with_tables(O.PHOTOS, O.FILES, body="SELECT p.id, f.path FROM photos p JOIN files f ON f.photo_id = p.id WHERE NOT f.missing AND metadata_version < 1 AND starts_with(f.dir, '/lib/Photos/') ORDER BY p.id LIMIT 100"))
def details_queue(s, d):
    return Catalogue(Library(s, d)).details_queue("/lib/Photos", 100)


@query("camera_names", """SELECT * FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'NIKON CORPORATION Z 6' WHEN o_orderkey % 3 = 1 THEN 'Canon EOS R5' ELSE 'Phone X' END AS camera FROM orders)""")
def camera_names(s, d):
    return Library(s, d).photos().select("id", X.camera_name(F.col("camera_make"), F.col("camera_model")).alias("camera"))


@query("access_scope", O.with_tables(O.FILES, body="SELECT id, path, CASE WHEN starts_with(path, '/lib/Photos/1995/') THEN '/lib/Photos/1995' WHEN starts_with(path, '/lib/Photos/') THEN '/lib/Photos' END AS root FROM files WHERE starts_with(path, '/lib/Photos/')"))
def access_scope(s, d):
    return Catalogue(Library(s, d)).within(["/lib/Photos", "/lib/Photos/1995", "/lib/Photo"])


@query("photo_neighbours", O.with_tables(O.PHOTOS, O.FILES, body="""SELECT p.id, f.dir, coalesce(lag(p.id) OVER w, -1) AS before, coalesce(lead(p.id) OVER w, -1) AS after FROM photos p JOIN files f ON f.photo_id = p.id WHERE NOT f.missing WINDOW w AS (PARTITION BY f.dir ORDER BY p.captured_at NULLS LAST, f.path)"""))
def photo_neighbours(s, d):
    c = Catalogue(Library(s, d))
    return c.neighbours(c.present()).fillna(-1)


@query("natural_sort", """SELECT name, row_number() OVER (ORDER BY n, kind) AS nth FROM (SELECT 'DSC_' || p_partkey || '.NEF' AS name, p_partkey AS n, 0 AS kind FROM part WHERE p_partkey <= 150 UNION ALL SELECT 'dsc_0' || p_partkey || '.nef', p_partkey, 1 FROM part WHERE p_partkey <= 150)""")
def natural_sort(s, d):
    return _natural_sort(Library(s, d)._read("part").filter("p_partkey <= 150"))


def _natural_sort(part: DataFrame) -> DataFrame:
    names = part.selectExpr("concat('DSC_', p_partkey, '.NEF') AS name").union(part.selectExpr("concat('dsc_0', p_partkey, '.nef')"))
    # No part of a key begins another one, so that the parts as one text compare as they do; a column of its own, it is told once for each row.
    keyed = names.withColumn("key", F.array_join(X.natural_key(F.col("name")), ""))
    return running(keyed, "nth", F.array("key"), [F.col("key"), F.col("name")], F.lit(1).cast("long")).select("name", "nth")


@query("natural_sort_all", """SELECT name, row_number() OVER (ORDER BY n, kind) AS nth FROM (SELECT 'DSC_' || p_partkey || '.NEF' AS name, p_partkey AS n, 0 AS kind FROM part UNION ALL SELECT 'dsc_0' || p_partkey || '.nef', p_partkey, 1 FROM part)""")
def natural_sort_all(s, d):
    return _natural_sort(Library(s, d)._read("part"))


@query("library_sort_newest", O.with_tables(O.PHOTOS, O.FILES, body="SELECT p.id, f.path FROM photos p JOIN files f ON f.photo_id = p.id WHERE NOT f.missing ORDER BY p.captured_at DESC NULLS LAST, f.path LIMIT 200"))
def library_sort_newest(s, d):
    return Catalogue(Library(s, d)).present().orderBy(F.col("captured_at").desc_nulls_last(), "path").limit(200).select("id", "path")


@query("photo_count", "SELECT count(*) AS n FROM orders")
def photo_count(s, d):
    return Library(s, d).photos().agg(F.count("*").alias("n"))


# Indexing.

_DIFF = """, k AS (SELECT t0.id, t0.path AS p0, t1.path AS p1, t0.size AS s0, t0.fingerprint AS f0, t1.size AS s1, t1.fingerprint AS f1, t0.size = t1.size AND t0.modified_ns = t1.modified_ns AS same FROM t0 FULL JOIN t1 ON t0.path = t1.path),
o AS (SELECT id, p0, s0, f0, row_number() OVER (PARTITION BY s0, f0 ORDER BY id) AS nth FROM k WHERE p1 IS NULL), n AS (SELECT p1, s1, f1, row_number() OVER (PARTITION BY s1, f1 ORDER BY p1) AS nth FROM k WHERE p0 IS NULL),
d AS (SELECT id, p0 AS path, CASE WHEN same THEN 'unchanged' ELSE 'changed' END AS outcome, NULL::VARCHAR AS from_path FROM k WHERE p0 IS NOT NULL AND p1 IS NOT NULL
UNION ALL SELECT o.id, coalesce(n.p1, o.p0), CASE WHEN o.p0 IS NULL THEN 'new' WHEN n.p1 IS NULL THEN 'missing' ELSE 'moved' END, CASE WHEN n.p1 IS NOT NULL THEN o.p0 END FROM n FULL JOIN o ON s0 = s1 AND f0 = f1 AND n.nth = o.nth) """


def _diff(s, d):
    lib = Library(s, d)
    return index.outcomes(lib.snapshot(False), lib.snapshot(True))


@query("index_diff", f"WITH {O.SNAPSHOTS}{_DIFF} SELECT * FROM d")
def index_diff(s, d):
    return _diff(s, d)


@query("index_summary", f"WITH {O.SNAPSHOTS}{_DIFF} SELECT " + ", ".join(f"count(*) FILTER (outcome = '{k}') AS n_{k}" for k in ("new", "changed", "moved", "unchanged", "missing")) + " FROM d")
def index_summary(s, d):
    return index.summary(_diff(s, d))


@query("move_detection", f"WITH {O.SNAPSHOTS}{_DIFF} SELECT id, from_path, path FROM d WHERE outcome = 'moved'")
def move_detection(s, d):
    return _diff(s, d).filter("outcome = 'moved'").select("id", "from_path", "path")


@query("missing_files", f"WITH {O.SNAPSHOTS}{_DIFF} SELECT id, path FROM d WHERE outcome = 'missing'")
def missing_files(s, d):
    return _diff(s, d).filter("outcome = 'missing'").select("id", "path")


@query("touch_unchanged", f"WITH {O.SNAPSHOTS} SELECT t0.id, t0.path FROM t0 JOIN t1 USING (path, size, modified_ns)")
def touch_unchanged(s, d):
    lib = Library(s, d)
    return lib.snapshot(False).join(lib.snapshot(True), ["path", "size", "modified_ns"], "left_semi").select("id", "path")


@query("orphan_photos", O.with_tables(O.PHOTOS, O.FILES, body="SELECT id FROM photos WHERE id NOT IN (SELECT photo_id FROM files WHERE folder_id <> 2)"))
def orphan_photos(s, d):
    lib = Library(s, d)
    return index.orphans(lib.photos(), index.without_folder(lib.files(), 2)).select("id")


@query("next_scan", O.with_tables(O.FILES, body="SELECT coalesce(max(last_seen_scan), 0) + 1 AS scan FROM files"))
def next_scan(s, d):
    return index.next_scan(Library(s, d).files())


# Retention and names.

_B = f"""{O.BACKUPS}, r AS (SELECT *, row_number() OVER (PARTITION BY kind = 'pre-upgrade' ORDER BY taken_at_ms DESC, path) AS nth,
CASE WHEN {{now}} - taken_at_ms < 604800000 THEN 'day' || (taken_at_ms // 86400000) WHEN {{now}} - taken_at_ms < 3024000000 THEN 'week' || (taken_at_ms // 604800000) END AS bucket FROM backups),
q AS (SELECT *, row_number() OVER (PARTITION BY kind = 'pre-upgrade', bucket ORDER BY taken_at_ms DESC, path) AS inside FROM r)
SELECT path, taken_at_ms, kind FROM q WHERE NOT (CASE WHEN kind = 'pre-upgrade' THEN nth <= 2 ELSE nth <= 3 OR (bucket IS NOT NULL AND inside = 1) END)"""
BACKUP_NOW = 1706745600000


@query("backup_retention", "WITH " + _B.format(now=BACKUP_NOW))
def backup_retention(s, d):
    return retention.to_prune(Library(s, d).backups(), BACKUP_NOW)


@query("backup_newest_valid", O.with_tables(O.BACKUPS, body="SELECT arg_max(path, (taken_at_ms, path)) AS path FROM backups WHERE kind <> 'auto'"))
def backup_newest_valid(s, d):
    return retention.newest_valid(Library(s, d).backups().withColumn("valid", F.col("kind") != "auto"))


@query("export_names", """WITH s AS (SELECT '/in/' || o_orderkey || '/' || o_orderpriority || '.NEF' AS path, o_orderpriority AS stem, o_orderkey AS k FROM orders WHERE o_orderkey <= 400), n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY path) AS nth FROM s),
t AS (SELECT stem, nth, path, CASE WHEN stem = '5-LOW' THEN nth + CASE WHEN nth >= 3 THEN 2 ELSE 1 END ELSE nth END AS k FROM n) SELECT path, CASE WHEN k = 1 THEN stem ELSE stem || '-' || k END || '.jpg' AS name FROM t""")
def export_names(s, d):
    return _export_names(s, Library(s, d)._read("orders").filter("o_orderkey <= 400"))


def _export_names(s: SparkSession, orders: DataFrame) -> DataFrame:
    sources = orders.selectExpr("concat('/in/', o_orderkey, '/', o_orderpriority, '.NEF') AS path")
    return retention.export_names(sources, "jpg", s.createDataFrame([("5-LOW.jpg",), ("5-LOW-4.jpg",), ("other.txt",)], "name string"))


@query("export_names_all", """WITH s AS (SELECT '/in/' || o_orderkey || '/' || o_orderpriority || '.NEF' AS path, o_orderpriority AS stem, o_orderkey AS k FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY path) AS nth FROM s),
t AS (SELECT stem, nth, path, CASE WHEN stem = '5-LOW' THEN nth + CASE WHEN nth >= 3 THEN 2 ELSE 1 END ELSE nth END AS k FROM n) SELECT path, CASE WHEN k = 1 THEN stem ELSE stem || '-' || k END || '.jpg' AS name FROM t""")
def export_names_all(s, d):
    return _export_names(s, Library(s, d)._read("orders"))


# Changes.


@query("set_marks", O.with_tables(O.PHOTOS, body="SELECT id, CASE WHEN id % 3 = 0 THEN 5 ELSE rating END AS rating, CASE WHEN id % 3 = 0 THEN -1 ELSE flag END AS flag, label FROM photos"))
def set_marks(s, d):
    photos = Library(s, d).photos()
    change = photos.filter("id % 3 = 0").selectExpr("id", "5L AS rating", "-1 AS flag", "cast(NULL AS bigint) AS label")
    return changes.set_marks(photos, change).select("id", "rating", "flag", "label")


@query("import_marks", O.with_tables(O.PHOTOS, body="SELECT id, CASE WHEN id % 2 = 0 AND rating = 0 AND flag = 0 AND label = 0 THEN 3 ELSE rating END AS rating, flag, label FROM photos"))
def import_marks(s, d):
    photos = Library(s, d).photos()
    found = photos.filter("id % 2 = 0").selectExpr("id", "3L AS rating", "cast(NULL AS int) AS flag", "cast(NULL AS bigint) AS label")
    return changes.import_marks(photos, found).select("id", "rating", "flag", "label")


@query("edit_latest", O.with_tables(O.EDITS, body="SELECT photo_id, updated_at_ms, round(value, 4) AS value, event_type FROM edits WHERE event_type <> 'error'"))
def edit_latest(s, d):
    events = Library(s, d).edit_events().select("photo_id", "updated_at_ms", "event_id", "value", "event_type")
    return changes.latest(events, "photo_id", ["updated_at_ms", "event_id"], F.col("event_type") == "error").select("photo_id", "updated_at_ms", F.round("value", 4).alias("value"), "event_type")


@query("add_to_album", O.with_tables(O.ALBUMS, body="SELECT album_id, photo_id FROM album_photos UNION SELECT 1, o_orderkey FROM orders WHERE o_orderkey % 5 = 0"))
def add_to_album(s, d):
    lib = Library(s, d)
    return changes.add_links(lib.album_photos(), lib.photos().filter("id % 5 = 0").selectExpr("1L AS album_id", "id AS photo_id"))


@query("remove_from_album", O.with_tables(O.ALBUMS, body="SELECT album_id, photo_id FROM album_photos WHERE NOT (album_id = 1 AND photo_id % 2 = 0)"))
def remove_from_album(s, d):
    lib = Library(s, d)
    return changes.remove_links(lib.album_photos(), lib.photos().filter("id % 2 = 0").selectExpr("1L AS album_id", "id AS photo_id"))


@query("add_keywords", "SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT p_type FROM part WHERE lower(p_type) NOT IN (SELECT lower(p_name) FROM part)")
def add_keywords(s, d):
    lib = Library(s, d)
    part = lib._read("part")
    typed = part.selectExpr("concat('  ', p_type, ' ') AS name").union(part.selectExpr("upper(p_name)"))
    return changes.add_keywords(lib.keywords().select("name"), typed)


# Text.


@query("text_tidy", r"""SELECT doc_id, nullif(rtrim(substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 200)), '') AS title FROM documents""")
def text_tidy(s, d):
    return Library(s, d)._read("documents").select("doc_id", X.tidy(F.col("text"), "title").alias("title"))


@query("keyword_names", r"""SELECT doc_id, CASE WHEN length(t) BETWEEN 1 AND 100 THEN t END AS name FROM (SELECT doc_id, trim(regexp_replace(text, '[\s\x00-\x1f\x7f]+', ' ', 'g')) AS t FROM documents)""")
def keyword_names(s, d):
    return Library(s, d)._read("documents").select("doc_id", X.name_of(F.col("text"), 100).alias("name"))


@query("bytes_shown", """SELECT o_orderkey AS id, CASE WHEN n < 1000 THEN n || ' B' WHEN n < 1000000 THEN n // 1000 || '.0 kB' ELSE n // 1000000 || '.0 MB' END AS shown FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 1 + o_orderkey % 900 WHEN 1 THEN 1000 * (1 + o_orderkey % 9) ELSE 1000000 * (1 + o_orderkey % 9) END AS n FROM orders)""")
def bytes_shown(s, d):
    n = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 1 + o_orderkey % 900 WHEN 1 THEN 1000 * (1 + o_orderkey % 9) ELSE 1000000 * (1 + o_orderkey % 9) END")
    return Library(s, d)._read("orders").select(F.col("o_orderkey").alias("id"), X.bytes_shown(n).alias("shown"))


@query("scene_ev", O.with_tables(O.PHOTOS, body="SELECT id, round(log2(aperture * aperture / shutter) - log2(iso / 100.0::DOUBLE), 6) AS ev FROM photos"))
def scene_ev(s, d):
    return Library(s, d).photos().select("id", F.round(X.scene_ev(F.col("iso"), F.col("aperture"), F.col("shutter")), 6).alias("ev"))


def _fnv_sql(hexed: str) -> str:
    """FNV-1a of bytes written as hexadecimal digits, as a signed value."""
    steps = f"list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length({hexed}) // 2 + 1), lambda i: ('0x' || substr({hexed}, 2 * i - 1, 2))::HUGEINT))"
    value = f"list_reduce({steps}, lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
    return f"CASE WHEN {value} >= 9223372036854775808::HUGEINT THEN {value} - 18446744073709551616::HUGEINT ELSE {value} END::BIGINT"


def _le_sql(n: str, width: int = 8) -> str:
    digits = f"lpad(printf('%X', {n}), {2 * width}, '0')"
    return "(" + " || ".join(f"substr({digits}, {2 * width - 1 - 2 * k}, 2)" for k in range(width)) + ")"


_FILE = f"WITH c AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS size, hex(encode(coalesce(text, ''))) AS h FROM documents), e AS (SELECT doc_id, size, {_le_sql('size')} || substr(h, 1, 131072) || substr(h, 2 * greatest(65536, size - 65536) + 1, 131072) AS h FROM c)"


@query("file_fingerprint", f"{_FILE} SELECT doc_id, {_fnv_sql('h')} AS fingerprint FROM e")
def file_fingerprint_(s, d):
    """Documents as files."""
    content = F.coalesce("text", F.lit("")).cast("binary")
    return Library(s, d)._read("documents").select("doc_id", file_fingerprint(content, F.octet_length(content).cast("long")).alias("fingerprint"))


@query("source_ids", O.with_tables(O.FILES, body=f"SELECT id, {_fnv_sql('h')} AS source_id FROM (SELECT id, {_le_sql('size')} || {_le_sql('modified_ns', 16)} || {_le_sql('fingerprint')} AS h FROM files)"))
def source_ids(s, d):
    return Library(s, d).files().select("id", source_id(F.col("size").cast("long"), F.col("modified_ns"), F.col("fingerprint")).alias("source_id"))


@query("render_keys", O.with_tables(O.FILES, body=f"SELECT id, {_fnv_sql('h')} AS recipe_hash, 200 AS width, 1 AS format FROM (SELECT id, hex(encode('{{\"exposure\":' || id || '}}')) AS h FROM files)"))
def render_keys(s, d):
    """The cache key of each photo's render: hash of its recipe as text, beside size and format."""
    return Library(s, d).files().select("id", fnv1a(F.concat(F.lit('{"exposure":'), F.col("id").cast("string"), F.lit("}")).cast("binary")).alias("recipe_hash"), F.lit(200).alias("width"), F.lit(1).alias("format"))


@query("decoder_formats", O.with_tables(O.FILES, body="SELECT id, CASE id % 4 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'tiff' WHEN 2 THEN 'raw' END AS format FROM files"))
def decoder_formats(s, d):
    path = F.expr("concat(substr(path, 1, length(path) - 3), CASE id % 4 WHEN 0 THEN 'JPeG' WHEN 1 THEN 'tif' WHEN 2 THEN 'nef' ELSE '' END)")
    return Library(s, d).files().select("id", files.decoder_for(path).alias("format"))


@query("listing_folders", O.with_tables(O.FILES, body="SELECT path, count(*) AS n FROM (SELECT '/lib/Photos/' || split_part(substr(path, 13), '/', 1) AS path FROM files WHERE starts_with(path, '/lib/Photos/')) GROUP BY path"))
def listing_folders(s, d):
    return files.folders_in(Library(s, d).files(), "/lib/Photos/")


@query("walk_stats", O.with_tables(O.FILES, body="SELECT count(*) FILTER (id % 3 = 0) AS photos, count(*) FILTER (id % 3 = 1) AS skipped, count(*) FILTER (id % 3 = 2) AS hidden FROM files"))
def walk_stats(s, d):
    return files.walked(Library(s, d).files().selectExpr("CASE id % 3 WHEN 0 THEN path WHEN 1 THEN concat(path, '.txt') ELSE concat(dir, '/.x.nef') END AS path"), ["nef"])


@query("fnv_fingerprint", f"SELECT n_nationkey, {_fnv_sql('h')} AS hash FROM (SELECT n_nationkey, hex(encode(n_name)) AS h FROM nation)")
def fnv_fingerprint(s, d):
    return Library(s, d)._read("nation").select("n_nationkey", fnv1a(F.col("n_name").cast("binary")).alias("hash"))


# Recipes.


def _recipes(lib: Library) -> DataFrame:
    """Saved recipes of several versions, made of events."""
    made = """to_json(named_struct('version', cast(event_id % 35 AS int), 'exposure', value / 32, 'contrast', cast(event_id % 7 * 20 AS double), 'whites', IF(event_id % 4 = 0, 10.0D, 0.0D),
        'sharpening', IF(event_id % 5 = 0, NULL, 40.0D), 'grain', -5.0D, 'calibration', IF(event_id % 6 = 0, named_struct('redHue', 10.0D), NULL)))"""
    return lib._read("events").selectExpr("event_id AS id", f"{made} AS recipe")


_READ = """r AS (SELECT event_id AS id, event_id % 35 AS v, greatest(-5, least(5, value / 32))::DOUBLE AS exposure, least(100, event_id % 7 * 20)::DOUBLE AS contrast, CASE WHEN event_id % 4 = 0 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS whites,
CASE WHEN event_id % 35 <= 6 THEN 0.0::DOUBLE ELSE 40.0::DOUBLE END AS sharpening, CASE WHEN event_id % 35 <= 1 THEN 'flat' ELSE 'standard' END AS look, event_id % 6 = 0 AS calibrated FROM events),
i AS (SELECT *, exposure = 0 AND contrast = 0 AND whites = 0 AND sharpening = 40 AND look = 'standard' AND NOT calibrated AS plain FROM r)"""


@query("recipe_migrate", f"""WITH {_READ} SELECT id, CASE WHEN v <= 33 THEN 33 END AS version, CASE WHEN v <= 33 THEN exposure END AS exposure, CASE WHEN v <= 33 THEN sharpening END AS sharpening, CASE WHEN v <= 33 THEN look END AS look,
CASE WHEN v <= 33 THEN v BETWEEN 2 AND 25 AND whites <> 0 END AS whites_from_sensor, CASE WHEN v <= 33 THEN v >= 29 OR plain END AS profile, CASE WHEN v <= 33 THEN v < 30 AND NOT plain END AS unoriented FROM i WHERE v <= 33""")
def recipe_migrate(s, d):
    held = _recipes(Library(s, d)).select("id", R.parsed(F.col("recipe")).alias("r")).filter("r IS NOT NULL")
    return held.selectExpr("id", "r.version", "r.exposure", "r.sharpening", "r.look", "r.whitesFromSensor AS whites_from_sensor", "r.profileCorrections AS profile", "r.unoriented")


@query("recipe_state", "SELECT event_id AS id, CASE WHEN event_id % 35 > 33 THEN 'newer' ELSE 'recipe' END AS state FROM events")
def recipe_state(s, d):
    return _recipes(Library(s, d)).select("id", R.state(F.col("recipe")).alias("state"))


@query("recipe_identity", f"WITH {_READ} SELECT id, plain AND v >= 29 OR plain AS identity FROM i WHERE v <= 33")
def recipe_identity(s, d):
    held = _recipes(Library(s, d)).select("id", R.parsed(F.col("recipe")).alias("r")).filter("r IS NOT NULL")
    return held.select("id", R.is_identity(F.col("r")).alias("identity"))


@query("recipe_paste_groups", f"""WITH {_READ} SELECT id, 1.5::DOUBLE AS exposure, contrast, whites, 20.0::DOUBLE AS vibrance, NOT calibrated AS uncalibrated FROM i WHERE v <= 33""")
def recipe_paste_groups(s, d):
    source = R.parsed(F.lit('{"version":33,"exposure":1.5,"contrast":50,"vibrance":20}'))
    held = _recipes(Library(s, d)).select("id", R.parsed(F.col("recipe")).alias("t"), source.alias("f")).filter("t IS NOT NULL")
    out = held.select("id", R.pasted(F.col("t"), F.col("f"), ["exposure", "colour", "no such group"]).alias("r"))
    return out.selectExpr("id", "r.exposure", "r.contrast", "r.whites", "r.vibrance", "r.calibration IS NULL AS uncalibrated")


@query("preset_overlay", f"""WITH {_READ} SELECT id, exposure, 50.0::DOUBLE AS contrast, 0.0::DOUBLE AS whites, 40.0::DOUBLE AS sharpening FROM i WHERE v <= 33""")
def preset_overlay(s, d):
    preset = R.look_only(R.parsed(F.lit('{"version":33,"exposure":1.5,"contrast":50,"masks":[{"id":1}]}')))
    held = _recipes(Library(s, d)).select("id", R.parsed(F.col("recipe")).alias("t"), preset.alias("p")).filter("t IS NOT NULL")
    out = held.select("id", R.with_look_of(F.col("t"), F.col("p")).alias("r"))
    return out.selectExpr("id", "r.exposure", "r.contrast", "r.whites", "r.sharpening")


# Pixels.

_Y = "(0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b)"


def _six(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select("image_id", "y", "x", *(F.round(c, digits).alias(c) for c in "rgb"))


def _point_sql(expr: str, digits: int) -> str:
    """expr: of one channel, written {c}."""
    return O.with_tables(O.PIXELS, body="SELECT image_id, y, x, " + ", ".join(f"round({expr.format(c=c, y=_Y)}, {digits}) AS {c}" for c in "rgb") + " FROM pixels")


def _point(name: str, stage: P.Stage, sql: str, digits: int = 6):
    query(name, _point_sql(sql, digits))(lambda s, d: _six(P.plan([stage], Library(s, d).pixels()), digits))


def _smooth(low: float, high: float, x: str) -> str:
    t = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, (({x}) - {low}::DOUBLE) / {high - low}::DOUBLE))"
    return f"({t} * {t} * (3.0::DOUBLE - 2.0::DOUBLE * {t}))"


_D = "(-log2(greatest({y}, 0.000001::DOUBLE)))"
_GAMMA, _GREY = 2.0 ** (0.3 * 0.8), 0.18 ** (1 / 2.2)
_TOP = 1.0 / (1.0 + (0.55 / 2.3784142) ** 1.65)
_point("px_exposure", P.exposure(0.5), f"{{c}} * {2.0**0.5!r}::DOUBLE")
_point("px_contrast", P.contrast(30), f"CASE WHEN {{c}} >= 0 AND {{c}} < 1 THEN pow(CASE WHEN pow({{c}}, {1 / 2.2!r}::DOUBLE) <= {_GREY!r} THEN {_GREY!r} * pow(pow({{c}}, {1 / 2.2!r}::DOUBLE) / {_GREY!r}, {_GAMMA!r}) ELSE 1 - {1 - _GREY!r} * pow((1 - pow({{c}}, {1 / 2.2!r}::DOUBLE)) / {1 - _GREY!r}, {_GAMMA!r}) END, 2.2::DOUBLE) ELSE greatest({{c}}, 0) END")
_point("px_base_curve", P.base_curve(), f"CASE WHEN {{c}} <= 0 THEN 0 WHEN {{c}} >= 1 THEN {{c}} ELSE 1 / (1 + pow(0.55::DOUBLE / ({{c}} * 2.3784142::DOUBLE), 1.65::DOUBLE)) / {_TOP!r}::DOUBLE END")
_point("px_saturation", P.saturation(-40), "{y} + ({c} - {y}) * 0.6::DOUBLE")
_point("px_tone_endpoints", P.tone_ends(40, -30), f"{{c}} * pow(2::DOUBLE, 0.4::DOUBLE * (1 - {_smooth(0.0, 1.5, _D)}) - 0.45::DOUBLE * {_smooth(4.0, 8.0, _D)})")
_TOPC, _LOWC = "greatest(r, g, b)", "least(r, g, b)"
_point("px_vibrance_muted", P.vibrance(-50), f"CASE WHEN {_TOPC} <= 0 OR {_TOPC} = {_LOWC} THEN {{c}} ELSE {{y}} + ({{c}} - {{y}}) * (1 - 0.5::DOUBLE * 0.6::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * (1 - sqrt(greatest({_LOWC}, 0) / {_TOPC})))) END")
_SECTOR = f"(CASE WHEN {_TOPC} = r THEN (g - b) / ({_TOPC} - {_LOWC}) WHEN {_TOPC} = g THEN (b - r) / ({_TOPC} - {_LOWC}) + 2 ELSE (r - g) / ({_TOPC} - {_LOWC}) + 4 END * 60)"
_HUE = f"({_SECTOR} - 360 * floor({_SECTOR} / 360))"
_AWAY = f"abs(({_HUE} + 160) - 360 * floor(({_HUE} + 160) / 360) - 180)"
_SAT = f"(1 - sqrt(greatest({_LOWC}, 0) / {_TOPC}))"
_point("px_vibrance", P.vibrance(60), f"CASE WHEN {_TOPC} <= 0 OR {_TOPC} = {_LOWC} THEN {{c}} ELSE {{y}} + ({{c}} - {{y}}) * (1 + 0.6::DOUBLE * (1 - {_SAT}) * (1 - {_SAT}) * (1 - 0.6::DOUBLE * greatest(0, 1 - {_AWAY} / 20))) END")
_DIST = "sqrt((pow((x + 0.5) / 64.0::DOUBLE * 2 - 1, 2) + pow((y + 0.5) / 64.0::DOUBLE * 2 - 1, 2)) * 0.5::DOUBLE)"
_point("px_vignette", lambda t: P.vignette(-60, 64, 64)(t), f"{{c}} * pow(2::DOUBLE, -0.9::DOUBLE * {_smooth(0.3, 1.0, _DIST)})")
_SCALE = (1.3 - 0.97) / (((1 - 0.97) / (1.3 - 0.97)) ** -1.2 - 1) ** (1 / 1.2)
_point("px_gamut", P.gamut(), f"CASE WHEN {_TOPC} <= 0 OR ({_TOPC} - {{c}}) / {_TOPC} < 0.97::DOUBLE THEN {{c}} ELSE {_TOPC} - (0.97::DOUBLE + (({_TOPC} - {{c}}) / {_TOPC} - 0.97::DOUBLE) / pow(1 + pow((({_TOPC} - {{c}}) / {_TOPC} - 0.97::DOUBLE) / {_SCALE!r}, 1.2::DOUBLE), {1 / 1.2!r}::DOUBLE)) * {_TOPC} END")
_MASK = "(1 - {t} * {t} * (3 - 2 * {t}))".replace("{t}", "greatest(0::DOUBLE, least(1::DOUBLE, (x - 8.0::DOUBLE) / 48))")
_point("mask_linear", lambda t: P.local_exposure(P.linear_mask((8.0, 0.0), (56.0, 0.0), F.col("x"), F.col("y")), 1.0)(t), f"{{c}} * pow(2::DOUBLE, {_MASK})")
_RAD = "(1 - {t} * {t} * (3 - 2 * {t}))".replace("{t}", "greatest(0::DOUBLE, least(1::DOUBLE, (sqrt(pow((x - 32) / 20.0::DOUBLE, 2) + pow((y - 32) / 30.0::DOUBLE, 2)) - 0.5) / 0.5))")


def _combined_mask(t):
    a = P.linear_mask((8.0, 0.0), (56.0, 0.0), F.col("x"), F.col("y"))
    b = P.radial_mask((32.0, 32.0), (20.0, 30.0), 50.0, F.col("x"), F.col("y"))
    return P.local_exposure(P.combined(P.combined(a, b, "add"), b, "subtract"), -1.0)(t)


_point("mask_combine", _combined_mask, f"{{c}} * pow(2::DOUBLE, -1 * ({_MASK} + {_RAD} - {_MASK} * {_RAD}) * (1 - {_RAD}))", 9)


def _calibration_sql(c: str) -> str:
    m = [[float(i == j) for j in range(3)] for i in range(3)]
    y = P.LUMA
    for i, (h, s_) in enumerate(((30, 20), (-10, 0), (0, -40))):
        own, to = [[float(k == z) - y[z] for k in range(3)] for z in (i, (i + (1 if h >= 0 else 2)) % 3)]
        for k in range(3):
            for j in range(3):
                m[k][j] += (abs(h) / 100 * P.HUE_RANGE[i] * to[k] + s_ / 100 * P.SATURATION_RANGE[i] * own[k]) * (float(i == j) - 1 / 3)
    a = m["rgb".index(c)]
    return f"round(greatest(0, r * {a[0]!r}::DOUBLE + g * ({a[1]!r})::DOUBLE + b * ({a[2]!r})::DOUBLE), 6) AS {c}"


@query("px_calibration", O.with_tables(O.PIXELS, body="SELECT image_id, y, x, " + ", ".join(map(_calibration_sql, "rgb")) + " FROM pixels"))
def px_calibration(s, d):
    return _six(P.plan([P.calibration(((30, 20), (-10, 0), (0, -40)))], Library(s, d).pixels()))


_CODE = "CAST(floor((CASE WHEN {v} <= 0.0031308 THEN {v} * 12.92 ELSE 1.055 * pow({v}, 1 / 2.4::DOUBLE) - 0.055 END) * 255 + 0.5) AS INT)"
_EIGHT = "e AS (SELECT image_id, y, x, " + ", ".join(_CODE.format(v=f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {c}))") + f" AS {c}" for c in "rgb") + " FROM pixels)"
_LONG = "l AS (SELECT image_id, 'r' AS channel, r AS bin FROM e UNION ALL SELECT image_id, 'g', g FROM e UNION ALL SELECT image_id, 'b', b FROM e UNION ALL SELECT image_id, 'luma', (54 * r + 183 * g + 19 * b + 128) >> 8 FROM e), h AS (SELECT image_id, channel, bin, count(*) AS n FROM l GROUP BY ALL)"


def _eight(s, d):
    df = Library(s, d).pixels()
    return df.select("image_id", "y", "x", *(P.quantised(F.col(c)).alias(c) for c in "rgb"))


@query("px_encode8", O.with_tables(O.PIXELS, _EIGHT, body="SELECT * FROM e"))
def px_encode8(s, d):
    return _eight(s, d)


@query("px_histogram", O.with_tables(O.PIXELS, _EIGHT, _LONG, body="SELECT * FROM h"))
def px_histogram(s, d):
    return P.histogram(_eight(s, d))


@query("px_percentiles", O.with_tables(O.PIXELS, _EIGHT, _LONG, body="""SELECT image_id, channel, round(arg_min((bin + greatest(0, least(1, (total * 0.9::DOUBLE - seen) / n))) / 256, bin), 6) AS value FROM (SELECT *, sum(n) OVER (PARTITION BY image_id, channel ORDER BY bin)::DOUBLE - n AS seen, sum(n) OVER (PARTITION BY image_id, channel)::DOUBLE AS total FROM h) WHERE seen + n >= total * 0.9 GROUP BY ALL"""))
def px_percentiles(s, d):
    return P.percentile(P.histogram(_eight(s, d)), 0.9).withColumn("value", F.round("value", 6))


@query("px_white_point", O.with_tables(O.PIXELS, body=f"SELECT image_id, round(greatest(-4, least(10, v)), 6) AS white_stops FROM (SELECT image_id, {_D.format(y=_Y)} AS v, row_number() OVER (PARTITION BY image_id ORDER BY {_D.format(y=_Y)}, y, x) AS nth, count(*) OVER (PARTITION BY image_id) AS n FROM pixels) WHERE nth = CAST(floor(n * 0.005::DOUBLE) AS BIGINT) + 1"))
def px_white_point(s, d):
    return P.white_point(Library(s, d).pixels()).withColumn("white_stops", F.round("white_stops", 6))


@query("px_pyramid", O.with_tables(O.PIXELS, _EIGHT, body="SELECT image_id, y // 2 AS y, x // 2 AS x, " + ", ".join(f"CAST((sum({c}) + 2) // 4 AS BIGINT) AS {c}" for c in "rgb") + " FROM e GROUP BY image_id, y // 2, x // 2"))
def px_pyramid(s, d):
    return P.halved(_eight(s, d), 64)


@query("px_scene_map", O.with_tables(O.PIXELS, body="SELECT image_id, y * 16 // 64 AS y, x * 16 // 64 AS x, " + ", ".join(f"round(avg({c}), 10) AS {c}" for c in "rgb") + " FROM pixels GROUP BY image_id, y * 16 // 64, x * 16 // 64"))
def px_scene_map(s, d):
    return P.scene_map(Library(s, d).pixels(), 64, 16).select("image_id", "y", "x", *(F.round(c, 10).alias(c) for c in "rgb"))


@query("px_box_blur", O.with_tables(O.PIXELS, "h AS (SELECT image_id, y, x, avg(r) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM pixels)", body="SELECT image_id, y, x, round(avg(v) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 10) AS blurred FROM h"))
def px_box_blur(s, d):
    return P.box(Library(s, d).pixels(), ["r"], 2).select("image_id", "y", "x", F.round("box_r", 10).alias("blurred"))


def _box_sql(src: str, cols: list[str], name: str, r: int) -> str:
    w = "(PARTITION BY image_id, {} ORDER BY {} ROWS BETWEEN " + f"{r} PRECEDING AND {r} FOLLOWING)"
    h = f"{name}_h AS (SELECT image_id, y, x, r, g, b, " + ", ".join(f"avg({c}) OVER {w.format('y', 'x')} AS {c}_m" for c in cols) + f" FROM {src})"
    return h + f", {name} AS (SELECT image_id, y, x, r, g, b, " + ", ".join(f"avg({c}_m) OVER {w.format('x', 'y')} AS {c}_m" for c in cols) + f" FROM {name}_h)"


_G0 = f"g0 AS (SELECT *, {_Y} AS gu, r AS iv, {_Y} * {_Y} AS gg, {_Y} * r AS gi FROM pixels)"
_G2 = "g2 AS (SELECT *, (gi_m - gu_m * iv_m) / (greatest(0, gg_m - gu_m * gu_m) + 0.25::DOUBLE) AS aa, iv_m - (gi_m - gu_m * iv_m) / (greatest(0, gg_m - gu_m * gu_m) + 0.25::DOUBLE) * gu_m AS bb FROM g1)"


@query("px_guided_map", O.with_tables(O.PIXELS, _G0, _box_sql("g0", ["gu", "iv", "gg", "gi"], "g1", 3), _G2, _box_sql("g2", ["aa", "bb"], "g3", 3), body="SELECT image_id, y, x, round(aa_m, 4) + 0.0 AS a, round(bb_m, 4) + 0.0 AS b FROM g3"))
def px_guided_map(s, d):
    out = P.guided(Library(s, d).pixels(), P.luma(P.rgb()), F.col("r"), 3, 0.25)
    return out.select("image_id", "y", "x", (F.round("a", 4) + 0.0).alias("a"), (F.round("b", 4) + 0.0).alias("b"))


_W = "(PARTITION BY image_id, {} ORDER BY {} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"


@query("px_dehaze_airlight", O.with_tables(O.PIXELS, f"h AS (SELECT *, min(least(r, g, b)) OVER {_W.format('y', 'x')} AS m FROM pixels)", f"v AS (SELECT *, min(m) OVER {_W.format('x', 'y')} AS low FROM h)", "k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY low DESC, y, x) AS nth, count(*) OVER (PARTITION BY image_id) AS n FROM v)", body="SELECT image_id, " + ", ".join(f"round(greatest(avg({c}), 0.0001), 5) AS air_{c}" for c in "rgb") + " FROM k WHERE nth <= greatest(1, ceil(n * 0.001::DOUBLE)) GROUP BY image_id"))
def px_dehaze_airlight(s, d):
    return P.airlight(Library(s, d).pixels(), 3).select("image_id", *(F.round(f"air_{c}", 5).alias(f"air_{c}") for c in "rgb"))


@query("px_pipeline")
def px_pipeline(s, d):
    """A whole recipe in one projection, then 8-bit codes."""
    stages = [P.white_balance((1.05, 1.0, 0.95)), P.exposure(0.3), P.tone_ends(10, -20), P.vignette(-40, 64, 64), P.contrast(15), P.base_curve(), P.vibrance(25), P.saturation(5), P.gamut()]
    df = P.plan(stages, Library(s, d).pixels())
    return df.select("image_id", "y", "x", *(P.quantised(F.col(c)).alias(c) for c in "rgb"))


def flagship(s: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["search_flagship"](s, sf_dir)


from . import queries_changes, queries_foreign, queries_light, queries_pixels, queries_retouch, queries_views  # noqa: E402,F401  register their queries
