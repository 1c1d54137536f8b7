"""Small libraries with known answers, and every query against its SQL on the smallest tables."""

from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import fotolith.queries as Q
from fotolith.functions import text as X
from fotolith.functions.fingerprint import fingerprint, fnv1a
from fotolith.operators import changes, index, retention
from fotolith.operators.catalogue import Catalogue, Rules, checked_rules
from fotolith.operators.search import terms
from fotolith.plans import pixels as P
from fotolith.plans import recipe as R

SF = "/root/testdata/sf0.001"


class Small:
    """Four photos in one folder, one of them edited, and one more of a folder above."""

    def __init__(self, spark):
        self.spark = spark

    def photos(self):
        rows = [
            (1, 0, 1, "2025-06-24T21:10:00", "NIKON CORPORATION", "Z 6", "NIKKOR Z 24-70mm", 4, 1, 1, 50.0, 6.0),
            (2, 0, 1, "2026-09-03T08:00:00", "NIKON CORPORATION", "Z f", "NIKKOR Z 40mm", 2, -1, 0, 50.0, None),
            (3, 0, 0, None, None, None, None, 5, 0, 3, None, None),
            (4, 0, 1, None, None, None, None, 0, 0, 0, None, None),
        ]
        held = self.spark.createDataFrame(rows, "id long, created_at_ms long, metadata_version int, captured_at string, camera_make string, camera_model string, lens string, rating int, flag int, label int, latitude double, longitude double")
        more = {c: F.lit(None).cast("double") for c in ("iso", "aperture", "shutter", "focal_length", "width", "height", "rotation")}
        return held.withColumns({**more, "title": F.lit(None).cast("string"), "caption": F.lit(None).cast("string")})

    def files(self):
        rows = [(1, "/home/trip/photos/Isle of Skye/DSC_1.NEF"), (2, "/home/trip/photos/Lake District/IMG_2.JPG"), (3, "/home/trip/photos/Lake District/scan_50%.tif"), (4, "/home/trip/photos/d.nef")]
        return self.spark.createDataFrame([(i, i, 1, p, p.rpartition("/")[0], 10, 0, i, False, 1) for i, p in rows], "id long, photo_id long, folder_id long, path string, dir string, size long, modified_ns long, fingerprint long, missing boolean, last_seen_scan long")

    def folders(self):
        return self.spark.createDataFrame([(1, "/home/trip/photos")], "id long, path string")

    def edits(self):
        return self.spark.createDataFrame([(3, 5)], "photo_id long, updated_at_ms long")

    def photo_keywords(self):
        return self.spark.createDataFrame([(4, "Sheep")], "photo_id long, name string")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_terms():
    kinds = [t.kind for t in terms("Iceland  2026, Sept 24 nikon 2026-09")]
    assert kinds == ["text", "year", "month", "day", "text", "date"]
    assert [t.kind for t in terms("ma 45 1234")] == ["text"] * 3
    assert len(terms("a " * 20)) == 8


def test_search(spark):
    c = Catalogue(Small(spark))
    for query, want in {"skye": [1], "LAKE district": [2, 3], "nikon 40mm": [2], "2025": [1], "sept": [2], "june 24": [1], "2026-09": [2], "skye 2026": [], "50%": [3], "": [], "trip": [], "photos": [1, 2, 3, 4], "SHEEP": [4]}.items():
        assert ids(c.search(query)) == want, query


def test_rules_and_counts(spark):
    c = Catalogue(Small(spark))
    cases = {Rules(): [1, 2, 3, 4], Rules(rating=3): [1, 3], Rules(rating=0): [4], Rules(flag=1): [1], Rules(flag=-1): [2], Rules(flag=0): [3, 4], Rules(flag=2): [1, 3, 4], Rules(label=0): [2, 4], Rules(edited=True): [3], Rules(edited=False): [1, 2, 4], Rules(rating=3, words="skye"): [1], Rules(keyword=" sheep "): [4]}
    counts = {r.name: r.n for r in c.rule_counts({str(i): r for i, r in enumerate(cases)}).collect()}
    for i, (rules, want) in enumerate(cases.items()):
        assert ids(c.matching(rules)) == want, rules
        assert counts[str(i)] == len(want)
    with pytest.raises(ValueError):
        checked_rules("all", Rules())


def test_entries_hide_unread_details(spark):
    rows = {r.id: r for r in Catalogue(Small(spark)).collection("all", 0).collect()}
    assert list(rows) == [1, 2, 4, 3] or list(rows)[:2] == [1, 2]
    assert rows[1].latitude == 50.0 and rows[2].latitude is None


def test_index_outcomes(spark):
    kind = "id long, path string, size long, modified_ns long, fingerprint long, missing boolean"
    known = spark.createDataFrame([(1, "a", 1, 1, 1, False), (2, "b", 2, 2, 2, False), (3, "c", 3, 3, 3, False), (4, "d", 4, 4, 4, False), (5, "e", 3, 3, 3, True)], kind)
    now = spark.createDataFrame([("a", 1, 1, 1), ("b", 2, 9, 9), ("x", 3, 7, 3), ("copy", 1, 5, 1), ("y", 4, 4, 4), ("z", 4, 4, 4)], "path string, size long, modified_ns long, fingerprint long")
    got = {r.path: (r.outcome, r.id, r.from_path) for r in index.outcomes(known, now).collect()}
    assert got == {"a": ("unchanged", 1, None), "b": ("changed", 2, None), "x": ("moved", 5, "e"), "c": ("missing", 3, None), "copy": ("new", None, None), "y": ("moved", 4, "d"), "z": ("new", None, None)}
    one = index.summary(index.outcomes(known, now)).first()
    assert (one.n_new, one.n_changed, one.n_moved, one.n_unchanged, one.n_missing) == (2, 1, 2, 1, 1)


def test_retention(spark):
    day, now = retention.DAY_MS, 100 * retention.DAY_MS
    rows = [(f"b{k}", now - k * day // 2, "auto") for k in range(1, 100)] + [(f"u{k}", now - k * day, "pre-upgrade") for k in range(1, 5)]
    kept = {r[0] for r in rows} - {r.path for r in retention.to_prune(spark.createDataFrame(rows, "path string, taken_at_ms long, kind string"), now).collect()}
    assert {"b1", "b2", "b3", "u1", "u2"} <= kept and not {"u3", "u4"} & kept
    assert len(kept) <= 16


def test_export_names(spark):
    sources = spark.createDataFrame([("/a/p.nef",), ("/b/p.nef",), ("/c/q.nef",)], "path string")
    names = {r.path: r.name for r in retention.export_names(sources, "jpg", spark.createDataFrame([("p.jpg",), ("p-3.jpg",)], "name string")).collect()}
    assert names == {"/a/p.nef": "p-2.jpg", "/b/p.nef": "p-4.jpg", "/c/q.nef": "q.jpg"}


@pytest.mark.parametrize("rows", [10_000, 20])
def test_export_names_across_stems(spark, monkeypatch, rows):
    import random

    from fotolith.operators import order

    monkeypatch.setattr(order, "ROWS", rows)
    rng = random.Random(rows)
    stems = ["p", "p-2", "p-3", "p-2-2", "p-2-3", "p-2-2-2", "q-2", "q", "p-1", "p-01"]
    cases = [(["/a/p.nef", "/b/p.nef", "/c/p-2.nef"], [])]
    cases += [([f"/{rng.randrange(1000):03}-{i}/{rng.choice(stems)}.nef" for i in range(n)], taken) for n, taken in ((60, ["p-4", "p-2-2", "q"]), (150, []))]
    for paths, taken in cases:
        held, want = {f"{t}.jpg" for t in taken}, {}
        for path in sorted(paths):  # as the reference does it, one after the other
            stem = path.rpartition("/")[2].removesuffix(".nef")
            want[path] = next(n for k in range(1, 999) if (n := f"{stem}{f'-{k}' if k > 1 else ''}.jpg") not in held)
            held.add(want[path])
        existing = spark.createDataFrame([(f"{t}.jpg",) for t in taken], "name string")
        assert {r.path: r.name for r in retention.export_names(spark.createDataFrame([(p,) for p in paths], "path string"), "jpg", existing).collect()} == want


def test_text(spark):
    row = spark.createDataFrame([("  a \t b\n\n\n c ", "b, A;a\nb c", "NIKON", "Nikon Z 6")], "t string, k string, make string, model string")
    got = row.select(X.tidy(F.col("t"), "title"), X.tidy(F.col("t"), "caption"), X.keywords_in(F.col("k")), X.camera_name(F.col("make"), F.col("model"))).first()
    assert tuple(got) == ("a b c", "a b\n\nc", ["b", "A", "b c"], "Nikon Z 6")
    names = ["DSC_10", "dsc_2", "a01", "a1", "B", "a"]
    order = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(X.natural_key(F.col("n"))).collect()]
    assert order == ["a", "a1", "a01", "B", "dsc_2", "DSC_10"]


def test_fnv(spark):
    def plain(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return h - (1 << 64) if h >> 63 else h

    for data in (b"", b"a", b"foobar", bytes(range(256))):
        df = spark.createDataFrame([(bytearray(data),)], "c binary")
        assert df.select(fnv1a(F.col("c"))).first()[0] == plain(data)
        assert df.select(fingerprint(F.col("c"), F.lit(len(data)).cast("long"))).first()[0] == plain(len(data).to_bytes(8, "little") + data)


def test_recipes(spark):
    df = spark.createDataFrame([('{"version":1}',), ('{"version":33}',), ('{"version":34}',), ("junk",), ('{"version":20,"whites":5,"exposure":99}',)], "r string").withColumn("p", R.parsed(F.col("r")))
    rows = df.select("r", "p", R.is_identity(F.col("p")).alias("i"), R.state(F.col("r")).alias("s")).collect()
    assert [r.s for r in rows] == ["recipe", "recipe", "newer", "none", "recipe"]
    assert rows[0].p.look == "flat" and rows[0].p.unoriented and rows[1].i
    assert rows[4].p.exposure == 5.0 and rows[4].p.whitesFromSensor and not rows[4].p.profileCorrections


def test_changes(spark):
    photos = spark.createDataFrame([(1, 0, 0, 0), (2, 3, 0, 0)], "id long, rating int, flag int, label int")
    change = spark.createDataFrame([(1, 5, None, None), (2, 5, None, None)], "id long, rating int, flag int, label int")
    assert [r.rating for r in changes.set_marks(photos, change).orderBy("id").collect()] == [5, 5]
    assert [r.rating for r in changes.import_marks(photos, change).orderBy("id").collect()] == [5, 3]


def test_pixel_invariants(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.18, 0.18, 0.18), (1, 0, 1, 1.0, 1.0, 1.0), (1, 0, 2, 0.0, 0.0, 0.0)], "image_id long, y int, x int, r double, g double, b double")
    for stage in (P.contrast(50), P.base_curve(), P.saturation(-100), P.vibrance(80), P.gamut(), P.calibration(((50, 50), (0, 0), (-20, 10)))):
        for r in P.plan([stage], df).collect():
            assert abs(r.r - r.g) < 1e-9 and abs(r.g - r.b) < 1e-9 and 0 <= r.r <= 1 + 1e-12
    same = P.plan([None, None], df).collect()
    assert same == df.collect()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(float(v), 6) if isinstance(v, float | Decimal) else v


def test_source_ids_go_by_batches(spark):
    from fotolith.functions.fingerprint import fnv1a, little_endian, source_id

    rows = [(1, 20_000_000, 902016 * 10**12, 7919), (2, 0, 0, 0), (3, 2**62 + 1, 2**53 + 1, 2**63 - 1), (4, None, 1, 2), (5, 3, None, 4), (6, 5, 6, None), (7, 255, 256, 2**56 - 1)]
    df = spark.createDataFrame(rows, "id int, size long, modified_ns long, fingerprint long")
    of = (F.col("size"), F.col("modified_ns"), F.col("fingerprint"))
    got = df.select("id", source_id(*of).alias("s"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambda" not in plan  # no interpreted step for each byte
    want = df.select("id", fnv1a(F.concat(little_endian(of[0]), little_endian(of[1], 16), little_endian(of[2]))).alias("s"))
    # As in SQL, no id where a number is unknown.
    assert {r.id: r.s for r in got.collect()} == {r.id: r.s for r in want.collect()} | {4: None, 5: None, 6: None}


def test_ranges_are_told_by_halves(spark, monkeypatch):
    import bisect
    import random

    from fotolith.operators import order

    rng = random.Random(5)
    texts = ["", "a", "a\u0001", "\u00e9", '"', "\\", "\U0001f600", "\uffee", "0", "01", "Z"]
    keys = [[rng.choice(texts) for _ in range(rng.randrange(4))] for _ in range(400)]
    df = spark.createDataFrame([(k,) for k in keys], "k array<string>")
    told = lambda k: [x.encode() for x in k]
    for n in (1, 2, 3, 7, 8, 100):
        bounds = sorted({tuple(k) for k in keys[:n]}, key=told)
        got = df.select("k", order._range_of(F.col("k"), [list(b) for b in bounds]).alias("at")).collect()
        assert all(r["at"] == bisect.bisect_right([told(b) for b in bounds], told(r["k"])) for r in got)
    monkeypatch.setattr(order, "ROWS", 30)
    plan = Q.QUERIES["natural_sort_all"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # The key is told where its name is read, not once more for each bound.
    assert plan.count("regexp_extract_all") == 2 and "filter(" not in plan


def test_natural_sort_of_all_rows(spark, duck, monkeypatch):
    from fotolith.operators import order

    monkeypatch.setattr(order, "ROWS", 30)  # many ranges
    got = Q.QUERIES["natural_sort_all"](spark, SF)
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(duck.sql(Q.ORACLE["natural_sort_all"]).fetchall())
    assert got.count() == 2 * spark.read.parquet(f"{SF}/part.parquet").count()


@pytest.mark.parametrize("name", sorted(n for n in Q.ORACLE if not n.startswith(("px_", "mask_"))))
def test_query_equals_sql(spark, duck, name):
    got = Q.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({Q.ORACLE[name]})").fetchall()
    rows = [tuple(r) for r in got.select(*columns).collect()]
    key = lambda r: tuple(map(repr, map(plain, r)))
    assert sorted(map(key, rows)) == sorted(key(r) for r in want)


def test_sources(spark, tmp_path):
    from fotolith.sources import files, sidecars

    for name in ("a/DSC_10.NEF", "a/dsc_2.nef", "a/note.txt", ".hidden/x.nef", "a/.y.nef"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"raw " + name.encode())
    got = files.walk(spark, str(tmp_path), ["nef"], content=True)
    assert [r.path.rpartition("/")[2] for r in files.listing(got, f"{tmp_path}/a").collect()] == ["dsc_2.nef", "DSC_10.NEF"]
    df = spark.createDataFrame([(4, 0, 1, ["a & b", "c"]), (0, -1, 0, []), (0, 0, 0, [])], "rating int, flag int, label int, names array<string>")
    packets = df.select(sidecars.packet(F.col("rating"), F.col("flag"), F.col("label"), F.col("names")).alias("t"))
    back = packets.select(sidecars.marks(F.col("t")).alias("m"), sidecars.keywords(F.col("t")).alias("k"), "t").collect()
    assert tuple(back[0].m) == (4, 0, 1) and back[0].k == ["a & b", "c"] and tuple(back[1].m) == (0, -1, 0) and back[2].t is None
