"""Sidecars, keyword links, streams, folders and pixel queries."""

import duckdb
import pytest
from pyspark.sql import functions as F

import fotolith.queries as Q
from fotolith.functions.fingerprint import file_fingerprint, fingerprint
from fotolith.operators import changes
from fotolith.plans import colour as C
from fotolith.plans import geometry as G
from fotolith.sources import files, sidecars
from fotolith.streaming.latest import index_stream, latest_by_key

SF = "/root/testdata/sf0.001"
THEIRS = """<x:xmpmeta xmlns:x="adobe:ns:meta/" x:xmptk="Shelf 7.1">
 <rdf:RDF>
  <rdf:Description rdf:about="uuid:44aa"
    xmlns:shelf="urn:example:shelf" xmlns:xmp="http://ns.adobe.com/xap/1.0/"
   shelf:Rating="low"
   xmp:Rating="4">
   <xmp:Label>Yellow</xmp:Label>
  </rdf:Description>
 </rdf:RDF>
</x:xmpmeta>
"""
TREE = """<rdf:Description xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:lr="http://ns.adobe.com/lightroom/1.0/">
   <dc:subject>
    <rdf:Bag>
     <rdf:li>Lighthouse</rdf:li>
     <rdf:li>Salt &amp; fog</rdf:li>
    </rdf:Bag>
   </dc:subject>
   <lr:hierarchicalSubject>
    <rdf:Bag>
     <rdf:li>Coast|Buildings|Towers|Lighthouse</rdf:li>
     <rdf:li>Salt &amp; fog</rdf:li>
    </rdf:Bag>
   </lr:hierarchicalSubject>
  </rdf:Description>
"""


def updated(spark, text, rating=0, flag=0, label=0, names=(), match=None):
    rows = spark.createDataFrame([(text, rating, flag, label, list(names))], "text string, rating int, flag int, label int, names array<string>")
    r = sidecars.updated(rows, None if match is None else F.lit(match)).first()
    return r.action, r.new_text


def test_sidecars_of_other_programs(spark):
    m = spark.range(1).select(sidecars.marks(F.lit(THEIRS)).alias("m"), sidecars.keywords(F.lit(TREE)).alias("k")).first()
    assert tuple(m.m) == (4, 0, 2) and m.k == ["Lighthouse", "Salt & fog"]
    assert updated(spark, THEIRS, 4, 0, 2) == ("unchanged", None)
    action, text = updated(spark, THEIRS, 5, 0, 0)
    assert action == "written" and text == THEIRS.replace('\n   xmp:Rating="4"', "").replace("   <xmp:Label>Yellow</xmp:Label>\n", "").replace("<rdf:Description", '<rdf:Description xmp:Rating="5"')
    assert updated(spark, "<html/>", 3)[0] == "unreadable"
    action, text = updated(spark, TREE, names=["Lighthouse", "New $1"])
    assert "<rdf:li>New $1</rdf:li>" in text and "Salt" not in text and "Coast|Buildings|Towers|Lighthouse" in text
    assert "hierarchicalSubject" not in updated(spark, TREE, match=True)[1]
    own = updated(spark, None, 3, 0, 1, ["a & b"])[1]
    assert own.startswith("<?xpacket") and updated(spark, own, match=True) == ("deleted", None)


def test_sync_of_photos_with_one_path(spark, tmp_path):
    """Copies of the orders with keys 100,000 apart have the paths of the first ones, but sidecars of their own."""
    c = duckdb.connect()
    c.execute(f"COPY (SELECT t.* REPLACE (o_orderkey + 100000 * k AS o_orderkey) FROM '{SF}/orders.parquet' t, range(3) r(k)) TO '{tmp_path}/orders.parquet'")
    for t in ("customer", "nation"):
        c.execute(f"COPY (SELECT * FROM '{SF}/{t}.parquet') TO '{tmp_path}/{t}.parquet'")
    for t in ("orders", "customer", "nation"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = c.execute(f"SELECT path, action FROM ({Q.ORACLE['sidecar_sync']})").fetchall()
    assert len(want) > len({path for path, _ in want})
    assert sorted(map(tuple, Q.QUERIES["sidecar_sync"](spark, str(tmp_path)).select("path", "action").collect())) == sorted(want)


def test_keyword_links(spark):
    names = spark.createDataFrame([("Heron",)], "name string")
    links = spark.createDataFrame([(1, "Heron")], "photo_id long, name string")
    typed = spark.createDataFrame([(1, "heron"), (2, " HERON "), (2, "new"), (3, "New"), (3, "")], "photo_id long, name string")
    got = changes.link_keywords(names, links, typed)
    assert sorted(map(tuple, got.collect())) == [(1, "Heron"), (2, "Heron"), (2, "New"), (3, "New")]
    assert sorted(map(tuple, changes.unlink_keywords(got, typed.filter("photo_id = 2")).collect())) == [(1, "Heron"), (3, "New")]
    assert sorted(map(tuple, changes.import_keywords(names, links, typed).collect())) == [(1, "Heron"), (2, "Heron"), (2, "New"), (3, "New")]


def test_streams(spark, tmp_path):
    kind = "path string, size long, modified_ns long, fingerprint string"
    known = spark.createDataFrame([(1, "/a", 5, 1, "x"), (2, "/b", 6, 1, "y"), (3, "/c", 7, 1, "z")], "id long, " + kind)
    spark.createDataFrame([("/copy-of-a", 5, 2, "x"), ("/moved-c", 7, 2, "z"), ("/b", 6, 3, "y2")], kind).write.parquet(str(tmp_path / "in"))
    present = spark.createDataFrame([("/a",), ("/b",), ("/copy-of-a",), ("/moved-c",)], "path string")
    found = []
    q = index_stream(spark, spark.readStream.schema(kind).parquet(str(tmp_path / "in")), lambda: known, lambda: present, lambda df, n: found.extend(map(tuple, df.collect())), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert sorted(found, key=str) == sorted([(None, "/copy-of-a", "new", None), (3, "/moved-c", "moved", "/c"), (2, "/b", "changed", None)], key=str)
    events = spark.createDataFrame([(1, "2026-01-01 10:00:00", "a"), (1, "2026-01-01 10:30:00", "b"), (2, "2026-01-01 10:10:00", "c")], "id long, at string, what string").withColumn("at", F.to_timestamp("at"))
    assert sorted((r.id, r.what) for r in latest_by_key(events, "id", "at").collect()) == [(1, "b"), (2, "c")]


def test_walk_with_scheme_and_fingerprints(spark, tmp_path):
    for name in ("photos/a.nef", "photos/.hidden/b.nef", "photos/sub/c.NEF"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 200_000 + name.encode())
    for root in (str(tmp_path / "photos"), f"file://{tmp_path}/photos/", f"file:{tmp_path}/photos"):
        got = sorted(r.path.rpartition("photos")[2] for r in files.walk(spark, root, ["nef"]).collect())
        assert got == ["/a.nef", "/sub/c.NEF"]
    df = spark.createDataFrame([(b"",), (b"abc",), (bytes(range(256)) * 3,)], "c binary").withColumn("n", F.octet_length("c").cast("long"))
    assert df.filter(file_fingerprint(F.col("c"), F.col("n")) != fingerprint(F.col("c"), F.col("n"))).count() == 0
    long = bytes(range(256)) * 900
    h = 0xCBF29CE484222325
    for b in len(long).to_bytes(8, "little") + long[:65536] + long[-65536:]:
        h = (h ^ b) * 0x100000001B3 % 2**64
    got = spark.createDataFrame([(long,)], "c binary").select(file_fingerprint(F.col("c"), F.octet_length("c").cast("long"))).first()[0]
    assert got % 2**64 == h


def test_white_balance_and_crops(spark):
    import numpy as np

    one = np.array([1.0])
    k, d = C.light_at(one * C.D65[0], one * C.D65[1])
    assert 6400 < k[0] < 6600 and abs(d[0] - 0.003) < 0.001
    assert np.allclose(C.gains_at(k, d, k, d), 1)
    assert C.Curve.through([(0, 0), (float("nan"), 1), (0.5, 2), (0.504, 0.1), (1, 1)]).points == ((0, 0), (0.5, 1.0), (1, 1))
    assert G.effective_crop((0, 0, 1, 1), 600, 400) == (0, 0, 1, 1)
    x, y, w, h = G.effective_crop((0, 0, 1, 1), 600, 400, straighten=5)
    assert 0.8 < w < 0.95 and abs(x + w / 2 - 0.5) < 1e-6 and abs(w - h) < 1e-6
    assert G.after(G.inverse((1, True)), (1, True)) == (0, False)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(n for n in Q.ORACLE if n.startswith(("px_", "mask_"))))
def test_pixels_equal_sql(spark, duck, name):
    got = Q.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    keys = [c for c in ("image_id", "y", "x", "row", "col", "channel", "bin", "code") if c in columns]
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({Q.ORACLE[name]}) ORDER BY {', '.join(keys)}").fetchall()
    rows = [tuple(r) for r in got.select(*columns).orderBy(*keys).collect()]
    assert len(rows) == len(want)
    for a, b in zip(rows, want, strict=True):
        assert all(x is y or (x is not None and y is not None and (x == y if isinstance(x, str) else abs(float(x) - float(y)) < 2e-5)) for x, y in zip(a, b, strict=True)), (a, b)
