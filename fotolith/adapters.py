"""A photo library as plain projections of the star-schema test tables, so that the catalogue's operators have data to run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The wall clock of all queries, so that results are the same at any time: 1998-08-02 UTC.
NOW_MS = 902016000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Library:
    """The logical tables of one library."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _read(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def photos(self) -> DataFrame:
        return self._read("orders").selectExpr(
            "o_orderkey AS id",
            "timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', o_orderdate) AS created_at_ms",
            "IF(o_orderkey % 10 = 0, 0, 1) AS metadata_version",
            "IF(o_orderkey % 13 = 5, NULL, date_format(o_orderdate + make_interval(0, 0, 0, 0, cast(o_orderkey % 24 AS int), 0, 0), \"yyyy-MM-dd'T'HH:mm:ss\")) AS captured_at",
            "CASE o_orderkey % 3 WHEN 0 THEN 'NIKON CORPORATION' WHEN 1 THEN 'Canon' END AS camera_make",
            "CASE o_orderkey % 3 WHEN 0 THEN 'Z 6' WHEN 1 THEN 'Canon EOS R5' ELSE 'Phone X' END AS camera_model",
            "IF(o_orderkey % 4 = 0, 'NIKKOR Z 24-70mm f/4 S', NULL) AS lens",
            "cast(100 * (1 + o_orderkey % 8) AS bigint) AS iso",
            "1.4D + o_orderkey % 5 AS aperture",
            "1.0D / (50 + o_orderkey % 10) AS shutter",
            "24.0D + o_orderkey % 50 AS focal_length",
            "6000L AS width",
            "4000L AS height",
            "(o_orderkey % 4) * 90 AS rotation",
            "IF(o_orderkey % 6 = 0, cast(o_orderkey % 90 AS double), NULL) AS latitude",
            "IF(o_orderkey % 9 = 0, cast(o_orderkey % 180 AS double), NULL) AS longitude",
            "IF(o_orderkey % 4 = 0, o_orderkey % 5 + 1, 0L) AS rating",
            "CASE WHEN o_orderkey % 7 = 0 THEN 1 WHEN o_orderkey % 17 = 0 THEN -1 ELSE 0 END AS flag",
            "IF(o_orderkey % 11 = 0, 1 + o_orderkey % 5, 0L) AS label",
            "IF(o_orderkey % 20 = 0, concat('Trip ', o_orderkey % 100), NULL) AS title",
            "IF(o_orderkey % 30 = 0, o_orderpriority, NULL) AS caption",
        )

    def folders(self) -> DataFrame:
        return self.spark.createDataFrame([(1, "/lib/Photos", 0), (2, "/lib/Archive", 0)], "id long, path string, added_at_ms long")

    def files(self) -> DataFrame:
        orders = self._read("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
        places = orders.join(self._read("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        places = places.join(F.broadcast(self._read("nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows by its schema
        held = places.withColumn("dir", F.expr("concat(IF(o_orderkey % 5 = 0, '/lib/Archive', '/lib/Photos'), '/', year(o_orderdate), '/', n_name, '/Trip ', o_custkey)"))
        return held.selectExpr(
            "o_orderkey AS id",
            "o_orderkey AS photo_id",
            "IF(o_orderkey % 5 = 0, 2L, 1L) AS folder_id",
            "concat(dir, '/DSC_', lpad(cast(o_orderkey % 100000 AS string), 5, '0'), '.NEF') AS path",
            "dir",
            "20000000 + o_orderkey AS size",
            "timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', o_orderdate) * 1000000 AS modified_ns",
            "o_orderkey * 7919 AS fingerprint",
            "o_orderstatus = 'P' AS missing",
            "1L AS last_seen_scan",
        )

    def edit_events(self) -> DataFrame:
        return self._read("events").selectExpr("event_id", "user_id AS photo_id", "timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) AS updated_at_ms", "value", "event_type", "ts")

    def edits(self) -> DataFrame:
        """The saved edit of each photo: the latest event's."""
        last = F.max_by(F.struct("updated_at_ms", "value", "event_type"), F.struct("updated_at_ms", "event_id"))
        return self.edit_events().groupBy("photo_id").agg(last.alias("e")).select("photo_id", "e.updated_at_ms", F.col("e.value").alias("value"), F.col("e.event_type").alias("event_type"))

    def albums(self) -> DataFrame:
        return self._read("supplier").selectExpr("s_suppkey AS id", "s_name AS name")

    def album_photos(self) -> DataFrame:
        return self._read("lineitem").selectExpr("l_suppkey AS album_id", "l_orderkey AS photo_id").distinct()

    def keywords(self) -> DataFrame:
        """A row for each distinct part name, numbered by name; part names are a small fixed vocabulary."""
        return self._read("part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))

    def photo_keywords(self) -> DataFrame:
        named = self._read("part").select("p_partkey", F.col("p_name").alias("name"))
        links = self._read("lineitem").select("l_orderkey", "l_partkey").join(named, F.col("l_partkey") == F.col("p_partkey"))
        return links.select(F.col("l_orderkey").alias("photo_id"), "name").distinct()

    def snapshot(self, later: bool) -> DataFrame:
        """Files of a folder at two times; the later one lacks some, and has others renamed or edited."""
        docs = self._read("documents").selectExpr("doc_id", "coalesce(source, '') AS source", "coalesce(lang, '') AS lang", "coalesce(text, '') AS text")
        name = "concat('/lib/Docs/', source, '/', lang, '/', {}, doc_id, '.txt')"
        if not later:
            return docs.selectExpr("doc_id AS id", name.format("''") + " AS path", "cast(octet_length(text) AS bigint) AS size", "doc_id * 1000 AS modified_ns", "md5(cast(text AS binary)) AS fingerprint")
        kept = docs.filter("doc_id % 10 <> 1")
        return kept.selectExpr(
            name.format("IF(doc_id % 10 = 2, 'moved-', '')") + " AS path",
            "cast(octet_length(text) AS bigint) + IF(doc_id % 10 = 3, 1L, 0L) AS size",
            "doc_id * 1000 + IF(doc_id % 10 = 3, 1L, 0L) AS modified_ns",
            "IF(doc_id % 10 = 3, md5(cast(concat(text, '!') AS binary)), md5(cast(text AS binary))) AS fingerprint",
        )

    def backups(self) -> DataFrame:
        return self._read("events").selectExpr(
            "concat('catalogue-', lpad(cast(timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) AS string), 13, '0'), '-', event_id, '.sqlite') AS path",
            "timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) AS taken_at_ms",
            "CASE event_type WHEN 'error' THEN 'pre-upgrade' WHEN 'purchase' THEN 'manual' ELSE 'auto' END AS kind",
        )

    def pixels(self) -> DataFrame:
        """Images of 64 by 64 linear RGB values, from rows of embeddings: image_id, y, x, r, g, b."""
        rows = self._read("embeddings").select((F.col("vec_id").cast("long")).alias("vec_id"), F.posexplode("embedding").alias("x", "e"), "embedding")
        at = "cast(element_at(embedding, cast((x + {}) % 64 + 1 AS int)) AS double)"
        unit = "round(least(1.0D, greatest(0.0D, 0.4D + 0.5D * {})), 6)"
        return rows.selectExpr("vec_id div 64 AS image_id", "cast(vec_id % 64 AS int) AS y", "x", *(unit.format(at.format(k)) + f" AS {c}" for k, c in enumerate("rgb")))
