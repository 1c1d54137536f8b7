"""The logical tables of a library as SQL for the oracle, to be put before a query."""

from __future__ import annotations

PHOTOS = """photos AS (SELECT o_orderkey AS id, (epoch_us(o_orderdate) // 1000) AS created_at_ms, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE 1 END AS metadata_version,
 CASE WHEN o_orderkey % 13 = 5 THEN NULL ELSE strftime(o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)), '%Y-%m-%dT%H:%M:%S') END AS captured_at,
 CASE o_orderkey % 3 WHEN 0 THEN 'NIKON CORPORATION' WHEN 1 THEN 'Canon' END AS camera_make,
 CASE o_orderkey % 3 WHEN 0 THEN 'Z 6' WHEN 1 THEN 'Canon EOS R5' ELSE 'Phone X' END AS camera_model,
 CASE WHEN o_orderkey % 4 = 0 THEN 'NIKKOR Z 24-70mm f/4 S' END AS lens, 100 * (1 + o_orderkey % 8) AS iso, 1.4::DOUBLE + o_orderkey % 5 AS aperture,
 1.0::DOUBLE / (50 + o_orderkey % 10) AS shutter, 24.0::DOUBLE + o_orderkey % 50 AS focal_length, 6000 AS width, 4000 AS height, (o_orderkey % 4) * 90 AS rotation,
 CASE WHEN o_orderkey % 6 = 0 THEN (o_orderkey % 90)::DOUBLE END AS latitude, CASE WHEN o_orderkey % 9 = 0 THEN (o_orderkey % 180)::DOUBLE END AS longitude,
 CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 5 + 1 ELSE 0 END AS rating,
 CASE WHEN o_orderkey % 7 = 0 THEN 1 WHEN o_orderkey % 17 = 0 THEN -1 ELSE 0 END AS flag,
 CASE WHEN o_orderkey % 11 = 0 THEN 1 + o_orderkey % 5 ELSE 0 END AS label,
 CASE WHEN o_orderkey % 20 = 0 THEN 'Trip ' || (o_orderkey % 100) END AS title, CASE WHEN o_orderkey % 30 = 0 THEN o_orderpriority END AS caption FROM orders)"""
FILES = """files AS (SELECT o_orderkey AS id, o_orderkey AS photo_id, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS folder_id,
 dir || '/DSC_' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') || '.NEF' AS path, dir, 20000000 + o_orderkey AS size, (epoch_us(o_orderdate) // 1000) * 1000000 AS modified_ns,
 o_orderkey * 7919 AS fingerprint, o_orderstatus = 'P' AS missing, 1 AS last_seen_scan FROM (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN '/lib/Archive' ELSE '/lib/Photos' END || '/' || year(o_orderdate) || '/' || n_name || '/Trip ' || o_custkey AS dir
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey))"""
EDITS = """edits AS (SELECT user_id AS photo_id, (epoch_us(ts) // 1000) AS updated_at_ms, value, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000) DESC, event_id DESC) AS nth FROM events) WHERE nth = 1)"""
KEYWORDS = """keywords AS (SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY p_name), photo_keywords AS (SELECT DISTINCT l_orderkey AS photo_id, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey)"""
ALBUMS = """albums AS (SELECT s_suppkey AS id, s_name AS name FROM supplier), album_photos AS (SELECT DISTINCT l_suppkey AS album_id, l_orderkey AS photo_id FROM lineitem)"""
BELOW = "CASE WHEN f.folder_id = 2 THEN substr(f.path, 6) ELSE substr(f.path, 6) END"
_NAME = "'/lib/Docs/' || coalesce(source, '') || '/' || coalesce(lang, '') || '/' || {} || doc_id || '.txt'"
SNAPSHOTS = f"""t0 AS (SELECT doc_id AS id, {_NAME.format("''")} AS path, strlen(coalesce(text, '')) AS size, doc_id * 1000 AS modified_ns, md5(coalesce(text, '')) AS fingerprint FROM documents),
t1 AS (SELECT {_NAME.format("CASE WHEN doc_id % 10 = 2 THEN 'moved-' ELSE '' END")} AS path, strlen(coalesce(text, '')) + CASE WHEN doc_id % 10 = 3 THEN 1 ELSE 0 END AS size,
 doc_id * 1000 + CASE WHEN doc_id % 10 = 3 THEN 1 ELSE 0 END AS modified_ns, CASE WHEN doc_id % 10 = 3 THEN md5(coalesce(text, '') || '!') ELSE md5(coalesce(text, '')) END AS fingerprint FROM documents WHERE doc_id % 10 <> 1)"""
BACKUPS = """backups AS (SELECT 'catalogue-' || lpad(CAST((epoch_us(ts) // 1000) AS VARCHAR), 13, '0') || '-' || event_id || '.sqlite' AS path, (epoch_us(ts) // 1000) AS taken_at_ms,
 CASE event_type WHEN 'error' THEN 'pre-upgrade' WHEN 'purchase' THEN 'manual' ELSE 'auto' END AS kind FROM events)"""
_AT = "embedding[CAST((x + {}) % 64 AS INT) + 1]::DOUBLE"
PIXELS = "pixels AS (SELECT vec_id // 64 AS image_id, CAST(vec_id % 64 AS INT) AS y, CAST(x AS INT) AS x, " + ", ".join(f"round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.4::DOUBLE + 0.5::DOUBLE * {_AT.format(k)})), 6) AS {c}" for k, c in enumerate("rgb")) + " FROM embeddings, range(0, 64) t(x))"


def with_tables(*tables: str, body: str) -> str:
    return f"WITH {', '.join(tables)} {body}"
