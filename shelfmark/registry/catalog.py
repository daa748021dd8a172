"""Registered catalog, reconciliation and library queries.

Documents stand for files of an archive; ``labels`` for a manifest that names
some of them by path, some only by content, and some twice.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions.text import suffix
from shelfmark.operators.catalog import (
    IMAGE_EXTENSIONS, archive_profile, build_catalog, by_hash, catalog_summary, first_by_hash,
    frequency, item_view, library, library_page, missing_files, neighbours, orphan_files,
    reconcile_paths, reconciliation_counts, repeated_rows, with_provenance, with_records,
    year_frequency,
)
from shelfmark.operators.people import people_index, people_roster, unplaced_counts
from shelfmark.operators.duplicates import exact_members
from shelfmark.registry import base

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _relative(shift=""):
    return F.concat(
        F.when(F.pmod("pos", F.lit(9)) == 0, "misc").otherwise(
            (F.lit(2015) + F.pmod("pos", F.lit(8))).cast("string")),
        F.lit("/"), F.format_string("%02d", F.pmod("pos", F.lit(12)) + 1), F.lit(shift),
        F.lit("/"), F.format_string("doc-%08d", "pos"),
        F.when(F.pmod("pos", F.lit(4)) == 0, ".JPG").when(F.pmod("pos", F.lit(4)) == 1, ".png")
        .when(F.pmod("pos", F.lit(4)) == 2, ".heic").otherwise(".txt"))


def _files(spark, sf):
    """Files with a picture's extension: path, relative path, length, hash, readability."""
    rows = base.documents(spark, sf).select(
        "pos", F.concat(F.lit("/archive/"), _relative()).alias("path"),
        _relative().alias("relative_path"), F.sha2("text", 256).alias("sha256"),
        F.octet_length("text").cast("long").alias("length"),
        (F.pmod("pos", F.lit(14)) != 0).alias("readable"),
        (F.pmod("pos", F.lit(6)) != 2).alias("has_exif"),
        F.when(F.pmod("pos", F.lit(10)) < 6, F.format_string(
            "20%02d:%02d:15 10:00:00", F.pmod("pos", F.lit(20)), F.pmod("pos", F.lit(12)) + 1))
        .otherwise(F.when(F.pmod("pos", F.lit(10)) == 6, "0000:00:00 00:00:00").otherwise(""))
        .alias("best_exif_date"))
    return rows.filter(suffix(F.col("path")).isin(IMAGE_EXTENSIONS)).withColumn(
        "exif_datetime_original", F.col("best_exif_date"))


def _manifest(spark, sf):
    docs = base.documents(spark, sf)
    listed = base.load(spark, sf, "labels").join(
        docs.select("pos", "text"), F.col("doc_id") == F.col("pos"))
    rows = listed.select(
        F.col("pos").alias("row_no"),
        F.when((F.col("quality") == 1) & (F.pmod("pos", F.lit(5)) != 1),
               F.concat(F.lit("/archive//"), _relative("/."))).otherwise(
            F.when(F.pmod("pos", F.lit(5)) == 1, F.concat(F.lit("/old/"), F.col("pos")))
            .otherwise("")).alias("downloaded_path"),
        F.when(F.col("toxic") == 0, F.upper(F.sha2("text", 256))).otherwise("").alias("sha256"),
        F.concat(F.lit("note "), F.col("pos")).alias("subject"),
        F.concat(F.lit("th"), F.floor(F.col("pos") / 3).cast("string")).alias("thread_id"))
    again = rows.filter(F.pmod("row_no", F.lit(10)) == 0).withColumns({
        "row_no": F.col("row_no") + 100_000_000, "subject": F.lit("later")})
    return rows.unionByName(again)


_SQL_FILES = f"""{base.SQL_DOCS},
rel AS (SELECT *, CASE WHEN pos % 9 = 0 THEN 'misc' ELSE (2015 + pos % 8)::VARCHAR END AS y,
  lpad((pos % 12 + 1)::VARCHAR, 2, '0') AS m, path || CASE pos % 4 WHEN 0 THEN '.JPG'
  WHEN 1 THEN '.png' WHEN 2 THEN '.heic' ELSE '.txt' END AS f FROM docs),
files AS (SELECT pos, '/archive/' || y || '/' || m || '/' || f AS path,
  y || '/' || m || '/' || f AS relative_path, y, m, f, sha256(text) AS sha256,
  octet_length(encode(text))::BIGINT AS length, pos % 14 <> 0 AS readable, pos % 6 <> 2 AS has_exif,
  CASE WHEN pos % 10 < 6 THEN '20' || lpad((pos % 20)::VARCHAR, 2, '0') || ':' || m
    || ':15 10:00:00' WHEN pos % 10 = 6 THEN '0000:00:00 00:00:00' ELSE '' END AS taken
  FROM rel WHERE pos % 4 <> 3),
man0 AS (SELECT pos AS row_no, CASE WHEN quality = 1 AND pos % 5 <> 1
    THEN '/archive//' || y || '/' || m || '/./' || f
    WHEN pos % 5 = 1 THEN '/old/' || pos ELSE '' END AS downloaded_path,
  CASE WHEN toxic = 0 THEN upper(sha256(text)) ELSE '' END AS sha256, 'note ' || pos AS subject,
  'th' || (pos // 3) AS thread_id FROM labels JOIN rel ON doc_id = pos),
man AS (SELECT *, regexp_replace(regexp_replace(trim(downloaded_path), '/(\\./)+', '/', 'g'),
    '/{{2,}}', '/', 'g') AS key, lower(trim(sha256)) AS sha
  FROM (SELECT * FROM man0 UNION ALL SELECT row_no + 100000000, downloaded_path, sha256, 'later',
    thread_id FROM man0 WHERE row_no % 10 = 0)),
mp AS (SELECT * FROM man WHERE key <> '' QUALIFY row_number() OVER
  (PARTITION BY key ORDER BY row_no DESC) = 1),
ms AS (SELECT * FROM man WHERE sha <> '' QUALIFY row_number() OVER
  (PARTITION BY sha ORDER BY row_no DESC) = 1),
prov AS (SELECT f.*, coalesce(p.row_no, s.row_no) AS row_no,
    CASE WHEN p.row_no IS NOT NULL THEN p.sha256 WHEN s.row_no IS NOT NULL THEN s.sha256
      ELSE f.sha256 END AS out_sha,
    CASE WHEN coalesce(p.row_no, s.row_no) IS NULL THEN 'UNTRACKED' ELSE 'MANIFEST' END AS status,
    CASE WHEN p.row_no IS NOT NULL THEN p.subject ELSE coalesce(s.subject, '') END AS subject,
    CASE WHEN p.row_no IS NOT NULL THEN p.thread_id ELSE coalesce(s.thread_id, '') END AS thread_id
  FROM files f LEFT JOIN mp p ON p.key = f.path
  LEFT JOIN ms s ON p.row_no IS NULL AND s.sha = f.sha256),
orph AS (SELECT f.path, f.sha256, CASE WHEN EXISTS (SELECT 1 FROM man WHERE sha = f.sha256)
    THEN 'HASH_EXISTS_IN_MANIFEST' ELSE 'NO_MANIFEST_RECORD' END AS status
  FROM files f WHERE NOT EXISTS (SELECT 1 FROM man WHERE key = f.path)),
gone AS (SELECT m.* FROM man m WHERE key <> '' AND NOT EXISTS (SELECT 1 FROM files f
    WHERE f.path = m.key) AND NOT EXISTS (SELECT 1 FROM orph o
    WHERE o.status = 'HASH_EXISTS_IN_MANIFEST' AND o.sha256 = m.sha))"""
_HEAD = f"WITH {_SQL_FILES} "


def _both(spark, sf):
    return _files(spark, sf), _manifest(spark, sf)


QUERIES["catalog_provenance"] = lambda spark, sf: with_provenance(*_both(spark, sf)).select(
    "path", "sha256", "provenance_status", "subject", "thread_id")
ORACLE["catalog_provenance"] = _HEAD + (
    "SELECT path, out_sha AS sha256, status AS provenance_status, subject, thread_id FROM prov")
QUERIES["catalog_build"] = lambda spark, sf: build_catalog(
    _files(spark, sf).drop("pos"), _manifest(spark, sf)).select(
        "pos", "path", "image_id", "filename", "extension", "directory_year", "directory_month")
ORACLE["catalog_build"] = _HEAD + """SELECT row_number() OVER (ORDER BY path) - 1 AS pos, path,
  out_sha AS image_id, f AS filename, lower(regexp_extract(f, '(\\.[^.]+)$', 1)) AS extension,
  y AS directory_year, m AS directory_month FROM prov"""
QUERIES["catalog_summary"] = lambda spark, sf: catalog_summary(with_provenance(*_both(spark, sf)))
ORACLE["catalog_summary"] = _HEAD + """SELECT count(*) AS records,
  count(*) FILTER (status = 'MANIFEST') AS manifest,
  count(*) FILTER (status = 'UNTRACKED') AS untracked,
  count(*) FILTER (taken <> '') AS with_original_date FROM prov"""
QUERIES["reconcile"] = lambda spark, sf: reconciliation_counts(*_both(spark, sf))
ORACLE["reconcile"] = _HEAD + """SELECT (SELECT count(*) FROM files) AS files,
  (SELECT count(DISTINCT key) FROM man WHERE key <> '') AS listed,
  (SELECT count(*) FROM files WHERE path IN (SELECT key FROM man)) AS matched,
  (SELECT count(*) FROM files WHERE path NOT IN (SELECT key FROM man)) AS files_only,
  (SELECT count(DISTINCT key) FROM man WHERE key <> '' AND key NOT IN (SELECT path FROM files))
    AS manifest_only,
  (SELECT count(*) FROM (SELECT key FROM man WHERE key <> '' GROUP BY key HAVING count(*) > 1))
    AS repeated_paths,
  (SELECT count(*) FROM orph WHERE status = 'NO_MANIFEST_RECORD') AS untracked,
  (SELECT count(*) FROM orph WHERE status = 'HASH_EXISTS_IN_MANIFEST') AS hash_represented,
  (SELECT count(*) FROM gone) AS missing,
  (SELECT count(*) FROM (SELECT sha FROM man WHERE sha <> '' GROUP BY sha HAVING count(*) > 1))
    AS repeated_hashes"""
QUERIES["reconcile_paths"] = lambda spark, sf: reconcile_paths(*_both(spark, sf))
ORACLE["reconcile_paths"] = _HEAD + """SELECT key, f.path IS NOT NULL AS on_disk,
  coalesce(n, 0) AS listed FROM (SELECT coalesce(f.path, m.key) AS key, m.n, f.path
  FROM (SELECT DISTINCT path FROM files) f FULL JOIN (SELECT key, count(*) AS n FROM man
  WHERE key <> '' GROUP BY key) m ON m.key = f.path) f"""
QUERIES["reconcile_orphans"] = lambda spark, sf: orphan_files(*_both(spark, sf))
ORACLE["reconcile_orphans"] = _HEAD + "SELECT path, sha256, status FROM orph"
QUERIES["reconcile_missing"] = lambda spark, sf: missing_files(*_both(spark, sf)).select(
    "row_no", "downloaded_path", "sha256", "subject")
ORACLE["reconcile_missing"] = _HEAD + "SELECT row_no, downloaded_path, sha256, subject FROM gone"
QUERIES["manifest_repeats"] = lambda spark, sf: repeated_rows(
    _manifest(spark, sf), F.lower(F.trim("sha256")))
ORACLE["manifest_repeats"] = _HEAD + (
    "SELECT sha AS key, count(*) AS copies FROM man WHERE sha <> '' GROUP BY sha "
    "HAVING count(*) > 1")
QUERIES["archive_profile"] = lambda spark, sf: archive_profile(_files(spark, sf)).withColumn(
    "exif_pct", F.round("exif_pct", 6))
ORACLE["archive_profile"] = _HEAD + """SELECT count(*) AS files, sum(length)::BIGINT AS bytes,
  count(*) FILTER (readable) AS readable, count(*) FILTER (NOT readable) AS unreadable,
  count(*) FILTER (readable AND has_exif) AS with_exif,
  round(count(*) FILTER (readable AND has_exif) * 100.0 / count(*), 6)::DOUBLE AS exif_pct
  FROM files"""
QUERIES["archive_formats"] = lambda spark, sf: frequency(
    _files(spark, sf), suffix(F.col("path")), "extension")
ORACLE["archive_formats"] = _HEAD + (
    "SELECT lower(regexp_extract(f, '(\\.[^.]+)$', 1)) AS extension, count(*) AS n "
    "FROM files GROUP BY 1")
QUERIES["archive_years"] = lambda spark, sf: year_frequency(_files(spark, sf))
ORACLE["archive_years"] = _HEAD + (
    "SELECT y AS year, count(*) AS n FROM files WHERE y <> 'misc' GROUP BY 1")


# -- library -------------------------------------------------------------------

def _items(spark, sf):
    """Library rows of the files; captions by conversation, thumbnails by page."""
    files = _files(spark, sf).withColumn("filename", F.element_at(F.split("path", "/"), -1))
    at = files.select(F.col("pos").alias("doc"), "path")
    captions = base.load(spark, sf, "conversations").join(
        at, F.col("conv_id") == F.col("doc")).select(
        F.col("turn").alias("row_no"), "path", F.col("text").alias("caption"))
    thumbs = base.load(spark, sf, "pages").join(at, F.col("page_id") == F.col("doc")).select(
        F.col("page_id").alias("row_no"), "path",
        F.when(F.pmod("page_id", F.lit(5)) != 0, F.lit(400)).alias("grid_width"),
        F.lit(300).alias("grid_height"), F.lit(1600).alias("lightbox_width"),
        F.when(F.pmod("page_id", F.lit(3)) != 0, F.lit(1200)).alias("lightbox_height"))
    return library(files, captions, thumbs)


_SQL_ITEMS = _HEAD + """,
cap AS (SELECT conv_id AS pos, text AS caption FROM conversations QUALIFY row_number() OVER
  (PARTITION BY conv_id ORDER BY turn DESC) = 1),
items AS (SELECT f.pos, f.path, f.f AS filename, f.sha256, coalesce(c.caption, '') AS caption,
  CASE WHEN taken <> '' AND taken NOT LIKE '0000%' THEN strftime(strptime(taken,
    '%Y:%m:%d %H:%M:%S'), '%Y-%m-%dT%H:%M:%S') END AS captured,
  CASE WHEN page_id % 5 <> 0 THEN '400x300' END AS grid,
  CASE WHEN page_id % 3 <> 0 THEN '1600x1200' END AS lightbox
  FROM files f LEFT JOIN cap c USING (pos) LEFT JOIN pages p ON p.page_id = f.pos)"""


def _size(column):
    return F.when(F.col(column).isNotNull(), F.concat_ws(
        "x", F.col(f"{column}.width").cast("string"), F.col(f"{column}.height").cast("string")))


def _shown(items, *extra):
    return items.withColumns({"grid": _size("grid"), "lightbox": _size("lightbox")}).select(
        "pos", "path", "sha256", "filename", "caption", "captured", "grid", "lightbox", *extra)


_ITEM_COLUMNS = "pos, path, sha256, filename, caption, captured, grid, lightbox"
QUERIES["library_join"] = lambda spark, sf: _shown(_items(spark, sf))
ORACLE["library_join"] = _SQL_ITEMS + f" SELECT {_ITEM_COLUMNS} FROM items"
QUERIES["library_page"] = lambda spark, sf: _shown(
    library_page(_items(spark, sf), 40, 60), "total")
ORACLE["library_page"] = _SQL_ITEMS + (
    f" SELECT {_ITEM_COLUMNS}, (SELECT count(*) FROM items) AS total FROM items "
    "QUALIFY row_number() OVER (ORDER BY pos) BETWEEN 41 AND 100")
QUERIES["library_first_by_hash"] = lambda spark, sf: first_by_hash(_items(spark, sf)).select(
    "sha256", "pos", "path")
ORACLE["library_first_by_hash"] = _SQL_ITEMS + (
    " SELECT sha256, pos, path FROM items QUALIFY row_number() OVER "
    "(PARTITION BY sha256 ORDER BY pos) = 1")
QUERIES["library_neighbours"] = lambda spark, sf: neighbours(
    _items(spark, sf), _items(spark, sf).filter("captured IS NOT NULL"), 2)
ORACLE["library_neighbours"] = _SQL_ITEMS + (
    ", placed AS (SELECT *, row_number() OVER (ORDER BY pos) AS place FROM items) "
    'SELECT a.sha256, (b.place - a.place)::INT AS "offset", b.pos, b.path FROM placed a '
    "JOIN placed b ON b.place BETWEEN a.place - 2 AND a.place + 2 WHERE a.captured IS NOT NULL")


def _labelled_paths(spark, sf):
    return base.load(spark, sf, "labels").select(
        F.col("doc_id").alias("mark"), F.concat(F.lit("/archive/"), _relative_of("doc_id"))
        .alias("path"))


def _relative_of(column):
    return F.concat(
        F.when(F.pmod(column, F.lit(9)) == 0, "misc").otherwise(
            (F.lit(2015) + F.pmod(column, F.lit(8))).cast("string")),
        F.lit("/"), F.format_string("%02d", F.pmod(column, F.lit(12)) + 1), F.lit("/"),
        F.format_string("doc-%08d", column),
        F.when(F.pmod(column, F.lit(4)) == 0, ".JPG").when(F.pmod(column, F.lit(4)) == 1, ".png")
        .when(F.pmod(column, F.lit(4)) == 2, ".heic").otherwise(".txt"))


QUERIES["library_records"] = lambda spark, sf: with_records(
    _labelled_paths(spark, sf), _items(spark, sf)).select(
        "mark", "path", "sha256", "filename", "caption", "captured")
_SQL_MARKS = _SQL_ITEMS + """, marks AS (SELECT doc_id AS mark, '/archive/' || y || '/' || m || '/' || f
  AS path, f FROM labels JOIN rel ON pos = doc_id)"""
ORACLE["library_records"] = _SQL_MARKS + """
SELECT mark, path, sha256, f AS filename, coalesce(caption, '') AS caption, captured
FROM marks LEFT JOIN items USING (path)"""
QUERIES["library_by_hash"] = lambda spark, sf: by_hash(
    _labelled_paths(spark, sf), _items(spark, sf)).select("mark", "sha256")
ORACLE["library_by_hash"] = _SQL_MARKS + " SELECT mark, sha256 FROM marks JOIN items USING (path)"


def _view(spark, sf):
    items = base.documents(spark, sf).select(
        "pos", "path", F.sha2("text", 256).alias("sha256"), F.col("lang").alias("filename"))
    faces = base.faces(spark, sf)
    index = people_index(faces, base.labels(spark, sf))
    trips = base.source_events(spark, sf).filter("event_id <> 'event-001'")
    known = trips.groupBy("event_id").agg(
        F.min("name").alias("name"), F.min("start").alias("start"),
        F.min("start").alias("end"), F.count_distinct("path").alias("images"))
    groups = exact_members(items).join(items.select("pos", "path"), "pos").select(
        "path", F.lit("EXACT").alias("tier"), F.col("lead").cast("string").alias("group"))
    view = item_view(items, index, people_roster(index), unplaced_counts(faces), known,
                     trips.select("event_id", "path"), groups)
    return view.select(
        "sha256", "pos", "path",
        F.array_join(F.transform("people", lambda p: F.concat_ws(
            "/", p["name"], p["images"].cast("string"), p["faces"].cast("string"))), ",")
        .alias("people"),
        "unplaced", F.col("event.event_id").alias("event_id"),
        F.col("event.images").alias("event_images"), "tier", "group")


QUERIES["item_view"] = _view
ORACLE["item_view"] = f"""WITH {base.SQL_FACES}, {base.SQL_EVENTS},
idx AS (SELECT name, path, face_id FROM faces JOIN labelled USING (face_id)),
ros AS (SELECT name, count(DISTINCT path) AS images, count(*) AS faces FROM idx GROUP BY name),
ppl AS (SELECT path, string_agg(name || '/' || images || '/' || faces, ',' ORDER BY name) AS people
  FROM (SELECT DISTINCT name, path FROM idx) JOIN ros USING (name) GROUP BY path),
unp AS (SELECT path, count(*) AS unplaced FROM faces WHERE cluster = 'unassigned' GROUP BY path),
evt AS (SELECT event_id, count(DISTINCT path) AS images FROM source_events GROUP BY event_id),
items AS (SELECT *, sha256(text) AS sha FROM docs),
dup AS (SELECT sha, min(pos) AS lead FROM items GROUP BY sha HAVING count(*) > 1),
firsts AS (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY sha ORDER BY pos) = 1)
SELECT f.sha AS sha256, f.pos, f.path, coalesce(people, '') AS people,
  coalesce(unplaced, 0) AS unplaced, e.event_id, e.images AS event_images,
  CASE WHEN d.sha IS NOT NULL THEN 'EXACT' END AS tier, d.lead::VARCHAR AS "group"
FROM firsts f LEFT JOIN ppl USING (path) LEFT JOIN unp USING (path)
LEFT JOIN source_events s ON s.path = f.path AND s.event_id <> 'event-001'
LEFT JOIN evt e ON e.event_id = s.event_id LEFT JOIN dup d ON d.sha = f.sha"""
