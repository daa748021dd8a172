"""Given tables written in every stored form and read back, and small rules over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfmark.functions.dates import age_seconds, capture_time
from shelfmark.operators.catalog import first_text
from shelfmark.operators.duplicates import keepers
from shelfmark.operators.ranking import largest
from shelfmark.registry import base
from shelfmark.session import checkpoint_root
from shelfmark.sources import tables

QUERIES: dict = {}
ORACLE: dict = {}


def _place(spark, name):
    return f"{checkpoint_root(spark)}/shelfmark/{name}-{uuid.uuid4().hex}"


def _csv(spark, sf):
    """Texts with commas, quotes and line ends through a headed CSV."""
    path = _place(spark, "csv")
    tables.write_csv(base.load(spark, sf, "documents").select("doc_id", "lang", "text"), path)
    back = tables.read_csv(spark, path, "doc_id BIGINT, lang STRING, text STRING")
    return back.select("doc_id", "lang", F.sha2("text", 256).alias("digest"))


QUERIES["source_csv"] = _csv
ORACLE["source_csv"] = "SELECT doc_id, lang, sha256(text) AS digest FROM documents"


def _optional(spark, sf):
    """Rows of a table that was written and of one that never was."""
    path, schema = _place(spark, "csv"), "o_orderkey BIGINT, o_orderstatus STRING"
    tables.write_csv(base.load(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), path)
    parts = []
    for name, place in (("written", path), ("never", _place(spark, "none"))):
        rows, there = tables.read_optional(spark, place, schema)
        parts.append(rows.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("name"), F.lit(there).alias("there"), "rows"))
    return parts[0].unionByName(parts[1])


QUERIES["source_optional"] = _optional
ORACLE["source_optional"] = """SELECT 'written' AS name, true AS there, count(*) AS rows FROM orders
UNION ALL SELECT 'never', false, 0"""


def _tables(spark, sf):
    """A table written anew, then appended to."""
    path, orders = _place(spark, "table"), base.load(spark, sf, "orders")
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    tables.write_table(orders.select(columns), path)
    tables.write_table(orders.filter("o_orderstatus = 'F'").select(columns), path)
    tables.append_table(orders.filter("o_orderstatus <> 'F'").select(columns), path)
    return spark.read.parquet(path)


QUERIES["source_tables"] = _tables
ORACLE["source_tables"] = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"


def _index(spark, sf):
    """A published vector index: its rows with the facts of its manifest."""
    path = _place(spark, "index")
    manifest = tables.publish_index(base.load(spark, sf, "embeddings").select(
        base.doc_path("vec_id").alias("path"), F.col("embedding").alias("vec")), path, "abc")
    stored = tables.read_index(spark, path)
    return stored.select("pos", "path", F.size("vec").alias("dimension")).join(
        F.broadcast(manifest.select("vectors", "fingerprint_chunk", "lookup_fingerprint",
                                    "source_sha256")))


QUERIES["source_index"] = _index
ORACLE["source_index"] = """WITH p AS (SELECT 'doc-' || lpad(vec_id::VARCHAR, 8, '0') AS path,
  len(embedding)::INT AS dimension FROM embeddings),
r AS (SELECT *, row_number() OVER (ORDER BY path) - 1 AS pos FROM p),
c AS (SELECT pos // 65536 AS c, count(*) AS n,
  sha256(string_agg(path, chr(10) ORDER BY pos) || chr(10)) AS d FROM r GROUP BY 1),
k AS (SELECT n, sha256(c || '|' || d) AS h FROM c),
s AS (SELECT sum(n)::BIGINT AS vectors, sum(('0x' || substr(h, 1, 15))::BIGINT) AS low,
  sum(('0x' || substr(h, 16, 15))::BIGINT) AS high FROM k)
SELECT pos, path, dimension, vectors, 65536 AS fingerprint_chunk,
  sha256(vectors || '|' || low || '|' || high) AS lookup_fingerprint, 'abc' AS source_sha256
FROM r, s"""


def _baseline(spark, sf):
    """Countries and their suppliers as a baseline; a country without any is kept."""
    path = _place(spark, "baseline")
    nations = base.load(spark, sf, "nation")
    rows = base.load(spark, sf, "supplier").filter("s_nationkey % 5 <> 0").join(
        nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("query"), F.col("s_name").alias("filename"))
    tables.write_baseline(rows, path, nations.select(F.col("n_name").alias("query")), "kept")
    return tables.read_baseline(spark, path)


QUERIES["source_baseline"] = _baseline
ORACLE["source_baseline"] = """SELECT n_name AS query, s_name AS filename FROM nation
LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_nationkey % 5 <> 0"""


def _files(spark, sf):
    """Files of a folder by type, with size and content hash: one file per source."""
    path = _place(spark, "files")
    base.load(spark, sf, "documents").groupBy("source").agg(
        F.min("text").alias("text")).write.partitionBy("source").text(path)
    listed = tables.list_files(spark, path, [".txt"])
    hashed = tables.hash_files(spark, path, [".txt"])
    return listed.join(hashed.drop("length"), "path").select(
        F.regexp_extract("relative_path", "source=([^/]*)", 1).alias("source"), "length", "sha256")


QUERIES["source_files"] = _files
ORACLE["source_files"] = """SELECT source, strlen(min(text)) + 1 AS length,
  sha256(min(text) || chr(10)) AS sha256 FROM documents GROUP BY source"""


def _largest_events(spark, sf):
    events = base.source_events(spark, sf).groupBy("event_id").agg(
        F.count_distinct("path").alias("images"))
    return largest(events, "images", "event_id", 5)


QUERIES["event_largest"] = _largest_events
ORACLE["event_largest"] = f"""WITH {base.SQL_DOCS}, {base.SQL_EVENTS},
e AS (SELECT event_id, count(DISTINCT path) AS images FROM source_events GROUP BY event_id),
r AS (SELECT *, row_number() OVER (ORDER BY images DESC, event_id)::INT AS place FROM e)
SELECT event_id, images, place FROM r WHERE place <= 5"""


def _largest_clusters(spark, sf):
    clusters = base.faces(spark, sf).groupBy("cluster").agg(F.count("*").alias("faces"))
    return largest(clusters, "faces", "cluster", 5)


QUERIES["cluster_largest"] = _largest_clusters
ORACLE["cluster_largest"] = f"""WITH {base.SQL_FACES},
c AS (SELECT cluster, count(*) AS faces FROM faces GROUP BY cluster),
r AS (SELECT *, row_number() OVER (ORDER BY faces DESC, cluster)::INT AS place FROM c)
SELECT cluster, faces, place FROM r WHERE place <= 5"""


# -- small expressions over whole tables ---------------------------------------

def _written_times(spark, sf):
    """Order dates as cameras write them: two layouts, zero, early, broken and absent ones."""
    key, day = F.pmod("o_orderkey", F.lit(8)), F.col("o_orderdate")
    text = (
        F.when(key == 0, F.date_format(day, "yyyy:MM:dd HH:mm:ss"))
        .when(key == 1, F.date_format(day, "yyyy-M-d H:m:s"))
        .when(key == 2, F.lit("0000:00:00 00:00:00"))
        .when(key == 3, F.date_format(day, "1985:MM:dd HH:mm:ss"))
        .when(key == 4, F.date_format(day, "yyyy:MM:dd"))
        .when(key == 5, F.lit("")).when(key == 6, F.date_format(day, "' 'yyyy:MM:dd 12:30:00"))
    )
    return base.load(spark, sf, "orders").select("o_orderkey", text.alias("written"))


def _capture_times(spark, sf):
    return _written_times(spark, sf).select("o_orderkey", F.date_format(
        capture_time(F.col("written"), 2030), "yyyy-MM-dd HH:mm:ss").alias("taken"))


QUERIES["capture_times"] = _capture_times
ORACLE["capture_times"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 8 IN (0, 1)
    THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
  WHEN o_orderkey % 8 = 6 THEN strftime(o_orderdate, '%Y-%m-%d 12:30:00') END AS taken
FROM orders"""
QUERIES["artifact_ages"] = lambda spark, sf: base.load(spark, sf, "orders").select(
    "o_orderkey", age_seconds(F.lit("2000-01-01 00:00:00").cast("timestamp"),
                              F.col("o_orderdate").cast("timestamp")).alias("age"))
ORACLE["artifact_ages"] = """SELECT o_orderkey,
  (epoch(TIMESTAMP '2000-01-01 00:00:00') - epoch(o_orderdate))::BIGINT AS age FROM orders"""


def _first_names(spark, sf):
    """The first field with text of each part."""
    key = F.pmod("p_partkey", F.lit(4))
    rows = base.load(spark, sf, "part").select(
        "p_partkey", F.when(key != 0, F.when(key == 1, "").otherwise(F.col("p_name"))).alias("a"),
        F.when(key != 1, F.col("p_brand")).alias("b"), F.col("p_type").alias("c"))
    return rows.select("p_partkey", first_text("a", "b", "c").alias("shown"))


QUERIES["first_texts"] = _first_names
ORACLE["first_texts"] = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand
  WHEN 1 THEN p_type ELSE p_name END AS shown FROM part"""


def _text_sizes(spark, sf):
    """Keepers by sizes that are stored as text, some of them no numbers."""
    key = F.pmod("p_partkey", F.lit(5))
    rows = base.load(spark, sf, "part").select(
        F.col("p_partkey").alias("pos"), F.col("p_brand").alias("lead"),
        F.when(key == 0, "wide").when(key == 1, "").otherwise(
            F.col("p_size").cast("string")).alias("width"),
        F.lit(" 10 ").alias("height"),
        F.floor("p_retailprice").cast("long").alias("bytes"))
    return keepers(rows.select("pos", "lead"), rows.drop("lead"), ["lead"]).select(
        "lead", "keeper", "size")


QUERIES["keeper_text_sizes"] = _text_sizes
ORACLE["keeper_text_sizes"] = """WITH r AS (SELECT p_partkey AS pos, p_brand AS lead,
  CASE WHEN p_partkey % 5 IN (0, 1) THEN 0 ELSE p_size * 10 END AS pixels,
  floor(p_retailprice) AS bytes FROM part)
SELECT lead, arg_max(pos, (pixels, bytes, -pos)) AS keeper, count(*) AS size FROM r GROUP BY lead"""
