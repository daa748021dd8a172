"""Registered people, clustering and labelling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators.audit import label_coverage
from shelfmark.operators.cosine import cosine_pairs, density_clusters
from shelfmark.operators.people import (
    cluster_sheet, cluster_summary, forget_label, label_status, label_totals, label_votes,
    labels_json, name_clusters, people_index, people_roster, set_label, unplaced_counts,
)
from shelfmark.registry import base

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_MODEL = f"WITH {base.SQL_FACES} "


def _faces(spark, sf):
    return base.faces(spark, sf), base.labels(spark, sf)


QUERIES["people_index"] = lambda spark, sf: people_index(*_faces(spark, sf))
ORACLE["people_index"] = _MODEL + (
    "SELECT name, path, face_id FROM faces JOIN labelled USING (face_id)")
QUERIES["people_roster"] = lambda spark, sf: people_roster(people_index(*_faces(spark, sf)))
ORACLE["people_roster"] = _MODEL + (
    "SELECT name, count(DISTINCT path) AS images, count(*) AS faces "
    "FROM faces JOIN labelled USING (face_id) GROUP BY ALL")
QUERIES["unplaced_counts"] = lambda spark, sf: unplaced_counts(base.faces(spark, sf))
ORACLE["unplaced_counts"] = _MODEL + (
    "SELECT path, count(*) AS unplaced FROM faces WHERE cluster = 'unassigned' GROUP BY ALL")
QUERIES["cluster_summary"] = lambda spark, sf: cluster_summary(base.faces(spark, sf))
ORACLE["cluster_summary"] = _MODEL + """,
a AS (SELECT *, CASE WHEN regexp_full_match(age, '[0-9]+') THEN age::INT END AS y FROM faces),
s AS (SELECT cluster, sex, count(*) AS n, min(pos) AS f FROM faces GROUP BY ALL),
d AS (SELECT cluster, sex FROM s QUALIFY row_number() OVER
  (PARTITION BY cluster ORDER BY n DESC, f) = 1)
SELECT cluster, count(*) AS faces, count(DISTINCT path) AS images, min(y) AS youngest,
  max(y) AS oldest, trunc(quantile_cont(y, 0.5))::INT AS median_age, any_value(d.sex) AS dominant_sex
FROM a JOIN d USING (cluster) GROUP BY cluster"""
QUERIES["cluster_topn"] = lambda spark, sf: cluster_sheet(base.faces(spark, sf)).select(
    "cluster", "rank", "face_id", "det_score")
ORACLE["cluster_topn"] = _MODEL + (
    "SELECT cluster, rank::INT AS rank, face_id, det_score::DOUBLE AS det_score FROM (SELECT *, "
    "row_number() OVER (PARTITION BY cluster ORDER BY det_score DESC, pos) AS rank FROM faces) "
    "WHERE rank <= 24")

_VOTES = """,
v AS (SELECT cluster, name, count(*) AS n, min(pos) AS f FROM faces JOIN labelled USING (face_id)
  GROUP BY ALL),
voted AS (SELECT cluster, name, n AS votes FROM v QUALIFY row_number() OVER
  (PARTITION BY cluster ORDER BY n DESC, f) = 1),
status AS (SELECT cluster, count(*) AS faces, any_value(name) AS name, any_value(votes) AS votes
  FROM faces LEFT JOIN voted USING (cluster) GROUP BY cluster) """
QUERIES["label_votes"] = lambda spark, sf: label_votes(*_faces(spark, sf))
ORACLE["label_votes"] = _MODEL + _VOTES + "SELECT cluster, name, votes FROM voted"
QUERIES["label_status"] = lambda spark, sf: label_status(*_faces(spark, sf)).select(
    "cluster", "faces", "name", "votes", "note", "last", "place")
ORACLE["label_status"] = _MODEL + _VOTES + """SELECT cluster, faces, name, votes,
  CASE WHEN name IS NULL THEN '-' WHEN votes < faces
    THEN name || '  (' || votes || '/' || faces || ' known)' ELSE name END AS note,
  cluster = 'unassigned' AS last, row_number() OVER (ORDER BY cluster = 'unassigned', faces DESC,
    (SELECT min(pos) FROM faces f WHERE f.cluster = status.cluster)) AS place FROM status"""
QUERIES["label_totals"] = lambda spark, sf: label_totals(label_status(*_faces(spark, sf))).select(
    "clusters", "named_clusters", "faces", "covered_faces",
    F.round("coverage_pct", 6).alias("coverage_pct"))
ORACLE["label_totals"] = _MODEL + _VOTES + """SELECT count(*) AS clusters,
  count(name) AS named_clusters, sum(faces)::BIGINT AS faces,
  coalesce(sum(faces) FILTER (name IS NOT NULL), 0)::BIGINT AS covered_faces,
  round(coalesce(sum(faces) FILTER (name IS NOT NULL), 0) * 100.0 / sum(faces), 6)::DOUBLE
    AS coverage_pct FROM status"""


def _set(spark, sf):
    """Name a cluster like another one (a merge), then a fresh one."""
    faces, labels = _faces(spark, sf)
    merged = set_label(faces, labels, "Person_002", "Guest 001")
    return set_label(faces, merged, "Person_009", "New Guest")


QUERIES["label_set"] = _set
ORACLE["label_set"] = _MODEL + """SELECT face_id, name FROM labelled WHERE face_id NOT IN
  (SELECT face_id FROM faces WHERE cluster IN ('Person_002', 'Person_009'))
UNION ALL SELECT face_id, 'Guest 001' FROM faces WHERE cluster = 'Person_002'
UNION ALL SELECT face_id, 'New Guest' FROM faces WHERE cluster = 'Person_009'"""
QUERIES["label_forget"] = lambda spark, sf: forget_label(base.labels(spark, sf), "Guest 000")
ORACLE["label_forget"] = _MODEL + "SELECT face_id, name FROM labelled WHERE name <> 'Guest 000'"
QUERIES["label_lines"] = lambda spark, sf: labels_json(base.labels(spark, sf), 50)
ORACLE["label_lines"] = _MODEL + """,
p AS (SELECT *, ((row_number() OVER (PARTITION BY name ORDER BY face_id) - 1) // 50)::INT AS page
  FROM labelled)
SELECT name, page, '{"' || name || '":["' || ids || '"]}' AS value FROM (SELECT name, page,
  string_agg(face_id, '","' ORDER BY face_id) AS ids FROM p GROUP BY name, page)"""
QUERIES["label_coverage"] = lambda spark, sf: label_coverage(*_faces(spark, sf)).select(
    "people", "labelled", "faces", F.round("pct", 6).alias("pct"))
ORACLE["label_coverage"] = _MODEL + """SELECT count(DISTINCT name) AS people, count(*) AS labelled,
  (SELECT count(*) FROM faces) AS faces,
  round(count(*) * 100.0 / (SELECT count(*) FROM faces), 6)::DOUBLE AS pct FROM labelled"""


# -- similarity and clustering ----------------------------------------------------

SIMILAR = 0.35
CROWD = 12


def _vectors(spark, sf):
    return base.load(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _face_vectors(spark, sf):
    """(id, vec): every face with its vector, copies included."""
    emb, n = base.vectors(spark, sf)
    spots = base.documents(spark, sf).select("pos", F.posexplode(F.array(
        F.lit(0), F.lit(base.CAPTION_SHIFT))).alias("i", "shift"))
    keyed = spots.select(
        (F.col("pos") * 2 + F.col("i")).alias("id"),
        F.pmod(F.col("pos") + F.col("shift"), F.lit(n)).alias("vec_id"))
    return keyed.join(emb.select("vec_id", F.col("embedding").alias("vec")), "vec_id").select(
        "id", "vec")


QUERIES["cosine_pairs"] = lambda spark, sf: cosine_pairs(_vectors(spark, sf), SIMILAR).select(
    "src", "dst", F.round("sim", 6).alias("sim"))
ORACLE["cosine_pairs"] = f"""WITH {base.SQL_EMB}, u AS (SELECT vec_id,
  list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM emb)
SELECT a.vec_id AS src, b.vec_id AS dst, round(list_inner_product(a.v, b.v), 6) AS sim
FROM u a JOIN u b ON a.vec_id < b.vec_id AND list_inner_product(a.v, b.v) >= {SIMILAR}"""

_DBSCAN = f"""WITH RECURSIVE {base.SQL_DOCS}, {base.SQL_EMB},
face AS (SELECT d.pos * 2 + s.i AS id, (d.pos + s.shift) % n.n AS vec_id, e.v
  FROM docs d, (VALUES (0, 0), (1, {base.CAPTION_SHIFT})) s(i, shift), n
  JOIN emb e ON e.vec_id = (d.pos + s.shift) % n.n),
lone AS (SELECT min(id) AS id, count(*) AS copies, vec_id, any_value(list_transform(v,
  lambda x: x / sqrt(list_inner_product(v, v)))) AS v FROM face GROUP BY vec_id),
near AS (SELECT a.id AS a, b.id AS b, b.copies FROM lone a JOIN lone b
  ON a.id = b.id OR list_inner_product(a.v, b.v) >= {SIMILAR}),
core AS (SELECT a AS id FROM near GROUP BY a HAVING sum(copies) >= {CROWD}),
reach(a, b) AS (SELECT id, id FROM core
  UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b JOIN core c ON c.id = n.b),
comp AS (SELECT b AS id, min(a) AS cluster FROM reach GROUP BY b),
border AS (SELECT n.a AS id, min(c.cluster) AS cluster FROM near n JOIN comp c ON c.id = n.b
  WHERE n.a NOT IN (SELECT id FROM core) GROUP BY n.a),
label AS (SELECT * FROM comp UNION ALL SELECT * FROM border),
member AS (SELECT f.id, l.cluster FROM face f JOIN lone o USING (vec_id)
  LEFT JOIN label l ON l.id = o.id)"""


def _dbscan(spark, sf):
    return density_clusters(_face_vectors(spark, sf), 1 - SIMILAR, CROWD)


QUERIES["dbscan"] = _dbscan
ORACLE["dbscan"] = _DBSCAN + " SELECT id, cluster FROM member"
QUERIES["cluster_names"] = lambda spark, sf: name_clusters(_dbscan(spark, sf)).select("id", "person")
ORACLE["cluster_names"] = _DBSCAN + """,
size AS (SELECT cluster, row_number() OVER (ORDER BY count(*) DESC, cluster) AS r FROM member
  WHERE cluster IS NOT NULL GROUP BY cluster)
SELECT id, CASE WHEN r IS NULL THEN 'unassigned' ELSE 'Person_' || lpad(r::VARCHAR,
  greatest(3, length(r::VARCHAR))::INT, '0') END AS person FROM member LEFT JOIN size USING (cluster)"""
