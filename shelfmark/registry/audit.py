"""Registered audit and enrichment queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfmark.operators.audit import (
    coverage, coverage_report, derived_coverage, failure_report, index_statistics,
    multiset_delta, order_fingerprint, source_state, verify_index,
)
from shelfmark.operators.duplicates import exact_members
from shelfmark.operators.enrich import (
    acceptable, pending_renditions, quality_counts, rendition_plan, todo,
)
from shelfmark.plans.report import enrichment_by_chunks, enrichment_run
from shelfmark.registry import base
from shelfmark.session import checkpoint_root

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_ARTIFACTS = ["captions", "vectors", "pages"]


def _artifact_rows(spark, sf):
    """(artifact, pos, path, key, status): what three builders recorded."""
    labels = base.load(spark, sf, "labels").select(
        F.lit("captions").alias("artifact"), F.col("doc_id").alias("pos"),
        F.when(F.col("toxic") == 1, "unreadable").when(F.col("quality") == 0, "blurred")
        .otherwise("ok").alias("status"))
    vectors = base.load(spark, sf, "embeddings").select(
        F.lit("vectors").alias("artifact"), (F.col("vec_id") * 3).alias("pos"),
        F.lit("ok").alias("status"))
    pages = base.load(spark, sf, "pages").select(
        F.lit("pages").alias("artifact"), F.col("page_id").alias("pos"),
        F.when(F.pmod("page_id", F.lit(8)) == 3, "").when(
            F.pmod("page_id", F.lit(8)) == 4, "unreadable").otherwise("ok").alias("status"))
    rows = labels.unionByName(vectors).unionByName(pages)
    path = F.concat(F.lit("/archive/"), F.format_string("doc-%08d", "pos"))
    return rows.withColumns({"path": path, "key": F.format_string("doc-%08d", "pos")})


def _base_keys(spark, sf):
    return base.documents(spark, sf).select(F.col("path").alias("key"))


_SQL_ROWS = f"""{base.SQL_DOCS},
art AS (SELECT 'captions' AS artifact, doc_id AS pos, CASE WHEN toxic = 1 THEN 'unreadable'
    WHEN quality = 0 THEN 'blurred' ELSE 'ok' END AS status FROM labels
  UNION ALL SELECT 'vectors', vec_id * 3, 'ok' FROM embeddings
  UNION ALL SELECT 'pages', page_id, CASE page_id % 8 WHEN 3 THEN '' WHEN 4 THEN 'unreadable'
    ELSE 'ok' END FROM pages),
keyed AS (SELECT *, 'doc-' || lpad(pos::VARCHAR, 8, '0') AS key FROM art),
names AS (SELECT DISTINCT artifact FROM art),
cov AS (SELECT n.artifact,
  (SELECT count(DISTINCT key) FROM keyed k WHERE k.artifact = n.artifact) AS covers,
  (SELECT count(*) FROM docs WHERE path NOT IN (SELECT key FROM keyed k
    WHERE k.artifact = n.artifact)) AS missing,
  (SELECT count(DISTINCT key) FROM keyed k WHERE k.artifact = n.artifact
    AND k.key NOT IN (SELECT path FROM docs)) AS orphaned FROM names n),
bad AS (SELECT * FROM keyed WHERE status <> 'ok' AND status <> ''),
st AS (SELECT artifact, status, count(*) AS n FROM bad GROUP BY ALL),
note AS (SELECT artifact, sum(n)::BIGINT AS failures,
  string_agg(n || ' ' || status, ', ' ORDER BY status) AS note FROM st GROUP BY artifact),
ex AS (SELECT artifact, string_agg(key, '|' ORDER BY pos) AS examples FROM (SELECT *,
  row_number() OVER (PARTITION BY artifact ORDER BY pos) AS r FROM bad) WHERE r <= 5
  GROUP BY artifact)"""
_HEAD = f"WITH {_SQL_ROWS} "

QUERIES["coverage"] = lambda spark, sf: coverage(
    _base_keys(spark, sf), _artifact_rows(spark, sf), _ARTIFACTS)
ORACLE["coverage"] = _HEAD + (
    "SELECT artifact, covers::BIGINT AS covers, missing, orphaned FROM cov")
QUERIES["failure_counts"] = lambda spark, sf: failure_report(_artifact_rows(spark, sf)).select(
    "artifact", "failures", "note", F.array_join("examples", "|").alias("examples"))
ORACLE["failure_counts"] = _HEAD + (
    "SELECT artifact, failures, note, examples FROM note JOIN ex USING (artifact)")


def _report(spark, sf):
    rows = _artifact_rows(spark, sf)
    # What exists is a fact of the store; the sources' hashes come from the tables.
    texts = base.load(spark, sf, "benchmark").agg(
        F.sha2(F.max("text"), 256).alias("current"), F.sha2(F.min("text"), 256).alias("older"))
    records = texts.select(F.explode(F.array(
        F.struct(F.lit("captions").alias("artifact"), F.col("current").alias("recorded")),
        F.struct(F.lit("vectors").alias("artifact"), F.col("older").alias("recorded")))).alias("r"),
        "current").select(
        "r.artifact", F.lit("index.json").alias("manifest_name"),
        F.concat(F.lit('{"catalog_sha256": "'), "r.recorded", F.lit('"}')).alias("manifest_text"),
        F.lit("catalog_sha256").alias("field"), F.lit("catalog.csv").alias("source_name"),
        F.col("current").alias("source_sha256"))
    built = spark.createDataFrame(
        [("captions", True, True, "catalog.csv"), ("vectors", True, True, "catalog.csv"),
         ("pages", True, True, "catalog.csv"), ("faces", False, True, "catalog.csv"),
         ("palette", True, False, "manifest.csv")],
        "artifact string, built boolean, base_built boolean, base_name string")
    covered = coverage(_base_keys(spark, sf), rows, _ARTIFACTS)
    return coverage_report(built, covered, source_state(records), failure_report(rows)).select(
        "artifact", "covers", "status", "stale", "missing", "orphaned", "source_stale",
        "source_note", "failures", F.array_join("examples", "|").alias("examples"))


QUERIES["coverage_report"] = _report
ORACLE["coverage_report"] = _HEAD + """,
j AS (SELECT c.*, coalesce(failures, 0)::BIGINT AS failures, note, examples,
  CASE WHEN c.artifact = 'vectors' AND (SELECT min(text) <> max(text) FROM benchmark)
    THEN 'built from superseded catalog.csv' END AS source_note
  FROM cov c LEFT JOIN note USING (artifact) LEFT JOIN ex USING (artifact)),
k AS (SELECT *, concat_ws(', ', CASE WHEN missing > 0 THEN missing || ' not covered' END,
  CASE WHEN orphaned > 0 THEN orphaned || ' no longer in catalog' END, source_note) AS why FROM j)
SELECT artifact, covers::BIGINT AS covers, CASE WHEN why = '' THEN 'OK' ELSE 'STALE - ' || why END
    || coalesce(', ' || note, '') AS status, why <> '' AS stale, missing, orphaned,
  source_note IS NOT NULL AS source_stale, source_note, failures, examples FROM k
UNION ALL SELECT 'faces', NULL, 'MISSING', true, NULL, NULL, false, NULL, 0, NULL
UNION ALL SELECT 'palette', 0, 'UNMEASURABLE - manifest.csv missing', true, NULL, NULL, false, NULL,
  0, NULL"""


def _sources(spark, sf):
    """One recorded fingerprint per customer, in every state it can be in."""
    state = F.pmod("c_custkey", F.lit(8))
    sha = F.sha2("c_name", 256)
    body = F.concat(F.lit('{"catalog_sha256": "'), sha, F.lit('", "rows": 3}'))
    return base.load(spark, sf, "customer").select(
        F.col("c_name").alias("artifact"), F.lit("index.json").alias("manifest_name"),
        F.when(state == 0, F.lit(None).cast("string")).when(state == 1, "{broken")
        .when(state == 2, "[1, 2]").when(state == 3, '{"rows": 3}').when(state == 4, "null")
        .otherwise(body).alias("manifest_text"),
        F.lit("catalog_sha256").alias("field"), F.lit("catalog.csv").alias("source_name"),
        F.when(state == 5, F.lit(None).cast("string")).when(state == 6, F.sha2("c_mktsegment", 256))
        .otherwise(sha).alias("source_sha256"))


QUERIES["source_staleness"] = lambda spark, sf: source_state(_sources(spark, sf))
ORACLE["source_staleness"] = """WITH s AS (SELECT c_name AS artifact, CASE c_custkey % 8
  WHEN 0 THEN 'no manifest, so its source is unrecorded' WHEN 1 THEN 'index.json is unreadable'
  WHEN 2 THEN 'index.json is unreadable' WHEN 3 THEN 'index.json records no catalog_sha256'
  WHEN 4 THEN 'index.json is unreadable' WHEN 5 THEN 'source catalog.csv is missing'
  WHEN 6 THEN 'built from superseded catalog.csv' END AS source_note FROM customer)
SELECT artifact, source_note, source_note IS NOT NULL AS source_stale FROM s"""


def _fingerprint(chunk):
    def run(spark, sf):
        return order_fingerprint(base.documents(spark, sf).select("pos", "path"), chunk)
    return run


def _sql_fingerprint(chunk):
    return f"""WITH {base.SQL_DOCS},
c AS (SELECT pos // {chunk} AS c, count(*) AS n,
  sha256(string_agg(path, chr(10) ORDER BY pos) || chr(10)) AS d FROM docs GROUP BY 1),
k AS (SELECT n, sha256(c || '|' || d) AS h FROM c),
s AS (SELECT sum(n)::BIGINT AS rows, sum(('0x' || substr(h, 1, 15))::BIGINT) AS low,
  sum(('0x' || substr(h, 16, 15))::BIGINT) AS high FROM k)
SELECT rows, sha256(rows || '|' || low || '|' || high) AS fingerprint FROM s"""


QUERIES["index_fingerprint"] = _fingerprint(65_536)
ORACLE["index_fingerprint"] = _sql_fingerprint(65_536)
QUERIES["index_fingerprint_chunked"] = _fingerprint(128)
ORACLE["index_fingerprint_chunked"] = _sql_fingerprint(128)


def _verify(spark, sf):
    rows = base.documents(spark, sf).select("pos", "path")
    now = order_fingerprint(rows)
    # The same paths in reverse order: one digest differs, no count does.
    turned = order_fingerprint(rows.select(
        (rows.agg(F.max("pos")).scalar() - F.col("pos")).alias("pos"), "path"))
    good = now.select(F.col("fingerprint").alias("lookup_fingerprint"))
    bad = turned.select(F.col("fingerprint").alias("lookup_fingerprint"))
    count = rows.agg(F.count("*")).scalar()
    cases = [
        ("fresh", count, good), ("reordered", count, bad), ("missing", count, good.limit(0)),
        ("legacy", count, good.select(F.lit("").alias("lookup_fingerprint"))),
        ("short", count - 1, good),
    ]
    out = None
    for name, n, manifest in cases:
        row = verify_index(n, now, manifest).withColumn("case", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


QUERIES["index_verify"] = _verify
ORACLE["index_verify"] = """SELECT * FROM (VALUES ('fresh', true, ''),
  ('reordered', false, 'rows added, removed or reordered'), ('missing', false, 'manifest missing'),
  ('legacy', false, 'manifest without fingerprint'), ('short', false, 'row counts differ'))
  t("case", ok, reason) WHERE (SELECT count(*) FROM documents) > 1"""
QUERIES["index_statistics"] = lambda spark, sf: index_statistics(
    base.load(spark, sf, "embeddings").select(F.col("embedding").alias("vec"))).withColumns({
        "min_norm": F.round("min_norm", 6), "max_norm": F.round("max_norm", 6)})
ORACLE["index_statistics"] = f"""WITH {base.SQL_EMB}, l AS (SELECT len(v) AS d,
  sqrt(list_inner_product(v, v)) AS norm FROM emb)
SELECT count(*) AS vectors, max(d)::INT AS dimension, 'float' AS dtype,
  round(min(norm), 6) AS min_norm, round(max(norm), 6) AS max_norm FROM l"""


def _derived(spark, sf):
    docs = base.documents(spark, sf)
    same = exact_members(docs.select("pos", F.sha2("text", 256).alias("sha256"))).join(docs, "pos")
    labels = base.load(spark, sf, "labels").select(base.doc_path().alias("path"))
    faces = base.faces(spark, sf)
    trips = base.source_events(spark, sf).withColumn("event_id", F.when(
        F.col("event_id") == "event-003", "unassigned").otherwise(F.col("event_id")))
    return derived_coverage(
        docs, labels, same, faces, faces.filter("cluster <> 'Person_002'"),
        trips.filter("event_id <> 'event-005'"))


QUERIES["derived_coverage"] = _derived
ORACLE["derived_coverage"] = f"""WITH {base.SQL_FACES}, {base.SQL_EVENTS},
dup AS (SELECT path FROM (SELECT path, count(*) OVER (PARTITION BY sha256(text)) AS n FROM docs)
  WHERE n > 1),
lab AS (SELECT 'doc-' || lpad(doc_id::VARCHAR, 8, '0') AS path FROM labels),
ev AS (SELECT * FROM source_events WHERE event_id <> 'event-005')
SELECT (SELECT count(*) FROM dup WHERE path NOT IN (SELECT path FROM lab))
    AS duplicates_outside_index,
  (SELECT count(*) FROM faces WHERE cluster = 'Person_002') AS faces_not_clustered,
  (SELECT count(*) FROM docs WHERE path NOT IN (SELECT path FROM ev)) AS without_event,
  (SELECT count(DISTINCT event_id) FROM ev WHERE event_id <> 'event-003') AS events,
  (SELECT count(DISTINCT path) FROM ev WHERE event_id <> 'event-003') AS placed"""


def _delta(spark, sf):
    """Order priorities per customer, finished orders against all others."""
    orders = base.load(spark, sf, "orders").select(
        F.col("o_custkey").alias("query"), F.col("o_orderpriority").alias("filename"),
        "o_orderstatus")
    return multiset_delta(orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus <> 'F'"),
                          ["query", "filename"])


QUERIES["multiset_delta"] = _delta
ORACLE["multiset_delta"] = """WITH c AS (SELECT o_custkey AS query, o_orderpriority AS filename,
  count(*) FILTER (o_orderstatus = 'F') AS was, count(*) FILTER (o_orderstatus <> 'F') AS now
  FROM orders GROUP BY ALL)
SELECT query, filename, was, now, greatest(now - was, 0) AS gained, greatest(was - now, 0) AS lost
FROM c"""


# -- enrichment --------------------------------------------------------------------

def _done(spark, sf):
    return base.load(spark, sf, "labels").select(base.doc_path().alias("path"))


QUERIES["enrich_todo"] = lambda spark, sf: todo(
    base.documents(spark, sf).select("pos", "path"), _done(spark, sf))
ORACLE["enrich_todo"] = f"""WITH {base.SQL_DOCS} SELECT pos, path FROM docs
  WHERE pos NOT IN (SELECT doc_id FROM labels)"""
QUERIES["enrich_todo_limit"] = lambda spark, sf: todo(
    base.documents(spark, sf).select("pos", "path"), _done(spark, sf), limit=25)
ORACLE["enrich_todo_limit"] = ORACLE["enrich_todo"] + " ORDER BY pos LIMIT 25"


def _paragraphs(record):
    """A caller's enricher: a row per line of a text, junk refused."""
    if record["source"].endswith("3"):
        raise ValueError("cannot be read")
    return [{"line": line} for line in record["text"].split("\n")]


def _run(part):
    def run(spark, sf):
        ledger, outputs = enrichment_run(
            base.documents(spark, sf), _done(spark, sf), _paragraphs, "line: string",
            existing_outputs=1000)
        return ledger if part == "ledger" else outputs
    return run


QUERIES["enrich_ledger"] = _run("ledger")
_SQL_TODO = f"""WITH {base.SQL_DOCS}, d AS (SELECT *, suffix(source, '3') AS bad FROM docs
  WHERE pos NOT IN (SELECT doc_id FROM labels)) """
ORACLE["enrich_ledger"] = _SQL_TODO + """SELECT path, path AS filename,
  CASE WHEN bad THEN 0 ELSE len(string_split(text, chr(10))) END::INT AS found,
  CASE WHEN bad THEN 'unreadable' ELSE 'ok' END AS status,
  CASE WHEN bad THEN 'ValueError: cannot be read' ELSE '' END AS reason FROM d"""
QUERIES["enrich_outputs"] = _run("outputs")
ORACLE["enrich_outputs"] = _SQL_TODO + """, l AS (SELECT path, unnest(string_split(text, chr(10)))
  AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d WHERE NOT bad)
SELECT path, line, (row_number() OVER (ORDER BY path, i) - 1 + 1000)::VARCHAR AS face_id FROM l"""


def _chunks(part):
    def run(spark, sf):
        """Two runs into one folder: the first ends half-way, the second does the rest."""
        folder = f"{checkpoint_root(spark)}/shelfmark/enriched-{uuid.uuid4().hex}"
        catalog = todo(base.documents(spark, sf), _done(spark, sf))
        half = F.pmod(F.xxhash64("path"), F.lit(2)) == 0
        for rows in (catalog.filter(half), catalog):
            ledger, outputs = enrichment_by_chunks(
                rows, folder, _paragraphs, "line: string", 50_000, existing_outputs=1000)
        return ledger if part == "ledger" else outputs
    return run


QUERIES["enrich_chunks_ledger"] = _chunks("ledger")
ORACLE["enrich_chunks_ledger"] = ORACLE["enrich_ledger"]
QUERIES["enrich_chunks_outputs"] = _chunks("outputs")
ORACLE["enrich_chunks_outputs"] = ORACLE["enrich_outputs"]


def _detections(spark, sf):
    """Line items as detections: a score, a box, and a vector now and then zero."""
    return base.load(spark, sf, "lineitem").select(
        (1 - F.col("l_discount") * 8).alias("score"), F.col("l_quantity").alias("width"),
        (F.col("l_extendedprice") / 1000).alias("height"),
        F.array(F.col("l_tax"), F.col("l_discount")).alias("vector"))


QUERIES["quality_filter"] = lambda spark, sf: quality_counts(
    _detections(spark, sf), acceptable(*[F.col(c) for c in ("score", "width", "height", "vector")]))
ORACLE["quality_filter"] = """WITH d AS (SELECT 1 - l_discount * 8 >= 0.60 AND l_quantity >= 40
  AND l_extendedprice / 1000 >= 40 AND l_tax * l_tax + l_discount * l_discount > 0 AS ok FROM lineitem)
SELECT count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok) AS rejected FROM d"""


def _pictures(spark, sf):
    pos = F.col("pos")
    return base.documents(spark, sf).select(
        pos, F.sha2("text", 256).alias("sha256"),
        (F.pmod(pos * 37, F.lit(50)) * 97).cast("int").alias("width"),
        F.least(F.col("n_chars") + 1, F.lit(9000)).cast("int").alias("height"))


def _rendered(spark, sf):
    docs = base.documents(spark, sf).select("pos", F.sha2("text", 256).alias("sha256"))
    known = base.load(spark, sf, "labels").join(docs, F.col("doc_id") == F.col("pos"))
    return known.select("sha256", F.when(F.col("quality") == 1, "grid").otherwise("lightbox")
                        .alias("kind")).distinct()


_SQL_PENDING = f"""WITH {base.SQL_DOCS},
pic AS (SELECT sha256(text) AS sha, pos, pos * 37 % 50 * 97 AS w, least(n_chars + 1, 9000) AS h
  FROM docs QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY pos) = 1),
done AS (SELECT sha256(text) AS sha, CASE WHEN quality = 1 THEN 'grid' ELSE 'lightbox' END AS kind
  FROM labels JOIN docs ON pos = doc_id),
pend AS (SELECT sha, kind, longest, w, h FROM pic, (VALUES ('grid', 400), ('lightbox', 1600))
  k(kind, longest) WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.sha = pic.sha
  AND d.kind = k.kind)) """
QUERIES["rendition_pending"] = lambda spark, sf: pending_renditions(
    _pictures(spark, sf), _rendered(spark, sf))
ORACLE["rendition_pending"] = _SQL_PENDING + "SELECT sha AS sha256, kind, longest FROM pend"
QUERIES["rendition_plan"] = lambda spark, sf: rendition_plan(
    _pictures(spark, sf), _rendered(spark, sf))
ORACLE["rendition_plan"] = _SQL_PENDING + """
SELECT sha AS sha256, kind, longest, max(longest) OVER (PARTITION BY sha) AS draft_longest,
  CASE WHEN w > 0 AND h > 0 THEN CASE WHEN greatest(w, h) <= longest THEN w ELSE
    greatest(1, round_even(w * (longest::DOUBLE / greatest(w, h)), 0)) END END::INT AS width,
  CASE WHEN w > 0 AND h > 0 THEN CASE WHEN greatest(w, h) <= longest THEN h ELSE
    greatest(1, round_even(h * (longest::DOUBLE / greatest(w, h)), 0)) END END::INT AS height,
  CASE WHEN w > 0 AND h > 0 THEN 'pending' ELSE 'unreadable' END AS status FROM pend"""
