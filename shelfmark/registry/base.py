"""How the catalog model maps onto the given tables, in Spark and in SQL.

A document is a catalog item: its path is ``doc-<id>``, its caption the text.
Its image and caption vectors are two rows of ``embeddings`` chosen by id, so
every document is indexed and vectors repeat. Its faces are those two vectors,
labelled with the embedding label. Its event is its ``source``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.plans.search import Corpus
from shelfmark.session import LOCAL_SPREAD, bound_batches

CAPTION_SHIFT = 7


def load(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """A given table, read as it is; its timestamps are taken as UTC.

    A local session may ask for its rows to be dealt out over the cores,
    because the given tables are single files there (``LOCAL_SPREAD``).
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    bound_batches(spark)
    df = spark.read.parquet(f"{sf}/{table}.parquet")
    cores = spark.conf.get(LOCAL_SPREAD, None)
    return df.repartition(int(cores)) if cores else df


def doc_path(column: str = "doc_id"):
    return F.format_string("doc-%08d", column)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """(pos, path, text, lang, source, n_chars) in path order."""
    return load(spark, sf, "documents").select(
        F.col("doc_id").alias("pos"), doc_path().alias("path"), "text", "lang", "source",
        "n_chars")


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    emb = spark.read.parquet(f"{sf}/embeddings.parquet")
    return emb, emb.count()


def corpus(spark: SparkSession, sf: str) -> Corpus:
    docs = documents(spark, sf)
    emb, n = vectors(spark, sf)
    vec = emb.select("vec_id", F.col("embedding").alias("vec"))
    image = docs.select("path", F.pmod("pos", F.lit(n)).alias("vec_id")).join(vec, "vec_id")
    caption = docs.select(
        "pos", "path", F.col("text").alias("caption"),
        F.pmod(F.col("pos") + CAPTION_SHIFT, F.lit(n)).alias("vec_id"),
    ).join(vec, "vec_id")
    return Corpus(image.select("path", "vec"), caption.select("pos", "path", "caption", "vec"))


def requests(spark: SparkSession, sf: str, rows: list[dict]) -> DataFrame:
    """Request rows; their vectors are embeddings 0 (image) and 1 (caption)."""
    fields = "query_id string, text string, mode string, top_k int, trim boolean"
    filled = [
        (r["query_id"], r.get("text", ""), r.get("mode", "hybrid"), r.get("top_k", 0),
         r.get("trim", False))
        for r in rows
    ]
    emb, _ = vectors(spark, sf)

    def pick(i: int, name: str) -> DataFrame:
        return emb.filter(F.col("vec_id") == i).select(
            F.col("embedding").cast("array<double>").alias(name))

    return spark.createDataFrame(filled, fields).select(
        "*", pick(0, "image_query").scalar().alias("image_query"),
        pick(1, "caption_query").scalar().alias("caption_query"))


def faces(spark: SparkSession, sf: str) -> DataFrame:
    """(pos, face_id, cluster, path, det_score, sex, age): two per document."""
    emb, n = vectors(spark, sf)
    docs = documents(spark, sf).select("pos", "path", F.explode(F.array(
        F.lit(0), F.lit(CAPTION_SHIFT))).alias("shift"))
    rows = docs.withColumn("vec_id", F.pmod(F.col("pos") + F.col("shift"), F.lit(n)))
    rows = rows.join(emb.select("vec_id", "label"), "vec_id")
    spot = F.col("pos") * 2 + F.when(F.col("shift") > 0, 1).otherwise(0)
    return rows.select(
        spot.alias("pos"), F.concat(F.lit("f"), spot.cast("string")).alias("face_id"),
        F.when(F.col("label") == 9, "unassigned").otherwise(
            F.format_string("Person_%03d", F.col("label") + 1)).alias("cluster"),
        "path", (F.pmod(spot * 37, F.lit(1000)) / 1000.0).alias("det_score"),
        F.when(F.pmod(spot, F.lit(3)) == 0, "F").otherwise("M").alias("sex"),
        F.when(F.pmod(spot, F.lit(11)) == 0, "").otherwise(
            (F.pmod(spot * 7, F.lit(80)) + 1).cast("string")).alias("age"),
    )


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """(face_id, name): placed faces of the labelled documents.

    Faces of toxic ones carry another name, so that clusters are not unanimous.
    """
    judged = load(spark, sf, "labels")
    rows = faces(spark, sf).filter("cluster <> 'unassigned'").join(
        judged, F.floor(F.col("pos") / 2) == F.col("doc_id"))
    return rows.select("face_id", F.concat(
        F.lit("Guest "),
        F.when(F.col("toxic") == 1, "000").otherwise(F.substring("cluster", 8, 3))).alias("name"))


def members(spark: SparkSession, sf: str) -> DataFrame:
    """(name, path) of people, one name per embedding label."""
    return faces(spark, sf).select(
        F.when(F.col("cluster") == "unassigned", "Nobody Placed").otherwise(
            F.concat(F.lit("Guest "), F.substring("cluster", 8, 3))).alias("name"),
        "path").distinct()


def source_number():
    return F.regexp_extract("source", r"(\d+)$", 1).cast("int")


def source_events(spark: SparkSession, sf: str) -> DataFrame:
    """(event_id, name, start, path, pos): one event per document source."""
    number = source_number()
    return documents(spark, sf).select(
        F.format_string("event-%03d", number + 1).alias("event_id"),
        F.concat(F.lit("Trip to "), F.col("source")).alias("name"),
        F.format_string("%d-%02d-01", 2015 + F.floor(number / 12).cast("int"),
                        number % 12 + 1).alias("start"),
        "path", "pos")


# -- the same model as DuckDB SQL --------------------------------------------

# The stopwords of functions/text.py, for SQL.
SQL_STOPWORDS = (
    "'a','an','the','of','in','on','at','with','and','or','someone','somebody','something',"
    "'anyone','people','person','photo','photos','picture','pictures','image','images','is',"
    "'are','was','were','being','be'"
)


def sql_tokens(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}]+')"


def sql_fold(t: str) -> str:
    return (
        f"CASE WHEN length({t}) > 3 AND suffix({t}, 'ies') THEN left({t}, length({t}) - 3) || 'y' "
        f"WHEN length({t}) > 3 AND suffix({t}, 'es') AND substr({t}, length({t}) - 2, 1) "
        f"IN ('s','x','z','h') THEN left({t}, length({t}) - 2) "
        f"WHEN length({t}) > 2 AND suffix({t}, 's') AND NOT suffix({t}, 'ss') "
        f"THEN left({t}, length({t}) - 1) ELSE {t} END"
    )


SQL_DOCS = (
    "docs AS (SELECT doc_id AS pos, 'doc-' || lpad(doc_id::VARCHAR, 8, '0') AS path, text, lang, "
    "source, n_chars FROM documents)"
)
SQL_EMB = (
    "emb AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), "
    "n AS (SELECT count(*) AS n FROM embeddings)"
)
SQL_FACES = f"""{SQL_DOCS}, {SQL_EMB},
face0 AS (SELECT d.pos * 2 + s.i AS pos, d.path, e.label
  FROM docs d, (VALUES (0, 0), (1, {CAPTION_SHIFT})) s(i, shift), n
  JOIN emb e ON e.vec_id = (d.pos + s.shift) % n.n),
faces AS (SELECT pos, 'f' || pos AS face_id,
  CASE WHEN label = 9 THEN 'unassigned' ELSE 'Person_' || lpad((label + 1)::VARCHAR, 3, '0') END
    AS cluster,
  path, (pos * 37 % 1000) / 1000.0 AS det_score,
  CASE WHEN pos % 3 = 0 THEN 'F' ELSE 'M' END AS sex,
  CASE WHEN pos % 11 = 0 THEN '' ELSE (pos * 7 % 80 + 1)::VARCHAR END AS age FROM face0),
labelled AS (SELECT face_id, 'Guest ' || CASE WHEN toxic = 1 THEN '000'
  ELSE substr(cluster, 8, 3) END AS name FROM faces JOIN labels ON doc_id = pos // 2
  WHERE cluster <> 'unassigned'),
members AS (SELECT DISTINCT CASE WHEN cluster = 'unassigned' THEN 'Nobody Placed'
  ELSE 'Guest ' || substr(cluster, 8, 3) END AS name, path FROM faces)"""
SQL_EVENTS = """source_events AS (SELECT
  'event-' || lpad((num + 1)::VARCHAR, 3, '0') AS event_id, 'Trip to ' || source AS name,
  (2015 + num // 12)::VARCHAR || '-' || lpad((num % 12 + 1)::VARCHAR, 2, '0') || '-01' AS start,
  path, pos FROM (SELECT *, regexp_extract(source, '(\\d+)$', 1)::INT AS num FROM docs))"""


def sql_requests(rows: list[dict], has_filter: str = "false") -> str:
    values = ", ".join(
        "('{}', '{}', '{}', {}, {})".format(
            r["query_id"], r.get("text", ""), r.get("mode", "hybrid"), r.get("top_k", 0),
            str(r.get("trim", False)).lower())
        for r in rows)
    return (
        f"req AS (SELECT *, {has_filter} AS has_filter, "
        "(SELECT v FROM emb WHERE vec_id = 0) AS iv, (SELECT v FROM emb WHERE vec_id = 1) AS cv "
        f"FROM (VALUES {values}) t(query_id, text, mode, top_k, trim))")


def sql_search(req: str, pool: str = "", drop: float = 0.80, floor: float = 0.35) -> str:
    """CTEs ``summary`` and ``results`` of a search over ``req``.

    ``pool`` names a CTE (query_id, path) for filtered requests.
    """
    allowed = (
        f"WHERE NOT r.has_filter OR EXISTS (SELECT 1 FROM {pool} p WHERE p.query_id = r.query_id "
        "AND p.path = d.path)" if pool else "")
    return f"""WITH {SQL_FACES}, {SQL_EVENTS}, {req},
tok AS (SELECT query_id, unnest({sql_tokens('text')}) AS t FROM req),
terms AS (SELECT query_id, {sql_fold('t')} AS term, count(*) AS copies FROM tok
  WHERE t NOT IN ({SQL_STOPWORDS}) AND ({sql_fold('t')}) NOT IN ({SQL_STOPWORDS}) GROUP BY ALL),
total AS (SELECT r.query_id, coalesce(sum(t.copies), 0)::INT AS total_terms
  FROM req r LEFT JOIN terms t USING (query_id) GROUP BY ALL),
allowed AS (SELECT r.query_id, r.mode, r.has_filter, r.iv, r.cv, d.path, d.pos
  FROM req r CROSS JOIN docs d {allowed}),
doc_terms AS (SELECT DISTINCT path, {sql_fold('t')} AS term
  FROM (SELECT path, unnest({sql_tokens('text')}) AS t FROM docs)),
hits AS (SELECT t.query_id, d.path, sum(t.copies)::INT AS hits
  FROM doc_terms d JOIN terms t USING (term)
  SEMI JOIN allowed a ON a.query_id = t.query_id AND a.path = d.path GROUP BY ALL),
scored AS (SELECT a.query_id, a.mode, a.path, list_inner_product(i.v, a.iv) AS img,
    list_inner_product(c.v, a.cv) AS cap
  FROM allowed a JOIN total USING (query_id), n
  JOIN emb i ON i.vec_id = a.pos % n.n JOIN emb c ON c.vec_id = (a.pos + {CAPTION_SHIFT}) % n.n
  WHERE total_terms > 0),
ranks AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY img DESC, path) AS ir,
    row_number() OVER (PARTITION BY query_id ORDER BY cap DESC, path) AS cr FROM scored),
heads AS (SELECT query_id, 'img' AS side, ir AS r, img AS s FROM ranks WHERE ir <= 40
  UNION ALL SELECT query_id, 'cap', cr, cap FROM ranks WHERE cr <= 40),
drops AS (SELECT *, s - lead(s) OVER (PARTITION BY query_id, side ORDER BY r) AS drp FROM heads),
leads AS (SELECT *, first_value(drp) OVER (PARTITION BY query_id, side ORDER BY r) AS ld
  FROM drops),
cuts AS (SELECT query_id, side, count(*) AS n,
    CASE WHEN count(*) >= 3 AND max(ld) > 0 THEN min(r) FILTER (drp < ld * {floor}) END AS flat
  FROM leads GROUP BY ALL),
cut AS (SELECT query_id, max(coalesce(flat, n)) FILTER (side = 'img')::INT AS img_cut,
    bool_or(flat IS NOT NULL) FILTER (side = 'img') AS img_plateau,
    max(coalesce(flat, n)) FILTER (side = 'cap')::INT AS cap_cut,
    bool_or(flat IS NOT NULL) FILTER (side = 'cap') AS cap_plateau FROM cuts GROUP BY ALL),
counts AS (SELECT query_id, count(*) FILTER (hits = total_terms)::INT AS full_count,
    count(*) FILTER (hits >= least(2, total_terms))::INT AS partial_count
  FROM hits JOIN total USING (query_id) GROUP BY ALL),
sizes AS (SELECT query_id, count(*) AS pool_size FROM allowed GROUP BY ALL),
summary0 AS (SELECT r.query_id, r.mode, r.top_k, r.trim, r.has_filter, t.total_terms,
    coalesce(full_count, 0)::INT AS full_count, coalesce(partial_count, 0)::INT AS partial_count,
    CASE WHEN total_terms = 0 THEN 0 ELSE coalesce(img_cut, 1) END AS img_cut,
    coalesce(img_plateau, total_terms = 0) AS img_plateau,
    CASE WHEN total_terms = 0 THEN 0 ELSE coalesce(cap_cut, 1) END AS cap_cut,
    coalesce(cap_plateau, total_terms = 0) AS cap_plateau,
    (SELECT count(*) FROM docs) AS corpus_size, coalesce(pool_size, 0) AS pool_size,
    CASE WHEN total_terms = 0 AND r.has_filter THEN 'filter_only'
      WHEN total_terms = 0 THEN 'no_query' WHEN pool_size IS NULL THEN 'empty_pool'
      WHEN r.top_k > 0 THEN 'top_k' WHEN full_count > 0 THEN 'full_match'
      WHEN partial_count > 0 THEN 'partial_match' ELSE 'gradient' END AS basis_kind
  FROM req r JOIN total t USING (query_id) LEFT JOIN cut USING (query_id)
  LEFT JOIN counts USING (query_id) LEFT JOIN sizes USING (query_id)),
summary AS (SELECT *, basis_kind = 'gradient' AND NOT (img_plateau OR cap_plateau)
    AS low_confidence,
    CASE WHEN basis_kind IN ('top_k', 'gradient') THEN 'rrf_sum'
      WHEN basis_kind IN ('full_match', 'partial_match') AND mode = 'image' THEN 'image_cosine'
      WHEN basis_kind IN ('full_match', 'partial_match') THEN 'caption_cosine'
      ELSE 'none' END AS score_kind FROM summary0),
fused AS (SELECT query_id, path, CASE mode WHEN 'image' THEN 1.0 / (60 + ir)
    WHEN 'caption' THEN 1.0 / (60 + cr) ELSE 1.0 / (60 + ir) + 1.0 / (60 + cr) END AS score
  FROM ranks),
fused_rank AS (SELECT f.*, row_number() OVER (PARTITION BY f.query_id ORDER BY f.score DESC,
    f.path) AS rank FROM fused f JOIN summary s USING (query_id)
  WHERE s.basis_kind IN ('top_k', 'gradient')),
inside AS (SELECT h.query_id, h.path, s.trim,
    CASE WHEN s.mode = 'image' THEN r.img ELSE r.cap END AS score
  FROM hits h JOIN summary s USING (query_id) JOIN ranks r USING (query_id, path)
  WHERE s.basis_kind IN ('full_match', 'partial_match') AND h.hits >=
    CASE WHEN s.basis_kind = 'full_match' THEN s.total_terms ELSE least(2, s.total_terms) END),
bounds AS (SELECT query_id, max(score) AS hi, min(score) AS lo, count(*) AS n
  FROM inside GROUP BY ALL),
flagged AS (SELECT i.*, (i.trim AND b.n >= 4 AND b.hi > b.lo
    AND i.score < b.hi - {drop} * (b.hi - b.lo)) AS trimmed
  FROM inside i JOIN bounds b USING (query_id)),
found AS (
  SELECT f.query_id, f.rank, f.path, f.score, false AS matched FROM fused_rank f
    JOIN summary s USING (query_id)
    WHERE f.rank <= CASE WHEN s.top_k > 0 THEN s.top_k ELSE greatest(s.img_cut, s.cap_cut) END
  UNION ALL SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path),
    path, score, true FROM flagged WHERE NOT trimmed
  UNION ALL SELECT a.query_id, row_number() OVER (PARTITION BY a.query_id ORDER BY a.pos),
    a.path, 0.0, false FROM allowed a JOIN summary s USING (query_id)
    WHERE s.basis_kind IN ('filter_only', 'no_query')),
results AS (SELECT f.query_id, f.rank, f.path, round(f.score, 6) AS score,
    coalesce(h.hits, 0)::INT AS term_hits, f.matched
  FROM found f LEFT JOIN hits h USING (query_id, path))
"""
