"""Registered search, filter and query-understanding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions.text import base_name, caption_terms, content_terms
from shelfmark.operators.audit import regression_files, regression_report
from shelfmark.operators.filters import (
    combine_pools, event_candidates, filter_counts, filter_pool, images_in_any, images_with_all,
    name_candidates, resolve_events, resolve_names,
)
from shelfmark.operators.matching import (
    index_captions, matches_over, request_terms, term_hits, term_plans,
)
from shelfmark.operators.ranking import (
    fuse_rankings, gradient_cut, salted_top, spread_trim, top_within,
)
from shelfmark.operators.splits import best_rows, request_blocks
from shelfmark.operators.understanding import understand
from shelfmark.plans.report import (
    answer_requests, payload_heads, payload_trimmed, regression_run, result_captions,
    search_payload,
)
from shelfmark.plans.search import Options, modality_ranks, prepare_requests, search
from shelfmark.registry import base
from shelfmark.session import materialize

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_SHOWN = "SELECT query_id, rank, path, score, term_hits, matched FROM results"
_TEXTS = {
    "search_hybrid_full": {"query_id": "full", "text": "that tion"},
    "search_hybrid_partial": {"query_id": "partial", "text": "that tion zebra"},
    "search_hybrid_gradient": {"query_id": "gradient", "text": "zebra"},
    "search_image_mode": {"query_id": "image", "text": "that tion", "mode": "image"},
    "search_caption_mode": {"query_id": "caption", "text": "zebra", "mode": "caption"},
    "search_top_k": {"query_id": "top", "text": "that", "top_k": 25},
    "search_trim": {"query_id": "trim", "text": "ing thth", "trim": True},
    "search_no_query": {"query_id": "none", "text": "the photos of people"},
}


def _rounded(results):
    return results.withColumn("score", F.round("score", 6))


def _plain_search(row):
    def run(spark, sf):
        return _rounded(search(base.requests(spark, sf, [row]), base.corpus(spark, sf)).results)
    return run


for _name, _row in _TEXTS.items():
    QUERIES[_name] = _plain_search(_row)
    ORACLE[_name] = base.sql_search(base.sql_requests([_row])) + _SHOWN

# A deep top-k goes through the sorted ranking instead of the counted one.
_DEEP = {"query_id": "deep", "text": "that", "top_k": 100_000}
QUERIES["search_deep_top_k"] = _plain_search(_DEEP)
ORACLE["search_deep_top_k"] = base.sql_search(base.sql_requests([_DEEP])) + _SHOWN


def _summary(spark, sf):
    rows = list(_TEXTS.values())
    out = search(base.requests(spark, sf, rows), base.corpus(spark, sf)).summary
    return out.select(
        "query_id", "mode", "total_terms", "full_count", "partial_count", "img_cut",
        "img_plateau", "cap_cut", "cap_plateau", "corpus_size", "pool_size", "basis_kind",
        "score_kind", "low_confidence", "trimmed", "basis")


QUERIES["search_summary"] = _summary
# The sentences must read as the search itself words them.
ORACLE["search_summary"] = base.sql_search(base.sql_requests(list(_TEXTS.values()))) + """
, cutoff AS (SELECT query_id, count(*) FILTER (trimmed)::INT AS trimmed FROM flagged GROUP BY ALL)
SELECT query_id, mode, total_terms, full_count, partial_count, img_cut, img_plateau, cap_cut,
  cap_plateau, corpus_size, pool_size, basis_kind, score_kind, low_confidence,
  coalesce(c.trimmed, 0)::INT AS trimmed,
  CASE basis_kind
    WHEN 'no_query' THEN 'Nothing was asked for, so this is the whole collection in catalog order.'
    WHEN 'top_k' THEN 'A fixed number of results was asked for, so the ranking was cut at that number rather than where the evidence ran out.'
    WHEN 'full_match' THEN CASE WHEN total_terms = 1
      THEN 'Every caption here mentions the query term.'
      ELSE 'Every caption here mentions all ' || total_terms || ' query terms.' END
    WHEN 'partial_match' THEN 'No caption mentions every query term, so these are the captions mentioning at least '
      || least(2, total_terms) || ' of ' || total_terms || '.'
    ELSE 'No caption mentions these terms, so these are the closest images by score, cut where the similarity gradient flattens.' END
  || CASE WHEN coalesce(c.trimmed, 0) = 1 THEN ' One further image was trimmed by '
      || CASE mode WHEN 'image' THEN 'image score.' ELSE 'caption score.' END
    WHEN c.trimmed > 1 THEN ' ' || c.trimmed || ' further images were trimmed by '
      || CASE mode WHEN 'image' THEN 'image score.' ELSE 'caption score.' END
    ELSE '' END AS basis
FROM summary LEFT JOIN cutoff c USING (query_id)"""


def _batch_requests(spark, sf):
    emb, n = base.vectors(spark, sf)
    vec = emb.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    items = base.load(spark, sf, "benchmark")
    rows = items.select(
        F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query_id"), "text",
        F.pmod("item_id", F.lit(n)).alias("a"), F.pmod(F.col("item_id") + 1, F.lit(n)).alias("b"))
    return rows.join(vec.select(F.col("vec_id").alias("a"), F.col("v").alias("image_query")), "a") \
        .join(vec.select(F.col("vec_id").alias("b"), F.col("v").alias("caption_query")), "b")


_BATCH_REQ = (
    "req AS (SELECT 'q' || item_id AS query_id, b.text, 'hybrid' AS mode, 0 AS top_k, "
    "false AS trim, false AS has_filter, x.v AS iv, y.v AS cv FROM benchmark b, n "
    "JOIN emb x ON x.vec_id = b.item_id % n.n JOIN emb y ON y.vec_id = (b.item_id + 1) % n.n)")


def _batch(spark, sf):
    out = search(_batch_requests(spark, sf), base.corpus(spark, sf))
    return _rounded(out.results)


QUERIES["search_batch"] = _batch
ORACLE["search_batch"] = base.sql_search(_BATCH_REQ) + _SHOWN


# -- filtered searches ---------------------------------------------------------

_PEOPLE = [("both", "Guest 001"), ("both", "Guest 002"), ("mixed", "Guest 003"),
           ("apart", "Guest 001")]
_TRIPS = [("mixed", "event-002"), ("mixed", "event-004"), ("trips", "event-001"),
          ("trips", "event-003"), ("apart", "event-001")]


def _pools(spark, sf):
    people = spark.createDataFrame(_PEOPLE, "query_id string, name string")
    trips = spark.createDataFrame(_TRIPS, "query_id string, event_id string")
    named = base.members(spark, sf)
    joined = base.source_events(spark, sf)
    return people, images_with_all(people, named), trips, images_in_any(trips, joined)


def _sql_values(rows, name, columns):
    return f"{name} AS (SELECT * FROM (VALUES " + ", ".join(str(r) for r in rows) + \
        f") t({columns}))"


_SQL_POOLS = f"""{_sql_values(_PEOPLE, 'wanted', 'query_id, name')},
{_sql_values(_TRIPS, 'trips', 'query_id, event_id')},
need AS (SELECT query_id, count(*) AS need FROM wanted GROUP BY ALL),
person_pool AS (SELECT query_id, path FROM (SELECT w.query_id, m.path, count(*) AS have
  FROM wanted w JOIN members m USING (name) GROUP BY ALL) JOIN need USING (query_id)
  WHERE have = need),
event_pool AS (SELECT DISTINCT query_id, path FROM trips JOIN source_events USING (event_id)),
pool AS (SELECT query_id, path FROM person_pool p
    WHERE query_id NOT IN (SELECT query_id FROM trips)
      OR EXISTS (SELECT 1 FROM event_pool e WHERE e.query_id = p.query_id AND e.path = p.path)
  UNION ALL SELECT query_id, path FROM event_pool
    WHERE query_id NOT IN (SELECT query_id FROM wanted))"""
_SQL_MODEL = f"WITH {base.SQL_FACES}, {base.SQL_EVENTS}, {_SQL_POOLS} "

QUERIES["person_intersection"] = lambda spark, sf: _pools(spark, sf)[1]
ORACLE["person_intersection"] = _SQL_MODEL + "SELECT query_id, path FROM person_pool"
QUERIES["event_union"] = lambda spark, sf: _pools(spark, sf)[3]
ORACLE["event_union"] = _SQL_MODEL + "SELECT query_id, path FROM event_pool"
def _filter_pool(spark, sf):
    people = spark.createDataFrame(_PEOPLE, "query_id string, name string")
    trips = spark.createDataFrame(_TRIPS, "query_id string, event_id string")
    return filter_pool(people, base.members(spark, sf), trips, base.source_events(spark, sf))


QUERIES["filter_pool"] = _filter_pool
ORACLE["filter_pool"] = _SQL_MODEL + "SELECT query_id, path FROM pool"
QUERIES["filter_combine"] = lambda spark, sf: combine_pools(*_pools(spark, sf))
ORACLE["filter_combine"] = _SQL_MODEL + "SELECT query_id, path FROM pool"


def _filter_counts(spark, sf):
    people = spark.createDataFrame(_PEOPLE, "query_id string, name string")
    counts = filter_counts(people, base.members(spark, sf), "name")
    return counts.select("query_id", F.explode("counts").alias("name", "images"))


QUERIES["filter_counts"] = _filter_counts
ORACLE["filter_counts"] = _SQL_MODEL + (
    "SELECT w.query_id, w.name, count(DISTINCT m.path) AS images FROM wanted w "
    "JOIN members m USING (name) GROUP BY ALL")

_FILTERED = [
    {"query_id": "both", "text": "that tion"}, {"query_id": "mixed", "text": "zebra"},
    {"query_id": "trips", "text": "ing", "mode": "image"}, {"query_id": "open", "text": "zebra"},
]
_LISTED = [{"query_id": "both"}, {"query_id": "trips", "text": "people"}]
_EMPTY = [{"query_id": "nobody", "text": "that"}, {"query_id": "lonely", "text": ""}]


def _filtered(rows, open_ids=()):
    def run(spark, sf):
        asked = base.requests(spark, sf, rows).withColumn(
            "has_filter", ~F.col("query_id").isin(list(open_ids)))
        pool = combine_pools(*_pools(spark, sf))
        return _rounded(search(asked, base.corpus(spark, sf), pool).results)
    return run


def _sql_filtered(rows, flag):
    req = _SQL_POOLS + ", " + base.sql_requests(rows, flag)
    return base.sql_search(req, "pool") + _SHOWN


QUERIES["search_filtered"] = _filtered(_FILTERED, ["open"])
ORACLE["search_filtered"] = _sql_filtered(_FILTERED, "query_id <> 'open'")
QUERIES["search_filter_only"] = _filtered(_LISTED)
ORACLE["search_filter_only"] = _sql_filtered(_LISTED, "true")


_TYPED = [  # query_id, text, answer, persons, events; the first three give the pools above
    ("both", "Guest 001 Guest 002 that tion", '{"persons": ["guest 001", "Guest 002"]}', [], []),
    ("mixed", "zebra", None, ["Guest 003"], ["event-002", "EVENT-004"]),
    ("trips", "ing", '{"persons": [], "events": []}', [], ["event-001", "event-003"]),
    ("blank", "", None, [], []), ("vague", "zebra", None, ["guest"], []),
    ("wrong", "zebra", None, [], ["Trip to nowhere"]),
]


def _requests(spark, sf):
    """Requests as users send them: read, resolved, filtered and searched; refusals last."""
    typed = spark.createDataFrame(
        _TYPED, "query_id string, text string, answer string, persons array<string>, "
                "events array<string>")
    vectors = base.requests(spark, sf, [{"query_id": t[0]} for t in _TYPED]).drop("text", "mode")
    asked = typed.join(vectors, "query_id").withColumn(
        "mode", F.when(F.col("query_id") == "trips", "image").otherwise("hybrid"))
    outcome, refused = answer_requests(
        asked, base.corpus(spark, sf), base.members(spark, sf), _trip_index(spark, sf),
        base.source_events(spark, sf).select("event_id", "path"))
    return _rounded(outcome.results).select("query_id", "rank", "path", "score").unionByName(
        refused.select("query_id", F.lit(None).cast("long").alias("rank"),
                       F.col("status").alias("path"), F.lit(None).cast("double").alias("score")))


QUERIES["search_requests"] = _requests
ORACLE["search_requests"] = base.sql_search(
    _SQL_POOLS + ", " + base.sql_requests(_FILTERED[:3], "true"), "pool") + """,
known AS (SELECT DISTINCT name FROM members),
refused AS (SELECT 'blank' AS query_id, 'give q, person or event' AS why
  UNION ALL SELECT 'vague', CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE 'unknown' END FROM known
    WHERE starts_with(lower(name), 'guest')
  UNION ALL SELECT 'wrong', CASE WHEN count(*) = 0 THEN 'unknown' ELSE 'ambiguous' END
    FROM source_events WHERE contains(lower(name), 'trip to nowhere'))
SELECT query_id, rank, path, score FROM results
UNION ALL SELECT query_id, NULL, why, NULL FROM refused"""


def _payload(spark, sf):
    """Result rows with their records and their ranks in both indexes."""
    asked, corpus = base.requests(spark, sf, _PLAIN), base.corpus(spark, sf)
    items = base.documents(spark, sf).select(
        "pos", "path", F.sha2("text", 256).alias("sha256"), F.col("lang").alias("filename"),
        F.lit("").alias("caption"))
    rows = search_payload(search(asked, corpus), asked, corpus, items)
    return rows.select("query_id", "rank", "path", "sha256", "filename", "image_rank",
                       "caption_rank")


_PLAIN = [{"query_id": "words", "text": "that tion"}, {"query_id": "none", "text": "zebra"}]
QUERIES["search_payload"] = _payload
ORACLE["search_payload"] = base.sql_search(base.sql_requests(_PLAIN)) + """
SELECT s.query_id, s.rank, s.path, sha256(d.text) AS sha256, d.lang AS filename,
  r.ir AS image_rank, r.cr AS caption_rank
FROM results s JOIN docs d USING (path) LEFT JOIN ranks r USING (query_id, path)"""


def _empty_pool(spark, sf):
    asked = base.requests(spark, sf, _EMPTY).withColumn("has_filter", F.lit(True))
    pool = combine_pools(*_pools(spark, sf))
    out = search(asked, base.corpus(spark, sf), pool).summary
    return out.select("query_id", "basis_kind", "score_kind", "pool_size", "corpus_size",
                      "img_cut", "cap_cut", "low_confidence")


QUERIES["search_empty_pool"] = _empty_pool
ORACLE["search_empty_pool"] = base.sql_search(
    _SQL_POOLS + ", " + base.sql_requests(_EMPTY, "true"), "pool") + (
    "SELECT query_id, basis_kind, score_kind, pool_size, corpus_size, img_cut, cap_cut, "
    "low_confidence FROM summary")


# What filters say about themselves: typed names, sentences, counts.
_NAMED = [("both", "", ["Guest 001", "Guest 002"], []), ("mixed", "that", ["Guest 003"], ["Trip A"]),
          ("trips", "people", [], ["Trip A", "Trip B"]), ("apart", "", ["Guest 001"], ["Trip A"]),
          ("nobody", "that", ["Guest 999"], [])]


def _heads(spark, sf):
    """Summaries with their sentences and the image count of every filter."""
    named = spark.createDataFrame(
        _NAMED, "query_id string, text string, people array<string>, event_names array<string>")
    asked = base.requests(spark, sf, [{"query_id": r[0], "text": r[1]} for r in _NAMED]).drop(
        "text").join(named, "query_id").withColumn("has_filter", F.lit(True))
    people = spark.createDataFrame(_PEOPLE, "query_id string, name string")
    trips = spark.createDataFrame(_TRIPS, "query_id string, event_id string")
    members, joined = base.members(spark, sf), base.source_events(spark, sf)
    out = search(asked, base.corpus(spark, sf), filter_pool(people, members, trips, joined))
    counts = asked.join(
        filter_counts(people, members, "name").withColumnRenamed("counts", "person_counts"),
        "query_id", "left").join(
        filter_counts(trips, joined, "event_id").withColumnRenamed("counts", "event_counts"),
        "query_id", "left")
    entries = [F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string"))), "|").alias(c)
        for c in ("person_counts", "event_counts")]
    return payload_heads(out, counts).select(
        "query_id", "basis_kind", "basis", "pool_size", *entries)


QUERIES["search_heads"] = _heads
_SQL_NAMED = ", ".join(f"('{q}', '{t}', {p}, {e})" for q, t, p, e in (
    (q, t, f"{p}::VARCHAR[]", f"{e}::VARCHAR[]") for q, t, p, e in _NAMED))
# The sentences must read as the search itself words them.
ORACLE["search_heads"] = base.sql_search(_SQL_POOLS + ", " + base.sql_requests(
    [{"query_id": r[0], "text": r[1]} for r in _NAMED], "true"), "pool") + f""",
named(query_id, words, people, trips) AS (VALUES {_SQL_NAMED}),
pc AS (SELECT query_id, string_agg(name || '=' || n, '|' ORDER BY name) AS person_counts FROM (
  SELECT w.query_id, w.name, count(DISTINCT path) AS n FROM wanted w JOIN members USING (name)
  GROUP BY ALL) GROUP BY ALL),
ec AS (SELECT query_id, string_agg(event_id || '=' || n, '|' ORDER BY event_id) AS event_counts
  FROM (SELECT t.query_id, t.event_id, count(DISTINCT path) AS n FROM trips t
  JOIN source_events USING (event_id) GROUP BY ALL) GROUP BY ALL)
SELECT query_id, basis_kind, CASE basis_kind
    WHEN 'filter_only' THEN 'There is no query text, so this is everything matching '
      || array_to_string(list_filter([array_to_string(people, ' and '),
        array_to_string(n.trips, ' or ')], lambda s: s <> ''), ', within ') || ', in catalog order.'
    WHEN 'empty_pool' THEN 'Nothing matches this filter, so there was nothing to search.'
    WHEN 'full_match' THEN 'Every caption here mentions the query term.'
    ELSE 'No caption mentions these terms, so these are the closest images by score, cut where '
      || 'the similarity gradient flattens.' END AS basis,
  pool_size, person_counts, event_counts
FROM summary JOIN named n USING (query_id) LEFT JOIN pc USING (query_id)
LEFT JOIN ec USING (query_id)"""


def _trimmed(spark, sf):
    """What trimming cut from a matched set, with records."""
    asked = base.requests(spark, sf, [_TEXTS["search_trim"]])
    items = base.documents(spark, sf).select(
        "pos", "path", F.sha2("text", 256).alias("sha256"), F.col("lang").alias("filename"),
        F.lit("").alias("caption"))
    rows = payload_trimmed(search(asked, base.corpus(spark, sf)), items)
    return rows.select("query_id", "place", "path", F.round("score", 6).alias("score"), "sha256")


QUERIES["search_trimmed"] = _trimmed
ORACLE["search_trimmed"] = ORACLE["search_trim"].removesuffix(_SHOWN) + """
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS place, path,
  round(score, 6) AS score, sha256(text) AS sha256
FROM flagged JOIN docs USING (path) WHERE trimmed"""


# -- the parts of a search -------------------------------------------------------

def _terms(spark, sf):
    return base.documents(spark, sf).select(
        "path", F.array_join(content_terms(F.col("text")), " ").alias("terms"),
        F.array_join(F.array_sort(caption_terms(F.col("text"))), " ").alias("vocabulary"))


QUERIES["content_terms"] = _terms
_T = base.sql_tokens("text")
ORACLE["content_terms"] = f"""WITH {base.SQL_DOCS} SELECT path,
  array_to_string(list_transform(list_filter({_T}, lambda t: t NOT IN ({base.SQL_STOPWORDS})
    AND ({base.sql_fold('t')}) NOT IN ({base.SQL_STOPWORDS})), lambda t: {base.sql_fold('t')}), ' ')
    AS terms,
  array_to_string(list_sort(list_distinct(list_transform({_T}, lambda t: {base.sql_fold('t')}))), ' ')
    AS vocabulary FROM docs"""


def _hits(spark, sf):
    docs = base.documents(spark, sf).select("path", F.col("text").alias("caption"))
    asked = base.load(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), "text")
    return term_hits(docs, request_terms(asked))


QUERIES["term_hits"] = _hits
ORACLE["term_hits"] = f"""WITH {base.SQL_DOCS},
tok AS (SELECT item_id::VARCHAR AS query_id, unnest({_T}) AS t FROM benchmark),
terms AS (SELECT query_id, {base.sql_fold('t')} AS term, count(*) AS copies FROM tok
  WHERE t NOT IN ({base.SQL_STOPWORDS}) AND ({base.sql_fold('t')}) NOT IN ({base.SQL_STOPWORDS})
  GROUP BY ALL),
words AS (SELECT DISTINCT path, {base.sql_fold('t')} AS term
  FROM (SELECT path, unnest({_T}) AS t FROM docs))
SELECT query_id, path, sum(copies)::INT AS hits FROM words JOIN terms USING (term) GROUP BY ALL"""


def _term_matches(spark, sf):
    """Captions that hold four fifths of a benchmark item's terms."""
    docs = base.documents(spark, sf).select("path", F.col("text").alias("caption"))
    terms = request_terms(base.load(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), "text"))
    index = index_captions(docs)
    plans = term_plans(terms, index).withColumn("needed", F.ceil(F.col("total") * 0.8))
    return matches_over(index, plans, plans.count())


QUERIES["term_matches"] = _term_matches
ORACLE["term_matches"] = ORACLE["term_hits"].replace("SELECT query_id, path, sum", """,
total AS (SELECT query_id, ceil(sum(copies) * 0.8) AS needed FROM terms GROUP BY ALL),
found AS (SELECT query_id, path, sum""") + """)
SELECT found.* FROM found JOIN total USING (query_id) WHERE hits >= needed"""


def _vector_topk(spark, sf):
    """The ten nearest documents of every benchmark item's vector."""
    asked = prepare_requests(_batch_requests(spark, sf)).withColumn("depth", F.lit(10))
    blocks = request_blocks(asked.select(
        "query_id", "image_query", "caption_query", "has_filter", "depth"), asked.count())
    heads = best_rows(base.corpus(spark, sf).stored(), blocks, sides=("image",))
    best = salted_top(heads, ["query_id"], [F.desc("image_score"), F.col("path")], 10)
    return best.select("query_id", "path", F.col("rank").cast("long").alias("rank"))


QUERIES["vector_topk"] = _vector_topk
ORACLE["vector_topk"] = f"""WITH {base.SQL_DOCS}, {base.SQL_EMB}, {_BATCH_REQ},
s AS (SELECT query_id, d.path, list_inner_product(e.v, q.iv) AS score
  FROM docs d, n JOIN emb e ON e.vec_id = d.pos % n.n CROSS JOIN req q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM s)
SELECT query_id, path, rank FROM r WHERE rank <= 10"""


def _ranks(spark, sf):
    rows = [{"query_id": "all"}]
    ranks = modality_ranks(base.requests(spark, sf, rows), base.corpus(spark, sf))
    return ranks.select("side", "query_id", "path", F.round("score", 6).alias("score"), "rank")


QUERIES["modality_ranks"] = _ranks
_SQL_RANKS = f"""WITH {base.SQL_DOCS}, {base.SQL_EMB},
sides AS (SELECT 'image' AS side, 'all' AS query_id, d.path, list_inner_product(e.v,
    (SELECT v FROM emb WHERE vec_id = 0)) AS score
  FROM docs d, n JOIN emb e ON e.vec_id = d.pos % n.n
  UNION ALL SELECT 'caption', 'all', d.path, list_inner_product(e.v,
    (SELECT v FROM emb WHERE vec_id = 1))
  FROM docs d, n JOIN emb e ON e.vec_id = (d.pos + {base.CAPTION_SHIFT}) % n.n),
ranked AS (SELECT *, row_number() OVER (PARTITION BY side, query_id ORDER BY score DESC, path)
  AS rank FROM sides)"""
ORACLE["modality_ranks"] = _SQL_RANKS + (
    " SELECT side, query_id, path, round(score, 6) AS score, rank FROM ranked")


def _fusion(spark, sf):
    ranks = modality_ranks(base.requests(spark, sf, [{"query_id": "all"}]),
                           base.corpus(spark, sf))
    fused = fuse_rankings(ranks.filter("side = 'image'"), ranks.filter("side = 'caption'"))
    return fused.select("query_id", "path", "image_rank", "caption_rank",
                        F.round("score", 9).alias("score"))


QUERIES["rrf_fusion"] = _fusion
ORACLE["rrf_fusion"] = _SQL_RANKS + """
SELECT query_id, path, i.rank AS image_rank, c.rank AS caption_rank,
  round(1.0 / (60 + i.rank) + 1.0 / (60 + c.rank), 9) AS score
FROM ranked i JOIN ranked c USING (query_id, path) WHERE i.side = 'image' AND c.side = 'caption'"""


def _cut(spark, sf):
    """Where each person's falling series of purchase values flattens."""
    rows = base.load(spark, sf, "events").select("user_id", "event_id",
                                                 F.col("value").alias("score"))
    top = top_within(rows, ["user_id"], [F.desc("score"), F.col("event_id")], 40)
    return gradient_cut(top, ["user_id"])


QUERIES["gradient_cut"] = _cut
ORACLE["gradient_cut"] = """WITH r AS (SELECT user_id, value AS s, row_number() OVER
  (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events),
d AS (SELECT *, s - lead(s) OVER (PARTITION BY user_id ORDER BY r) AS drp FROM r WHERE r <= 40),
l AS (SELECT *, first_value(drp) OVER (PARTITION BY user_id ORDER BY r) AS ld FROM d),
c AS (SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 3 AND max(ld) > 0
  THEN min(r) FILTER (drp < ld * 0.35) END AS flat FROM l GROUP BY ALL)
SELECT user_id, coalesce(flat, n)::INT AS cut, flat IS NOT NULL AS plateau FROM c"""


def _trim(spark, sf):
    rows = base.load(spark, sf, "events").select("event_id", "user_id", "value")
    return spread_trim(rows, ["user_id"], "value")


QUERIES["spread_trim"] = _trim
ORACLE["spread_trim"] = """WITH b AS (SELECT user_id, max(value) AS hi, min(value) AS lo,
  count(*) AS n FROM events GROUP BY ALL)
SELECT event_id, user_id, value, (n >= 4 AND hi > lo AND value < hi - (hi - lo) * 0.8) AS trimmed
FROM events JOIN b USING (user_id)"""


def _captions(spark, sf):
    c = base.corpus(spark, sf)
    out = search(base.requests(spark, sf, [{"query_id": "full", "text": "that tion"}]), c)
    return result_captions(out, c.caption).select("query_id", "rank", "path", "caption")


QUERIES["result_captions"] = _captions
ORACLE["result_captions"] = base.sql_search(base.sql_requests(
    [{"query_id": "full", "text": "that tion"}])) + (
    "SELECT query_id, rank, path, text AS caption FROM results JOIN docs USING (path)")


# -- regression ---------------------------------------------------------------

_SUITE = [{"query_id": "that tion", "text": "that tion"}, {"query_id": "zebra", "text": "zebra"},
          {"query_id": "ing", "text": "ing"}]
_CHANGED = [{"query_id": "that tion", "text": "that tion", "trim": True},
            {"query_id": "zebra", "text": "zebra"}, {"query_id": "thth", "text": "thth"}]


def _measured(requests, corpus):
    return search(requests, corpus, options=Options()).results.select(
        F.col("query_id").alias("query"), base_name(F.col("path")).alias("filename"))


def _both(spark, sf):
    """The answers of both suites, from one search of all their requests."""
    marked = [row | {"query_id": side + row["query_id"]}
              for side, suite in (("b", _SUITE), ("m", _CHANGED)) for row in suite]
    found = materialize(_measured(base.requests(spark, sf, marked), base.corpus(spark, sf)),
                        "measured")
    return [found.filter(F.col("query").startswith(side)).select(
        F.expr("substring(query, 2)").alias("query"), "filename") for side in "bm"]


def _regression(spark, sf):
    return regression_report(*_both(spark, sf))


def _regression_files(spark, sf):
    return regression_files(*_both(spark, sf))


def _sql_run(rows):
    return "(" + base.sql_search(base.sql_requests(rows)) + \
        "SELECT query_id AS query, path AS filename FROM results)"


_SQL_DELTA = f"""WITH b AS {_sql_run(_SUITE)}, m AS {_sql_run(_CHANGED)},
d AS (SELECT query, filename, count(*) FILTER (o) AS was, count(*) FILTER (NOT o) AS now
  FROM (SELECT *, true AS o FROM b UNION ALL SELECT *, false FROM m) GROUP BY ALL)"""
QUERIES["regression_diff"] = _regression
ORACLE["regression_diff"] = _SQL_DELTA + """,
q AS (SELECT query, sum(was) AS was, sum(now) AS now, sum(greatest(now - was, 0)) AS gained,
  sum(greatest(was - now, 0)) AS lost FROM d GROUP BY ALL)
SELECT query, CASE WHEN was = 0 THEN 'new' WHEN now = 0 THEN 'dropped' ELSE 'moved' END AS kind,
  nullif(was, 0)::BIGINT AS was, nullif(now, 0)::BIGINT AS now, gained::BIGINT AS gained,
  lost::BIGINT AS lost FROM q WHERE was = 0 OR now = 0 OR gained > 0 OR lost > 0"""


def _regression_run(spark, sf):
    """A suite measured anew against the stored answers of another one."""
    corpus = base.corpus(spark, sf)
    return regression_run(base.requests(spark, sf, _CHANGED), corpus,
                          _measured(base.requests(spark, sf, _SUITE), corpus), Options())


QUERIES["regression_run"] = _regression_run
ORACLE["regression_run"] = ORACLE["regression_diff"]
QUERIES["regression_files"] = _regression_files
ORACLE["regression_files"] = _SQL_DELTA + """
SELECT query, filename, CASE WHEN now > was THEN 'gained' ELSE 'lost' END AS change,
  abs(now - was) AS copies FROM d WHERE now <> was"""


# -- reference resolution and understanding -------------------------------------

def _name_references(spark, sf):
    """References typed by customers: name pieces drawn from the order table."""
    orders = base.load(spark, sf, "orders")
    number = F.col("o_custkey").cast("string")
    return orders.select(
        F.when(F.pmod("o_orderkey", F.lit(4)) == 0, F.concat(F.lit("customer#"), F.lpad(number, 9, "0")))
        .when(F.pmod("o_orderkey", F.lit(4)) == 1, F.concat(F.lit("CUST"), number))
        .when(F.pmod("o_orderkey", F.lit(4)) == 2, F.lpad(number, 5, "0"))
        .otherwise(F.concat(F.lit(" #00000"), F.lpad(number, 4, "0"))).alias("reference"))


def _roster(spark, sf):
    return base.load(spark, sf, "customer").select(F.col("c_name").alias("name"))


_SQL_REFS = """refs AS (SELECT DISTINCT CASE o_orderkey % 4
  WHEN 0 THEN 'customer#' || lpad(o_custkey::VARCHAR, 9, '0') WHEN 1 THEN 'CUST' || o_custkey
  WHEN 2 THEN lpad(o_custkey::VARCHAR, 5, '0')
  ELSE ' #00000' || lpad(o_custkey::VARCHAR, 4, '0') END AS reference FROM orders),
asked AS (SELECT reference, lower(trim(reference)) AS q FROM refs),
cand AS (SELECT a.reference, c.c_name AS name, CASE WHEN lower(c.c_name) = q THEN 1
  WHEN starts_with(lower(c.c_name), q) THEN 2 WHEN contains(lower(c.c_name), q) THEN 3 END AS tier
  FROM asked a JOIN customer c ON contains(lower(c.c_name), q)),
best AS (SELECT reference, min(tier) AS tier FROM cand GROUP BY ALL),
picked AS (SELECT c.* FROM cand c JOIN best USING (reference, tier))"""
QUERIES["name_resolution"] = lambda spark, sf: resolve_names(
    _name_references(spark, sf), _roster(spark, sf))
ORACLE["name_resolution"] = f"""WITH {_SQL_REFS}
SELECT r.reference, CASE WHEN count(p.name) = 0 THEN 'unknown' WHEN count(p.name) > 1
  THEN 'ambiguous' ELSE 'ok' END AS status,
  CASE WHEN count(p.name) = 1 THEN min(p.name) END AS resolved, count(p.name)::INT AS candidates
FROM refs r LEFT JOIN picked p USING (reference) GROUP BY r.reference"""
QUERIES["name_candidates"] = lambda spark, sf: name_candidates(
    _name_references(spark, sf), _roster(spark, sf))
ORACLE["name_candidates"] = f"WITH {_SQL_REFS} SELECT reference, name, tier::INT AS tier FROM cand"


def _trip_index(spark, sf):
    return base.source_events(spark, sf).select("event_id", "name", "start").distinct()


def _trip_reference():
    number, pick = base.source_number(), F.pmod("pos", F.lit(5))
    return (
        F.when(pick == 0, F.format_string("event-%03d", number))
        .when(pick == 1, F.concat(F.lit("TRIP TO "), F.col("source")))
        .when(pick == 2, F.format_string("2015-%02d", number % 14))
        .when(pick == 3, F.concat(F.lit("to "), F.col("source")))
        .otherwise(F.format_string("-%03d", number)))


def _trip_references(spark, sf):
    return base.documents(spark, sf).select(_trip_reference().alias("reference"))


_SQL_TRIPS = f"""{base.SQL_DOCS}, {base.SQL_EVENTS},
idx AS (SELECT DISTINCT event_id, name, start FROM source_events),
said AS (SELECT *, CASE pos % 5 WHEN 0 THEN 'event-' || lpad(num::VARCHAR, 3, '0')
  WHEN 1 THEN 'TRIP TO ' || source WHEN 2 THEN '2015-' || lpad((num % 14)::VARCHAR, 2, '0')
  WHEN 3 THEN 'to ' || source ELSE '-' || lpad(num::VARCHAR, 3, '0') END AS reference
  FROM (SELECT *, regexp_extract(source, '(\\d+)$', 1)::INT AS num FROM docs)),
refs AS (SELECT DISTINCT reference FROM said),
asked AS (SELECT reference, lower(trim(reference)) AS q FROM refs),
cand AS (SELECT reference, event_id, name, CASE WHEN event_id = q THEN 1 WHEN lower(name) = q THEN 2
  ELSE 3 END AS tier FROM asked JOIN idx ON contains(lower(name), q) OR starts_with(start, q)
  OR contains(event_id, q)),
agg AS (SELECT reference, count(*) FILTER (tier = 1) AS n1, count(*) FILTER (tier = 2) AS n2,
  count(*) AS n, min(event_id) FILTER (tier = 1) AS e1, min(event_id) FILTER (tier = 2) AS e2,
  min(event_id) AS e3 FROM cand GROUP BY ALL)"""
QUERIES["event_resolution"] = lambda spark, sf: resolve_events(
    _trip_references(spark, sf), _trip_index(spark, sf))
_SQL_RESOLVED = f"""{_SQL_TRIPS},
o AS (SELECT reference, CASE WHEN n1 > 0 OR n2 = 1 THEN 1 ELSE coalesce(n, 0) END AS c,
  CASE WHEN n1 > 0 THEN e1 WHEN n2 = 1 THEN e2 ELSE e3 END AS v
  FROM refs LEFT JOIN agg USING (reference))"""
ORACLE["event_resolution"] = f"""WITH {_SQL_RESOLVED}
SELECT reference, CASE WHEN c = 0 THEN 'unknown' WHEN c > 1 THEN 'ambiguous' ELSE 'ok' END AS status,
  CASE WHEN c = 1 THEN v END AS resolved, c::INT AS candidates FROM o"""
QUERIES["event_candidates"] = lambda spark, sf: event_candidates(
    _trip_references(spark, sf), _trip_index(spark, sf))
ORACLE["event_candidates"] = f"WITH {_SQL_TRIPS} SELECT reference, event_id, name, tier::INT AS tier FROM cand"


def _answers(spark, sf):
    """A query log with model answers, one per order."""
    orders = base.load(spark, sf, "orders")
    key, cust = F.col("o_orderkey"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")
    name = F.concat(F.lit("Customer#"), cust)
    said = F.concat(F.lit('Sure: {"persons": ["'), name, F.lit('"], "events": []} done'))
    pick = F.pmod(key, F.lit(7))
    return orders.select(
        key.cast("string").alias("query_id"),
        F.concat(F.lit("Photos of "), F.when(pick == 5, F.lit("somebody else")).otherwise(name),
                 F.lit(" at "), F.col("o_orderpriority")).alias("text"),
        F.when(pick == 0, F.lit(None).cast("string"))
        .when(pick == 1, F.lit("I cannot {answer"))
        .when(pick == 2, F.concat(F.lit('{"persons": "'), name, F.lit('"}')))
        .when(pick == 3, F.concat(F.lit('{"persons": ["Zebediah", "'), name,
                                  F.lit('", 7, " "]}')))
        .when(pick == 4, F.lit('{"persons": ["a", "b", "c", "d"]}'))
        .otherwise(said).alias("answer"))


def _event_answers(spark, sf):
    """Queries answered with events: ids, names, months and parts of them, once or twice or not."""
    pick, text = F.pmod("pos", F.lit(4)), F.pmod("pos", F.lit(3))
    one = F.concat(F.lit('"'), _trip_reference(), F.lit('"'))
    return base.documents(spark, sf).select(
        F.col("path").alias("query_id"),
        F.when(text == 0, F.concat(F.lit("Sunset of the TRIP to "), F.col("source")))
        .when(text == 1, F.lit("sunset beach"))
        .otherwise(F.format_string("at event %d", base.source_number())).alias("text"),
        F.when(pick == 3, F.lit('{"persons": [], "events": []}'))
        .when(pick == 2, F.concat(F.lit('{"events": ['), one, F.lit(", "), one, F.lit("]}")))
        .otherwise(F.concat(F.lit('{"events": ['), one, F.lit("]}"))).alias("answer"))


def _understanding(answers):
    return lambda spark, sf: _understood(understand(
        answers(spark, sf), _roster(spark, sf), _trip_index(spark, sf)))


def _understood(out):
    return out.select(
        "query_id", "query", F.array_join("persons", "|").alias("persons"),
        F.array_join("events", "|").alias("events"), "terms",
        F.array_join(F.transform("dropped", lambda d: F.concat(
            d["text"], F.lit("/"), d["as"], F.lit("/"), d["why"])), "|").alias("dropped"),
        "source", "note")


QUERIES["query_understanding"] = _understanding(_answers)
ORACLE["query_understanding"] = """WITH a AS (SELECT o_orderkey::VARCHAR AS query_id,
  'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS name, o_orderkey % 7 AS pick,
  o_orderpriority AS pr, lpad(o_custkey::VARCHAR, 9, '0') AS num FROM orders),
b AS (SELECT *, 'Photos of ' || CASE WHEN pick = 5 THEN 'somebody else' ELSE name END || ' at ' || pr
  AS query, EXISTS (SELECT 1 FROM customer c WHERE c.c_name = a.name) AS known FROM a)
SELECT query_id, query, CASE WHEN known AND pick IN (2, 3, 6) THEN name ELSE '' END AS persons,
  '' AS events,
  CASE WHEN known AND pick IN (2, 3, 6) THEN array_to_string(list_filter(
      string_split(query, ' '), lambda w: lower(regexp_replace(w, '[^\\p{L}\\p{N}_]', '', 'g'))
      NOT IN ('customer', num)), ' ') ELSE query END AS terms,
  CASE WHEN pick = 3 THEN 'Zebediah/person/unknown' || CASE WHEN known THEN '' ELSE '|' || name
      || '/person/unknown' END
    WHEN pick = 4 THEN '4 persons/person/too many to be a filter'
    WHEN pick = 5 AND known THEN name || '/person/not named in the query'
    WHEN pick IN (2, 5, 6) AND NOT known THEN name || '/person/unknown' ELSE '' END AS dropped,
  CASE WHEN pick IN (0, 1) THEN 'fallback' ELSE 'model' END AS source,
  CASE WHEN pick = 0 THEN 'model unavailable' WHEN pick = 1 THEN 'model returned no usable JSON'
    WHEN known AND pick IN (2, 3, 6) THEN '' ELSE 'nothing proposed survived validation' END AS note
FROM b"""
QUERIES["event_understanding"] = _understanding(_event_answers)
ORACLE["event_understanding"] = f"""WITH {_SQL_RESOLVED},
a AS (SELECT path AS query_id, pos % 4 AS pick, pos % 3 <> 1 AS named, CASE pos % 3
    WHEN 0 THEN 'Sunset of the TRIP to ' || source WHEN 1 THEN 'sunset beach'
    ELSE 'at event ' || num END AS query, reference, c, CASE WHEN c = 1 THEN v END AS v
  FROM said JOIN o USING (reference)),
b AS (SELECT a.*, pick <> 3 AND c = 1 AND named AS kept, name,
    list_filter({base.sql_tokens('name')}, lambda t: len(t) > 1) AS taken,
    CASE WHEN c > 1 THEN reference || '/event/ambiguous' WHEN c = 0 THEN reference
      || '/event/unknown' WHEN NOT named THEN name || '/event/not named in the query' END AS why
  FROM a LEFT JOIN idx ON event_id = v)
SELECT query_id, query, '' AS persons, CASE WHEN kept THEN v ELSE '' END AS events,
  CASE WHEN kept THEN array_to_string(list_filter(string_split(query, ' '), lambda w:
    NOT list_contains(taken, lower(regexp_replace(w, '[^\\p{{L}}\\p{{N}}_]', '', 'g')))), ' ')
    ELSE query END AS terms,
  CASE WHEN pick = 3 OR why IS NULL THEN '' WHEN pick = 2 THEN why || '|' || why ELSE why END
    AS dropped,
  CASE WHEN pick = 3 THEN 'fallback' ELSE 'model' END AS source,
  CASE WHEN pick = 3 THEN 'no person or event named' WHEN kept THEN ''
    ELSE 'nothing proposed survived validation' END AS note FROM b"""
