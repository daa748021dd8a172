"""The registered queries of this package over the given tables, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm.ball_tree import top_k
from shelfmark.llm.bitplane import token_files
from shelfmark.llm.filter_audit import audit
from shelfmark.llm.license_templates import license_labels
from shelfmark.llm.log_bilinear import score_texts
from shelfmark.llm.minhash_bayes import near_duplicates
from shelfmark.llm.mixture_packing import pack
from shelfmark.llm.sentence_spans import remove_repeats
from shelfmark.llm.sphere_cells import near_vectors
from shelfmark.llm.temperature_mix import mix_order
from shelfmark.llm.toxic_automata import toxicity
from shelfmark.llm.url_cascade import judge_urls
from shelfmark.llm.vector_codes import vector_codes

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"),
         ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_url_cascade(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {_RULES_SQL} AS t(host, path, verdict)")
    return judge_urls(_table(spark, sf, "pages"), rules)


def op2_minhash_bayes(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(_table(spark, sf, "documents"))


def op3_sphere_cells(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors(_table(spark, sf, "embeddings"))


def op4_mixture_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(_table(spark, sf, "documents"), VOCABULARY, end_id=1)


def op5_toxic_automata(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op6_bitplane_files(spark: SparkSession, sf: str) -> DataFrame:
    return token_files(_table(spark, sf, "documents"), VOCABULARY, end_id=2)


def op7_sentence_spans(spark: SparkSession, sf: str) -> DataFrame:
    return remove_repeats(_table(spark, sf, "documents").select("doc_id", "text"), whole=3)


def op8_temperature_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mix_order(_table(spark, sf, "documents"))


def op9_ball_tree(spark: SparkSession, sf: str) -> DataFrame:
    return top_k(_table(spark, sf, "embeddings"))


def op10_log_bilinear(spark: SparkSession, sf: str) -> DataFrame:
    return score_texts(_table(spark, sf, "documents"))


def op11_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    return vector_codes(_table(spark, sf, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op13_license_templates(spark: SparkSession, sf: str) -> DataFrame:
    return license_labels(_table(spark, sf, "documents"))


QUERIES = {
    "op1_url_cascade": op1_url_cascade,
    "op2_minhash_bayes": op2_minhash_bayes,
    "op3_sphere_cells": op3_sphere_cells,
    "op4_mixture_packing": op4_mixture_packing,
    "op5_toxic_automata": op5_toxic_automata,
    "op6_bitplane_files": op6_bitplane_files,
    "op7_sentence_spans": op7_sentence_spans,
    "op8_temperature_mix": op8_temperature_mix,
    "op9_ball_tree": op9_ball_tree,
    "op10_log_bilinear": op10_log_bilinear,
    "op11_vector_codes": op11_vector_codes,
    "op12_filter_audit": op12_filter_audit,
    "op13_license_templates": op13_license_templates,
}

_SQUARE = ("(list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, e.x)"
           " + list_inner_product(e.x, e.x))::BIGINT")


def _codes_sql(rounds: int = 4) -> str:
    """Rounds of assigning and moving as one chain of tables; e is an entry's number."""
    tables = ["""
kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label,
  [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL
  AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
v AS MATERIALIZED (SELECT r, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS x
  FROM kept, range(4) AS t(p)),
e0 AS MATERIALIZED (SELECT p, r AS e, x FROM v WHERE r < 256)"""]
    for n in range(rounds + 1):
        tables.append(f"""
a{n} AS MATERIALIZED (SELECT r, p, any_value(v.x) AS x, min({_SQUARE} * 256 + e) AS m
  FROM v JOIN e{n} AS e USING (p) GROUP BY r, p)""")
        tables.append(f"""
m{n} AS (SELECT p, e, list(c ORDER BY i) AS x FROM (
  SELECT p, m % 256 AS e, i, floor(sum(x[i]) / count(*)) AS c
  FROM a{n}, (SELECT unnest(range(1, 1 + max(len(x)))) AS i FROM v) GROUP BY p, m % 256, i)
  GROUP BY p, e),
e{n + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{n}.x, e{n}.x) AS x
  FROM e{n} LEFT JOIN m{n} USING (p, e))""")
    last = rounds
    return f"""
WITH {",".join(tables)},
coded AS (SELECT vec_id, label, string_agg(format('{{:02x}}', m % 256), '' ORDER BY p) AS code,
  sum(m // 256)::BIGINT AS error FROM kept JOIN a{last} USING (r) GROUP BY r, vec_id, label),
digest AS (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS h
  FROM (SELECT p, e, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM e{last}))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  h AS codebooks_sha256 FROM coded, digest"""


ORACLE = {
    "op11_vector_codes": _codes_sql(),
    "op12_filter_audit": """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
  min(doc_id) OVER (PARTITION BY t) AS lowest FROM d),
facts AS (SELECT doc_id, part, (len(ws) < 50)::INT
  + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
  + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > lowest)::INT AS mask FROM w),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic
  FROM labels GROUP BY doc_id),
counts AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good,
  sum(coalesce(toxic, 0)) AS toxic FROM facts LEFT JOIN marks USING (doc_id) GROUP BY part, mask),
l(c, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
perms AS (SELECT l1.c || l2.c || l3.c || l4.c || l5.c AS o, [l1.b, l2.b, l3.b, l4.b, l5.b] AS bs
  FROM l l1, l l2, l l3, l l4, l l5 WHERE l1.b + l2.b + l3.b + l4.b + l5.b = 31
  AND len(list_distinct([l1.b, l2.b, l3.b, l4.b, l5.b])) = 5),
steps AS (SELECT o, s, bs[s] AS bit, coalesce(list_sum(bs[1:s - 1]), 0)::INT AS before
  FROM perms, range(1, 6) AS t(s)),
sums AS (SELECT part, o, s, bit,
  coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY part, o, s, bit)
SELECT part, o AS filter_order, s::INT AS step, kept, removed, redundant, unique_fails, good_lost,
  toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM sums""",
    "op3_sphere_cells": """
WITH RECURSIVE unit AS (SELECT vec_id, embedding::DOUBLE[] AS v,
  sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id
  AND a.n > 0 AND b.n > 0 AND len(a.v) = len(b.v)
  AND list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(lo, vec_id)) AS component_id,
  vec_id <= coalesce(lo, vec_id) AS kept FROM embeddings
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, min(b) AS lo FROM reach GROUP BY a) USING (vec_id)""",
    "op8_temperature_mix": """
WITH RECURSIVE light AS (SELECT doc_id, source, coalesce('=' || source, 'null') AS k,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents),
s AS (SELECT k, count(*) AS docs, sum(tokens)::BIGINT AS tokens FROM light GROUP BY k),
ts AS (SELECT list(tokens::DOUBLE ORDER BY tokens) AS l FROM s WHERE tokens > 0),
bisect(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE (lo + hi) / 2 END, CASE WHEN ok THEN (lo + hi) / 2
    ELSE hi END
  FROM (SELECT *, list_max([pow(t, (lo + hi) / 2 - 1) FOR t IN l])
      / list_min([pow(t, (lo + hi) / 2 - 1) FOR t IN l]) <= 2.0 AS ok FROM bisect, ts)
  WHERE i < 60),
alpha AS (SELECT hi AS a FROM bisect WHERE i = 60),
least AS (SELECT min(pow(tokens, a) / tokens) AS m FROM s, alpha WHERE tokens > 0),
budgets AS (SELECT k, docs, tokens, CASE WHEN tokens = 0 THEN 0
  ELSE greatest(round(pow(tokens, a) / m)::BIGINT, tokens) END AS budget FROM s, alpha, least),
plan AS (SELECT k, CASE WHEN tokens = 0 THEN 1 ELSE budget // tokens END AS passes,
  CASE WHEN tokens = 0 THEN 0 ELSE budget % tokens END AS rest,
  ceil(docs / 4096)::BIGINT AS blocks FROM budgets),
copies AS (SELECT doc_id, source, l.k, tokens, passes, rest, blocks, unnest(range(passes + 1))
  AS epoch FROM light l JOIN plan USING (k)),
keyed AS (SELECT *, md5('1|' || epoch || '|' || coalesce(doc_id::VARCHAR, 'null')) AS mix_key
  FROM copies),
placed AS (SELECT *, ('0x' || substr(mix_key, 1, 8))::BIGINT % blocks AS block FROM keyed),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY k, epoch ORDER BY block, mix_key) AS upto
  FROM placed)
SELECT doc_id, source, tokens, epoch, block, mix_key FROM summed
WHERE epoch < passes OR rest > 0 AND upto <= rest""",
    "op9_ball_tree": """
WITH q AS (SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL
  AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)
SELECT a.vec_id AS query_id,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.v, b.v) DESC, b.vec_id)::INT
    AS rank,
  b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
FROM q a JOIN q b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 20 = 0
QUALIFY rank <= 20""",
    "op1_url_cascade": f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULES_SQL}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0
  THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id,
  translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)
SELECT page_id, host, path, rule_host || rule_path AS rule,
  coalesce(rule_verdict, 'allow') AS verdict
FROM parts LEFT JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host))
  AND starts_with(path, rule_path)
QUALIFY row_number() OVER (PARTITION BY page_id
  ORDER BY length(rule_host || rule_path) DESC NULLS LAST) = 1""",
}
