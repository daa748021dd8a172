"""Registered duplicate-detection queries over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions.hashing import text_signatures
from shelfmark.operators.components import connected_components
from shelfmark.operators.duplicates import (
    duplicate_report, exact_members, keepers, near_members, nested_groups, redundancy,
    similar_members,
)
from shelfmark.operators.hamming import hamming_pairs
from shelfmark.registry import base
from shelfmark.session import materialize

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

COSINE = 0.45  # the given vectors are random: 0.92 finds nothing


def _catalog(spark, sf):
    """Documents as catalog rows; sizes and dates follow from the id."""
    pos = F.col("pos")
    return base.documents(spark, sf).select(
        pos, "path", F.when(F.length(F.trim("text")) > 0, F.sha2("text", 256)).otherwise("")
        .alias("sha256"),
        (F.pmod(pos * 37, F.lit(5)) * 100 + 200).cast("int").alias("width"),
        (F.pmod(pos * 11, F.lit(3)) * 100 + 300).cast("int").alias("height"),
        F.when(F.pmod(pos, F.lit(4)) == 0, "").otherwise(F.format_string(
            "20%02d:01:01 00:00:00", F.pmod(pos, F.lit(20)))).alias("best_exif_date"))


def _signatures(spark, sf):
    return text_signatures(base.documents(spark, sf), "pos", "text")


def _vectors(spark, sf):
    emb, n = base.vectors(spark, sf)
    docs = base.documents(spark, sf).select("pos", F.pmod("pos", F.lit(n)).alias("vec_id"))
    return docs.join(emb, "vec_id").select("pos", F.col("embedding").alias("vec"))


_BITS = ", ".join(
    f"sum((h >> {i}) & 1) * 2 > count(*) AS b{i}" for i in range(64))
_SIG = " | ".join(f"(CASE WHEN b{i} THEN {1 << i}::UBIGINT ELSE 0::UBIGINT END)" for i in range(64))
_SQL_SIGNATURES = f"""{base.SQL_DOCS}, {base.SQL_EMB},
cat AS (SELECT pos, path, CASE WHEN length(trim(text)) > 0 THEN sha256(text) ELSE '' END AS sha,
  pos * 37 % 5 * 100 + 200 AS width, pos * 11 % 3 * 100 + 300 AS height,
  CASE WHEN pos % 4 = 0 THEN '' ELSE '20' || lpad((pos % 20)::VARCHAR, 2, '0')
    || ':01:01 00:00:00' END AS taken FROM docs),
tok AS (SELECT pos, unnest({base.sql_tokens('text')}) AS t FROM docs),
hsh AS (SELECT pos, (('0x' || substr(md5(t), 1, 8))::UBIGINT << 32)
  | ('0x' || substr(md5(t), 9, 8))::UBIGINT AS h FROM tok),
bits AS (SELECT pos, {_BITS} FROM hsh GROUP BY pos),
sigs AS MATERIALIZED (SELECT pos, {_SIG} AS sig FROM bits),
exact AS (SELECT pos, min(pos) OVER (PARTITION BY sha) AS lead,
  count(*) OVER (PARTITION BY sha) AS n FROM cat WHERE sha <> ''),
lone AS (SELECT sig, min(pos) AS pos FROM sigs GROUP BY sig),
near AS MATERIALIZED (SELECT a.pos AS a, b.pos AS b FROM lone a JOIN lone b
  ON bit_count(xor(a.sig, b.sig)) <= 6),
vec AS (SELECT d.pos, e.vec_id, list_transform(e.v,
    lambda x: x / sqrt(list_inner_product(e.v, e.v))) AS v
  FROM docs d, n JOIN emb e ON e.vec_id = d.pos % n.n),
vlone AS (SELECT vec_id, min(pos) AS pos, any_value(v) AS v FROM vec GROUP BY vec_id),
close AS MATERIALIZED (SELECT a.pos AS a, b.pos AS b FROM vlone a JOIN vlone b
  ON a.pos = b.pos OR list_inner_product(a.v, b.v) >= {COSINE}),
nreach(a, b) AS (SELECT pos, pos FROM lone UNION SELECT r.a, n.b FROM nreach r JOIN near n
  ON n.a = r.b),
creach(a, b) AS (SELECT pos, pos FROM vlone UNION SELECT r.a, c.b FROM creach r JOIN close c
  ON c.a = r.b),
nlab AS (SELECT b AS pos, min(a) AS lead FROM nreach GROUP BY b),
clab AS (SELECT b AS pos, min(a) AS lead FROM creach GROUP BY b),
nmem0 AS (SELECT s.pos, l.lead FROM sigs s JOIN lone o USING (sig) JOIN nlab l ON l.pos = o.pos),
nmem AS (SELECT pos, lead FROM (SELECT *, count(*) OVER (PARTITION BY lead) AS n FROM nmem0)
  WHERE n > 1),
cmem0 AS (SELECT v.pos, l.lead FROM vec v JOIN vlone o USING (vec_id) JOIN clab l ON l.pos = o.pos),
cmem AS (SELECT pos, lead FROM (SELECT *, count(*) OVER (PARTITION BY lead) AS n FROM cmem0)
  WHERE n > 1),
emem AS (SELECT pos, lead FROM exact WHERE n > 1),
nkeep AS (SELECT * FROM nmem WHERE lead IN (SELECT lead FROM nmem
  WHERE pos NOT IN (SELECT pos FROM emem))),
prior AS (SELECT pos FROM emem UNION SELECT pos FROM nkeep),
ckeep AS (SELECT * FROM cmem WHERE lead IN (SELECT lead FROM cmem
  WHERE pos NOT IN (SELECT pos FROM prior))),
tiers AS (SELECT 'EXACT' AS tier, * FROM emem UNION ALL SELECT 'NEAR', * FROM nkeep
  UNION ALL SELECT 'SIMILAR', * FROM ckeep),
num AS (SELECT tier, lead, lower(tier) || '-' || row_number() OVER (PARTITION BY tier ORDER BY lead)
  AS grp FROM (SELECT DISTINCT tier, lead FROM tiers)),
rep AS (SELECT t.tier, m.grp, c.*, row_number() OVER (PARTITION BY t.tier, t.lead ORDER BY
  width * height DESC, CASE WHEN taken = '' THEN '9999' ELSE taken END DESC, t.pos) = 1 AS keep
  FROM tiers t JOIN num m USING (tier, lead) JOIN cat c USING (pos))"""
_HEAD = f"WITH RECURSIVE {_SQL_SIGNATURES} "

QUERIES["dedup_exact"] = lambda spark, sf: exact_members(_catalog(spark, sf))
ORACLE["dedup_exact"] = _HEAD + "SELECT pos, lead FROM emem"
QUERIES["text_signature"] = lambda spark, sf: _signatures(spark, sf).select(
    "pos", F.lpad(F.lower(F.hex("signature")), 16, "0").alias("signature"))
ORACLE["text_signature"] = _HEAD + (
    "SELECT pos, lpad(format('{:x}', sig), 16, '0') AS signature FROM sigs")


def _lone(spark, sf):
    rows = _signatures(spark, sf).groupBy("signature").agg(F.min("pos").alias("id"))
    return materialize(rows.select("id", "signature"), "signatures")


QUERIES["hamming_pairs"] = lambda spark, sf: hamming_pairs(_lone(spark, sf)).select(
    "src", "dst", F.col("bits").cast("int").alias("bits"))
ORACLE["hamming_pairs"] = _HEAD + """SELECT a.pos AS src, b.pos AS dst,
  bit_count(xor(a.sig, b.sig))::INT AS bits FROM lone a JOIN lone b ON a.pos < b.pos
  AND bit_count(xor(a.sig, b.sig)) <= 6"""
QUERIES["dedup_near"] = lambda spark, sf: near_members(
    materialize(_signatures(spark, sf), "signatures"))
ORACLE["dedup_near"] = _HEAD + "SELECT pos, lead FROM nmem"
QUERIES["dedup_similar"] = lambda spark, sf: similar_members(_vectors(spark, sf), COSINE)
ORACLE["dedup_similar"] = _HEAD + "SELECT pos, lead FROM cmem"


def _report(spark, sf):
    return duplicate_report(
        _catalog(spark, sf), materialize(_signatures(spark, sf), "signatures"),
        _vectors(spark, sf), threshold=COSINE)


QUERIES["dedup_report"] = lambda spark, sf: _report(spark, sf).select(
    "tier", "group", "keep", "pos", "path", "width", "height", "best_exif_date")
ORACLE["dedup_report"] = _HEAD + """SELECT tier, grp AS "group", keep, pos, path,
  width::INT AS width, height::INT AS height, taken AS best_exif_date FROM rep"""
QUERIES["dedup_totals"] = lambda spark, sf: redundancy(_report(spark, sf))
ORACLE["dedup_totals"] = _HEAD + """SELECT tier, count(DISTINCT grp) AS groups,
  count(*) AS entries, CASE tier WHEN 'SIMILAR' THEN 0 ELSE count(*) - count(DISTINCT grp) END
  AS redundant FROM rep GROUP BY tier"""


def _nested(spark, sf):
    exact = exact_members(_catalog(spark, sf)).withColumn("tier", F.lit("EXACT"))
    kept = keepers(exact, _catalog(spark, sf), ["lead"]).select("lead", "keeper")
    rows = exact.join(kept, "lead").join(_catalog(spark, sf).select("pos", "path"), "pos")
    rows = rows.select("tier", F.col("lead").cast("string").alias("group"), "pos", "path",
                       (F.col("pos") == F.col("keeper")).alias("keep"))
    return nested_groups(rows, 3).select(
        "tier", "group", "page", F.array_join(F.transform("members", lambda m: F.concat(
            m["path"], F.lit("="), m["keep"].cast("string"))), ",").alias("members"))


QUERIES["dedup_nested"] = _nested
ORACLE["dedup_nested"] = _HEAD + """, e AS (SELECT r.*, m.lead, row_number() OVER
  (PARTITION BY m.lead ORDER BY r.pos) AS spot FROM rep r JOIN emem m USING (pos)
  WHERE r.tier = 'EXACT')
SELECT tier, lead::VARCHAR AS "group", ((spot - 1) // 3)::INT AS page,
  string_agg(path || '=' || keep, ',' ORDER BY pos) AS members
FROM e GROUP BY tier, lead, (spot - 1) // 3"""
QUERIES["keeper_choice"] = lambda spark, sf: keepers(
    exact_members(_catalog(spark, sf)), _catalog(spark, sf), ["lead"])
ORACLE["keeper_choice"] = _HEAD + """SELECT m.lead, max(pos) FILTER (keep) AS keeper,
  count(*) AS size FROM rep JOIN emem m USING (pos) WHERE tier = 'EXACT' GROUP BY m.lead"""


def _graph(spark, sf):
    """Orders linked to their customer, customers to the one a tenth of their id."""
    orders = base.load(spark, sf, "orders").select(
        F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 10_000_000).alias("dst"))
    # A customer in debt is linked with itself only.
    chain = base.load(spark, sf, "customer").select(
        F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_custkey") / 10))
        .otherwise(F.col("c_custkey")).alias("src"), F.col("c_custkey").alias("dst"))
    return orders.unionByName(chain)


QUERIES["connected_components"] = lambda spark, sf: connected_components(_graph(spark, sf))
ORACLE["connected_components"] = """WITH RECURSIVE e AS (
  SELECT o_custkey AS s, o_orderkey + 10000000 AS d FROM orders
  UNION ALL SELECT CASE WHEN c_acctbal >= 0 THEN c_custkey // 10 ELSE c_custkey END, c_custkey
  FROM customer),
u AS (SELECT s, d FROM e WHERE s <> d UNION SELECT d, s FROM e WHERE s <> d),
tops AS (SELECT DISTINCT s AS node FROM u),
climb(node, spot) AS (SELECT node, node FROM tops
  UNION SELECT c.node, u.d FROM climb c JOIN u ON u.s = c.spot WHERE u.d < c.spot)
SELECT node, min(spot) AS component FROM climb GROUP BY node"""
