"""Registered colour and timeline queries; line items stand for pixels of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions.colour import circular_mean, with_hsv
from shelfmark.operators.palette import (
    dominant_hue, mean_lightness, nearest_anchor, palette, palette_marks, palette_totals,
    timeline,
)
from shelfmark.registry import base
from shelfmark.session import materialize

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _pixels(spark, sf):
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return base.load(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("id"),
        F.pmod(cents, F.lit(256)).cast("int").alias("r"),
        F.pmod(F.col("l_partkey") * 7 + F.col("l_linenumber"), F.lit(256)).cast("int").alias("g"),
        F.when(F.col("l_returnflag") == "N", F.pmod(cents, F.lit(256)))
        .otherwise(F.pmod(F.col("l_suppkey") * 3, F.lit(256))).cast("int").alias("b"))


_SQL_PIXELS = """px AS (SELECT l_partkey AS id, round(l_extendedprice * 100)::BIGINT % 256 AS r,
  (l_partkey * 7 + l_linenumber) % 256 AS g, CASE WHEN l_returnflag = 'N'
    THEN round(l_extendedprice * 100)::BIGINT % 256 ELSE l_suppkey * 3 % 256 END AS b FROM lineitem),
unit AS (SELECT id, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b FROM px),
span AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS sp FROM unit),
sect AS (SELECT *, CASE WHEN sp = 0 THEN 0.0
  WHEN hi = r THEN (g - b) / sp + CASE WHEN g < b THEN 6 ELSE 0 END WHEN hi = g THEN (b - r) / sp + 2
  ELSE (r - g) / sp + 4 END * 60 AS h FROM span),
hsv AS (SELECT id, r, g, b, h % 360 AS hue, CASE WHEN hi = 0 THEN 0.0 ELSE sp / hi END AS sat,
  hi AS val FROM sect),
lit AS (SELECT *, floor(hue / 10)::INT AS bin FROM hsv WHERE sat >= 0.15 AND val >= 0.15),
peak AS (SELECT id, bin FROM lit GROUP BY id, bin QUALIFY row_number() OVER
  (PARTITION BY id ORDER BY count(*) DESC, bin) = 1),
near AS (SELECT l.id, l.hue FROM lit l JOIN peak p USING (id)
  WHERE abs((l.hue - (p.bin + 0.5) * 10 + 180 + CASE WHEN l.hue - (p.bin + 0.5) * 10 < -180
    THEN 360 ELSE 0 END) % 360 - 180) <= 10),
hues AS (SELECT id, (degrees(atan2(avg(sin(radians(hue))), avg(cos(radians(hue))))) + 360) % 360
  AS hue FROM near GROUP BY id),
lin AS (SELECT id, list_sum(list_transform([(r, 0.2126), (g, 0.7152), (b, 0.0722)], lambda c:
  CASE WHEN c[1] <= 0.04045 THEN c[1] / 12.92 ELSE pow((c[1] + 0.055) / 1.055, 2.4) END * c[2]))
  AS y FROM unit),
light AS (SELECT id, greatest(0, least(1, CASE WHEN avg(y) <= 0.008856 THEN avg(y) * 903.3
  ELSE pow(avg(y), 1.0 / 3.0) * 116 - 16 END / 100)) AS lightness FROM lin GROUP BY id),
colour AS (SELECT i.id, h.hue, l.lightness FROM (SELECT DISTINCT id FROM px) i
  LEFT JOIN hues h USING (id) JOIN light l USING (id))"""
_HEAD = f"WITH {_SQL_PIXELS} "

QUERIES["pixel_hsv"] = lambda spark, sf: with_hsv(_pixels(spark, sf)).groupBy(
    "id", "r", "g", "b").agg(F.round(F.max("hue"), 6).alias("hue"),
                             F.round(F.max("saturation"), 6).alias("sat"))
ORACLE["pixel_hsv"] = _HEAD + """SELECT id, round(r * 255)::INT AS r, round(g * 255)::INT AS g,
  round(b * 255)::INT AS b, round(max(hue), 6)::DOUBLE AS hue, round(max(sat), 6)::DOUBLE AS sat
  FROM hsv GROUP BY 1, 2, 3, 4"""
QUERIES["dominant_hue"] = lambda spark, sf: dominant_hue(_pixels(spark, sf)).select(
    "id", F.round("hue", 5).alias("hue"))
ORACLE["dominant_hue"] = _HEAD + "SELECT id, round(hue, 5) AS hue FROM colour"
QUERIES["lightness"] = lambda spark, sf: mean_lightness(_pixels(spark, sf)).select(
    "id", F.round("lightness", 6).alias("lightness"))
ORACLE["lightness"] = _HEAD + "SELECT id, round(lightness, 6)::DOUBLE AS lightness FROM light"
QUERIES["palette"] = lambda spark, sf: palette(_pixels(spark, sf)).select(
    "id", F.round("hue", 5).alias("hue"), F.round("lightness", 6).alias("lightness"))
ORACLE["palette"] = _HEAD + (
    "SELECT id, round(hue, 5) AS hue, round(lightness, 6)::DOUBLE AS lightness FROM colour")
QUERIES["circular_mean"] = lambda spark, sf: base.load(spark, sf, "lineitem").groupBy(
    "l_suppkey").agg(F.round(circular_mean(F.pmod("l_extendedprice", F.lit(90.0)) - 45.0), 5)
                     .alias("angle"))
ORACLE["circular_mean"] = """SELECT l_suppkey, round((degrees(atan2(
  avg(sin(radians(l_extendedprice % 90 - 45))), avg(cos(radians(l_extendedprice % 90 - 45)))))
  + 360) % 360, 5)::DOUBLE AS angle FROM lineitem GROUP BY l_suppkey"""

# The anchors of operators/palette.py, for SQL.
_ANCHORS = """anchor AS (SELECT * FROM (VALUES (6, 0, '#c35d52', '#9e716c', 'terracotta'),
  (18, 1, '#b66745', '#987464', 'burnt orange'), (28, 2, '#a57142', '#917761', 'amber'),
  (40, 3, '#937842', '#887b5f', 'ochre'), (90, 4, '#68854a', '#718162', 'moss'),
  (200, 5, '#51829b', '#67808c', 'teal'), (212, 6, '#517fb3', '#697e96', 'blue'),
  (224, 7, '#627abc', '#717c99', 'indigo')) t(spot, place, color, muted, anchor))"""


def _anchors(spark, sf):
    """Part sizes and prices as hues; whole degrees, so that ties occur."""
    hue = F.when(F.col("p_size") % 9 != 0, F.pmod(F.floor("p_retailprice"), F.lit(360)).cast("double"))
    return base.load(spark, sf, "part").select(
        "p_partkey", hue.alias("hue"), nearest_anchor(hue).alias("a")).select(
        "p_partkey", "hue", "a.anchor", "a.color", "a.muted")


QUERIES["nearest_anchor"] = _anchors
ORACLE["nearest_anchor"] = f"""WITH {_ANCHORS},
h AS (SELECT p_partkey, CASE WHEN p_size % 9 <> 0 THEN (floor(p_retailprice)::BIGINT % 360)::DOUBLE END
  AS hue FROM part),
b AS (SELECT p_partkey, anchor, color, muted FROM h, anchor WHERE hue IS NOT NULL QUALIFY
  row_number() OVER (PARTITION BY p_partkey ORDER BY
    abs(((hue - spot + 180) % 360 + 360) % 360 - 180), place) = 1)
SELECT p_partkey, hue, anchor, coalesce(color, '#9a9086') AS color, coalesce(muted, '#8d8781')
  AS muted FROM h LEFT JOIN b USING (p_partkey)"""


def _marks(spark, sf):
    """Parts as thumbnails; two parts of one name share a hash and a first row."""
    parts = base.load(spark, sf, "part")
    sha = F.sha2(F.concat_ws(" ", "p_name", "p_brand", F.col("p_size").cast("string")), 256)
    thumbs = parts.select(F.col("p_partkey").alias("pos"), sha.alias("sha256"))
    shipped = base.load(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.min("l_shipdate").alias("shipped"))
    items = parts.join(shipped, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        F.col("p_partkey").alias("pos"), sha.alias("sha256"),
        F.when(F.col("p_size") > 10, F.date_format("shipped", "yyyy-MM-dd'T'HH:mm:ss"))
        .alias("captured"))
    colours = palette(_pixels(spark, sf)).join(
        thumbs.select(F.col("pos").alias("id"), "sha256"), "id").select(
        F.col("id").alias("row_no"), "sha256", "hue", "lightness")
    return palette_marks(thumbs, colours, items)


_SQL_MARKS = _HEAD + f""", {_ANCHORS},
parts AS (SELECT p_partkey AS pos, sha256(concat_ws(' ', p_name, p_brand, p_size::VARCHAR)) AS sha,
  p_size FROM part),
ship AS (SELECT l_partkey, min(l_shipdate) AS d FROM lineitem GROUP BY 1),
it AS (SELECT sha, CASE WHEN p_size > 10 THEN strftime(d, '%Y-%m-%dT%H:%M:%S') END AS captured, pos
  FROM parts LEFT JOIN ship ON l_partkey = pos QUALIFY row_number() OVER
  (PARTITION BY sha ORDER BY pos) = 1),
col AS (SELECT sha, hue, lightness FROM colour JOIN parts ON pos = id QUALIFY row_number() OVER
  (PARTITION BY sha ORDER BY id DESC) = 1),
marks AS (SELECT p.pos, p.sha AS sha256, c.hue, c.lightness, i.captured FROM parts p
  LEFT JOIN col c USING (sha) LEFT JOIN it i USING (sha))"""
QUERIES["palette_marks"] = lambda spark, sf: _marks(spark, sf).select(
    "pos", "sha256", F.round("hue", 5).alias("hue"), F.round("lightness", 6).alias("lightness"),
    "captured")
ORACLE["palette_marks"] = _SQL_MARKS + (
    " SELECT pos, sha256, round(hue, 5) AS hue, round(lightness, 6)::DOUBLE AS lightness, captured "
    "FROM marks")
QUERIES["palette_totals"] = lambda spark, sf: palette_totals(_marks(spark, sf))
ORACLE["palette_totals"] = _SQL_MARKS + (
    " SELECT count(*) AS total, count(*) FILTER (captured IS NULL) AS undated, "
    "count(*) FILTER (hue IS NULL) AS achromatic FROM marks")


def _timeline(spark, sf):
    marks = materialize(_marks(spark, sf), "marks")
    lit = marks.filter("lightness > 0.5").select("sha256")
    return timeline(marks, 1200.0, lit).select(
        "pos", F.round("x", 4).alias("x"), F.round("height", 4).alias("height"), "width",
        "color", "lit")


QUERIES["timeline_layout"] = _timeline
ORACLE["timeline_layout"] = _SQL_MARKS + """,
t AS (SELECT *, epoch_ms(captured::TIMESTAMP) AS ms FROM marks),
tot AS (SELECT count(*) AS n, count(*) FILTER (ms IS NULL) AS und, min(ms) AS lo, max(ms) AS hi,
  1157.0::DOUBLE AS usable FROM t),
w AS (SELECT *, usable * (und::DOUBLE / n) AS uw FROM tot),
a AS (SELECT t.pos, anchor.color, anchor.muted FROM t, anchor WHERE hue IS NOT NULL QUALIFY
  row_number() OVER (PARTITION BY t.pos ORDER BY
    abs(((hue - spot + 180) % 360 + 360) % 360 - 180), place) = 1)
SELECT t.pos, round(CASE WHEN ms IS NOT NULL
    THEN (ms - lo)::DOUBLE / greatest(1, hi - lo) * (usable - uw)
    ELSE usable - uw + 40 + (row_number() OVER (PARTITION BY ms IS NULL ORDER BY t.pos) - 1)
      * CASE WHEN und > 1 THEN uw / (und - 1) ELSE 0 END END, 4) AS x,
  round(5 + coalesce(lightness, 0.5) * 67, 4)::DOUBLE AS height,
  CASE WHEN ms IS NOT NULL THEN 3.0 ELSE 1.6 END::DOUBLE AS width,
  CASE WHEN ms IS NOT NULL THEN coalesce(a.color, '#9a9086') ELSE coalesce(a.muted, '#8d8781') END
    AS color,
  t.sha256 IN (SELECT sha256 FROM marks WHERE lightness > 0.5) AS lit
FROM t CROSS JOIN w LEFT JOIN a USING (pos)"""
