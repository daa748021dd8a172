"""Registered event queries over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions.text import clean_subject, padded_id
from shelfmark.operators.events import (
    build_events, event_index, event_names, event_roster, gap_sessions, session_spans,
    thread_placement,
)
from shelfmark.registry import base

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

GAP = 0.2  # hours; the log is dense


def _iso(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _sql_iso(column):
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def _log(spark, sf):
    return base.load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _catalog(spark, sf):
    """Log rows as catalog rows: a fifth undated, short threads, mail-like subjects."""
    key = F.col("event_id")
    return _log(spark, sf).select(
        key.alias("pos"), F.format_string("ev-%08d", key).alias("path"),
        F.format_string("ev-%08d.jpg", key).alias("filename"),
        F.when(F.pmod(key, F.lit(5)) != 0, F.col("ts")).alias("ts"),
        F.when(F.pmod(key, F.lit(13)) == 0, "").otherwise(
            F.concat(F.lit("t"), F.floor(key / 7).cast("string"))).alias("thread"),
        F.when(F.pmod(key, F.lit(3)) == 0, F.concat(F.lit("Re: fwd : "), "event_type"))
        .when(F.pmod(key, F.lit(17)) == 0, "FW:").otherwise(F.col("event_type")).alias("subject"))


_SQL_CATALOG = """c AS (SELECT event_id AS pos, 'ev-' || lpad(event_id::VARCHAR, 8, '0') AS path,
  CASE WHEN event_id % 5 <> 0 THEN ts END AS ts,
  CASE WHEN event_id % 13 = 0 THEN '' ELSE 't' || (event_id // 7) END AS thread,
  CASE WHEN event_id % 3 = 0 THEN 'Re: fwd : ' || event_type WHEN event_id % 17 = 0 THEN 'FW:'
    ELSE event_type END AS subject FROM events),
g AS (SELECT *, coalesce(ts - lag(ts) OVER (ORDER BY ts, pos) > INTERVAL 720 SECONDS, true) AS s
  FROM c WHERE ts IS NOT NULL),
dated AS (SELECT *, (sum(s::INT) OVER (ORDER BY ts, pos))::INT AS event FROM g),
single AS (SELECT thread, min(event) AS event FROM dated WHERE trim(thread) <> '' GROUP BY thread
  HAVING min(event) = max(event)),
rest AS (SELECT c.*, s.event FROM c LEFT JOIN single s ON s.thread = c.thread WHERE c.ts IS NULL),
subj AS (SELECT event, trim(regexp_replace(trim(subject), '^((re|fwd|fw)\\s*:\\s*)+', '', 'i'))
  AS subject, ts, pos FROM dated),
votes AS (SELECT event, subject, count(*) AS n, min(ts) AS f, min((ts, pos)) AS fp FROM subj
  WHERE subject <> '' GROUP BY ALL),
best AS (SELECT event, subject, n FROM votes QUALIFY row_number() OVER
  (PARTITION BY event ORDER BY n DESC, fp) = 1),
spans AS (SELECT event, min(ts) AS lo, max(ts) AS hi, count(*) AS dated FROM dated GROUP BY event),
named AS (SELECT s.event, lo, hi, dated, CASE WHEN n >= greatest(2, dated * 0.6)
    THEN subject || ' (' || span || ')' ELSE span END AS name
  FROM (SELECT *, CASE WHEN strftime(lo, '%b %Y') = strftime(hi, '%b %Y') THEN strftime(lo, '%b %Y')
    ELSE strftime(lo, '%b %Y') || ' - ' || strftime(hi, '%b %Y') END AS span FROM spans) s
  LEFT JOIN best USING (event)),
extra AS (SELECT event, count(*) AS borrowed FROM rest WHERE event IS NOT NULL GROUP BY event),
full_ev AS (SELECT *, 'event-' || lpad(event::VARCHAR, greatest(3, length(event::VARCHAR))::INT, '0')
  AS event_id, dated + coalesce(borrowed, 0) AS total FROM named LEFT JOIN extra USING (event)),
out_rows AS (
  SELECT event_id, name AS event_name, lo, hi, total AS image_count, 'exif' AS date_source, path,
    ts, subject, thread FROM dated JOIN full_ev USING (event)
  UNION ALL SELECT event_id, name, lo, hi, total, 'thread', path, NULL, subject, thread
    FROM rest JOIN full_ev USING (event)
  UNION ALL SELECT 'unassigned', 'unassigned', NULL, NULL,
    (SELECT count(*) FROM rest WHERE event IS NULL), 'none', path, NULL, subject, thread
    FROM rest WHERE event IS NULL)"""


def _sessions(by, gap):
    def run(spark, sf):
        spans = session_spans(_log(spark, sf), "ts", gap, by)
        return spans.select(*by, "session", _iso("start").alias("start"),
                            _iso("end").alias("end"), "n")
    return run


def _sql_sessions(by, seconds):
    part = f"PARTITION BY {by} " if by else ""
    lead = f"{by}, " if by else ""
    return f"""WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER ({part}ORDER BY ts) >
  INTERVAL {seconds} SECONDS, true) AS s FROM events),
x AS (SELECT *, (sum(s::INT) OVER ({part}ORDER BY ts, event_id))::INT AS session FROM g)
SELECT {lead}session, {_sql_iso('min(ts)')} AS start, {_sql_iso('max(ts)')} AS "end",
  count(*) AS n FROM x GROUP BY {lead}session"""


QUERIES["event_sessions"] = _sessions(["user_id"], 24)
ORACLE["event_sessions"] = _sql_sessions("user_id", 86400)
QUERIES["event_sessions_72h"] = _sessions(["user_id"], 72)
ORACLE["event_sessions_72h"] = _sql_sessions("user_id", 259200)
QUERIES["event_sessions_global"] = _sessions([], GAP)
ORACLE["event_sessions_global"] = _sql_sessions("", 720)


def _placement(spark, sf):
    rows = _catalog(spark, sf)
    dated = gap_sessions(rows.filter("ts IS NOT NULL"), "ts", GAP, name="event")
    out = thread_placement(dated.select("thread", "event"), rows.filter("ts IS NULL"))
    return out.select("path", "thread", "event")


QUERIES["event_thread_placement"] = _placement
ORACLE["event_thread_placement"] = f"WITH {_SQL_CATALOG} SELECT path, thread, event FROM rest"


def _naming(spark, sf):
    rows = _catalog(spark, sf).filter("ts IS NOT NULL")
    named = event_names(gap_sessions(rows, "ts", GAP, name="event"))
    return named.select("event", _iso("start").alias("start"), _iso("end").alias("end"),
                        "dated", "name")


QUERIES["event_naming"] = _naming
ORACLE["event_naming"] = f"""WITH {_SQL_CATALOG}
SELECT event, {_sql_iso('lo')} AS start, {_sql_iso('hi')} AS "end", dated, name FROM named"""


def _grouping(spark, sf):
    return build_events(_catalog(spark, sf), GAP).select(
        "event_id", "event_name", _iso("event_start").alias("event_start"),
        _iso("event_end").alias("event_end"), "image_count", "date_source", "path",
        _iso("capture_time").alias("capture_time"), "subject", "thread")


QUERIES["event_grouping"] = _grouping
ORACLE["event_grouping"] = f"""WITH {_SQL_CATALOG}
SELECT event_id, event_name, {_sql_iso('lo')} AS event_start, {_sql_iso('hi')} AS event_end,
  image_count, date_source, path, {_sql_iso('ts')} AS capture_time, subject, thread FROM out_rows"""


def _roster(spark, sf):
    rows = build_events(_catalog(spark, sf), GAP).withColumn(
        "pos", F.expr("substring(path, 4)").cast("long"))
    return event_roster(event_index(rows)).select(
        "event_id", "name", _iso("start").alias("start"), _iso("end").alias("end"), "images",
        "place")


QUERIES["event_roster"] = _roster
ORACLE["event_roster"] = f"""WITH {_SQL_CATALOG},
i AS (SELECT event_id, any_value(event_name) AS name, any_value(lo) AS lo, any_value(hi) AS hi,
  count(DISTINCT path) AS images FROM out_rows GROUP BY event_id)
SELECT event_id, name, {_sql_iso('lo')} AS start, {_sql_iso('hi')} AS "end", images,
  (row_number() OVER (ORDER BY event_id = 'unassigned' DESC, coalesce(lo::VARCHAR, '') DESC,
    event_id))::INT AS place FROM i"""

QUERIES["subject_clean"] = lambda spark, sf: _catalog(spark, sf).select(
    "path", clean_subject(F.col("subject")).alias("subject"),
    padded_id("event-", F.col("pos")).alias("label"))
ORACLE["subject_clean"] = f"""WITH {_SQL_CATALOG} SELECT path,
  trim(regexp_replace(trim(subject), '^((re|fwd|fw)\\s*:\\s*)+', '', 'i')) AS subject,
  'event-' || lpad(pos::VARCHAR, greatest(3, length(pos::VARCHAR))::INT, '0') AS label FROM c"""
