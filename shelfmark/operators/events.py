"""Events: gap sessions over capture times, placement by thread, names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.dates import month_span
from shelfmark.functions.text import clean_subject, padded_id
from shelfmark.operators.filters import UNASSIGNED
from shelfmark.operators.ranking import rank_within
from shelfmark.session import materialize, spread

GAP_HOURS = 72.0
NAME_SHARE = 0.6


def gap_sessions(
    rows: DataFrame, ts: str = "ts", gap_hours: float = GAP_HOURS,
    by: Sequence[str] = (), name: str = "session",
) -> DataFrame:
    """Number sessions per key: a new one starts when the pause exceeds the gap.

    Two rows in one gap-wide time bucket are never a gap apart, so sessions
    are decided between buckets. The rows are only pre-aggregated to (key,
    bucket), whatever a key's share of them, and never sorted. A key has at
    most span / gap buckets.
    """
    width = int(gap_hours * 3_600_000_000)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    bucketed = rows.withColumn("_bucket", F.floor(micros / F.lit(width)))
    edges = bucketed.filter("_bucket IS NOT NULL").groupBy(*by, "_bucket").agg(
        F.min(micros).alias("_lo"), F.max(micros).alias("_hi"))
    if not by:
        return bucketed.join(_one_order(edges, width, name), "_bucket").drop("_bucket")
    order = Window.partitionBy(*by).orderBy("_bucket")
    starts = F.coalesce(F.col("_lo") - F.lag("_hi").over(order) > width, F.lit(True))
    numbered = (
        edges.withColumn("_start", starts.cast("int"))
        .withColumn(name, F.sum("_start").over(order))
        .select(*by, "_bucket", F.col(name).cast("int"))
    )
    return bucketed.join(numbered, [*by, "_bucket"]).drop("_bucket")


def _one_order(edges: DataFrame, width: int, name: str) -> DataFrame:
    """(_bucket, session) over all buckets: a prefix scan in two passes.

    Ranges of buckets are numbered on their own; a range hands on its last
    time and its number of sessions. One row per range, so at most as many as
    there are shuffle partitions, is carried through the driver.
    """
    laid = materialize(
        edges.repartitionByRange("_bucket").withColumn("_range", F.spark_partition_id()), "edges")
    order = Window.partitionBy("_range").orderBy("_bucket")
    starts = F.coalesce(F.col("_lo") - F.lag("_hi").over(order) > width, F.lit(False))
    local = laid.withColumn("_start", starts.cast("int")).withColumn(
        "_local", F.sum("_start").over(order))
    ranges = local.groupBy("_range").agg(
        F.min("_lo").alias("lo"), F.max("_hi").alias("hi"), F.sum("_start").alias("n"))
    carried, session, last = [], 0, None
    for row in sorted(ranges.collect(), key=lambda r: r["_range"]):
        session += last is None or row["lo"] - last > width
        carried.append((row["_range"], session))
        session += row["n"]
        last = row["hi"]
    before = edges.sparkSession.createDataFrame(carried, "_range int, _before long")
    return local.join(F.broadcast(before), "_range").select(
        "_bucket", (F.col("_before") + F.col("_local")).cast("int").alias(name))


def session_spans(
    rows: DataFrame, ts: str = "ts", gap_hours: float = GAP_HOURS, by: Sequence[str] = ()
) -> DataFrame:
    """(key, session, start, end, n): one row per session."""
    return gap_sessions(rows, ts, gap_hours, by).groupBy(*by, "session").agg(
        F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))


def thread_placement(placed: DataFrame, undated: DataFrame) -> DataFrame:
    """Undated rows whose thread's dated rows all lie in one event.

    ``placed`` is (thread, event), ``undated`` any rows with ``thread``;
    returns them with ``event``, NULL where the thread is blank, unknown or
    spread over several. Blank threads skip the join, so they form no hot key.
    """
    blank = F.coalesce(F.trim("thread"), F.lit("")) == ""
    single = (
        placed.filter(~blank).groupBy(F.trim("thread").alias("_thread"))
        .agg(F.min("event").alias("event"), F.max("event").alias("_last"))
        .filter(F.col("event") == F.col("_last")).drop("_last")
    )
    keyed = undated.filter(~blank).withColumn("_thread", F.trim("thread"))
    return keyed.join(single, "_thread", "left").drop("_thread").unionByName(
        undated.filter(blank).withColumn("event", F.lit(None).cast("int")))


def event_names(dated: DataFrame) -> DataFrame:
    """(event, start, end, dated, name) from dated rows (event, ts, pos, subject).

    The most common cleaned subject names the event when at least two rows and
    60 % of the dated ones share it; ties go to the subject seen first.
    """
    spans = dated.groupBy("event").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("dated"))
    subject = clean_subject(F.col("subject"))
    votes = (
        dated.select("event", "ts", "pos", subject.alias("_subject"))
        .filter(F.col("_subject") != "")
        .groupBy("event", "_subject")
        .agg(F.count("*").alias("_n"), F.min(F.struct("ts", "pos")).alias("_first"))
    )
    most = votes.groupBy("event").agg(F.max("_n").alias("_n"))
    best = (
        votes.join(most, ["event", "_n"]).groupBy("event", "_n")
        .agg(F.min_by("_subject", "_first").alias("_subject"))
    )
    span = month_span(F.col("start"), F.col("end"))
    enough = F.col("_n") >= F.greatest(F.lit(2.0), F.col("dated") * NAME_SHARE)
    return spans.join(best, "event", "left").select(
        "event", "start", "end", "dated",
        F.when(enough, F.concat(F.col("_subject"), F.lit(" ("), span, F.lit(")")))
        .otherwise(span).alias("name"),
    )


def build_events(catalog: DataFrame, gap_hours: float = GAP_HOURS) -> DataFrame:
    """Event rows of a catalog (pos, path, filename, ts, subject, thread).

    ``ts`` is the parsed capture time, NULL where unknown. Every row comes out
    once: dated, borrowed through its thread, or unassigned.
    """
    # Both feed several of the tables below.
    dated = materialize(
        gap_sessions(catalog.filter("ts IS NOT NULL"), "ts", gap_hours, name="event"), "dated")
    borrowed = materialize(thread_placement(
        dated.select("thread", "event"), catalog.filter("ts IS NULL")), "borrowed")
    counts = borrowed.groupBy("event").agg(F.count("*").alias("borrowed"))
    # Written, so that few events are known to be few and no event's rows are gathered for them.
    names = materialize(event_names(dated).join(
        counts.filter("event IS NOT NULL"), "event", "left"
    ).select(
        "event", padded_id("event-", F.col("event")).alias("event_id"),
        F.col("name").alias("event_name"), F.col("start").alias("event_start"),
        F.col("end").alias("event_end"),
        (F.col("dated") + F.coalesce("borrowed", F.lit(0))).alias("image_count"),
    ), "names")
    lost = counts.filter("event IS NULL").select(F.col("borrowed").alias("image_count"))
    columns = ["event_id", "event_name", "event_start", "event_end", "image_count",
               "date_source", "path", "filename", "capture_time", "subject", "thread"]
    sure = dated.join(names, "event").withColumn("date_source", F.lit("exif")).withColumn(
        "capture_time", F.col("ts"))
    through = borrowed.filter("event IS NOT NULL").join(names, "event").withColumn(
        "date_source", F.lit("thread")).withColumn("capture_time", F.col("ts"))
    none = borrowed.filter("event IS NULL").select(
        "*",
        F.lit(UNASSIGNED).alias("event_id"), F.lit(UNASSIGNED).alias("event_name"),
        F.lit(None).cast("timestamp").alias("event_start"),
        F.lit(None).cast("timestamp").alias("event_end"),
        lost.scalar().alias("image_count"), F.lit("none").alias("date_source"),
        F.col("ts").alias("capture_time"),
    )
    return (
        sure.select(columns).unionByName(through.select(columns))
        .unionByName(none.select(columns))
    )


def event_index(rows: DataFrame) -> DataFrame:
    """(event_id, name, start, end, images) from event rows with ``pos``.

    The first row of an id supplies its name and span.
    """
    # One event may hold most rows: paths are told apart over all tasks, then counted.
    seen = spread(rows.select("event_id", "path", "pos"), "event_id", "path").groupBy(
        "event_id", "path").agg(F.min("pos").alias("pos"))
    sizes = seen.groupBy("event_id").agg(
        F.min("pos").alias("_pos"), F.count("path").alias("images"))
    sizes = materialize(sizes, "sizes")
    first = sizes.select(F.col("event_id").alias("_id"), "_pos")
    head = rows.join(first, F.col("event_id").eqNullSafe(F.col("_id")) & (
        F.col("pos") == F.col("_pos"))).groupBy("_id").agg(F.any_value(F.struct(
            "event_name", "event_start", "event_end")).alias("_head"))
    return sizes.join(head, F.col("event_id").eqNullSafe(F.col("_id")), "left").select(
        "event_id", F.col("_head.event_name").alias("name"),
        F.col("_head.event_start").alias("start"), F.col("_head.event_end").alias("end"), "images")


def event_roster(index: DataFrame) -> DataFrame:
    """Events with their list order: unassigned first, then newest first.

    ``place`` is dense over the events; it is numbered range by range.
    """
    order = [F.desc(F.col("event_id") == UNASSIGNED),
             F.desc(F.coalesce(F.col("start").cast("string"), F.lit(""))), F.col("event_id")]
    return rank_within(materialize(index, "index"), [], order, "place").withColumn(
        "place", F.col("place").cast("int"))
