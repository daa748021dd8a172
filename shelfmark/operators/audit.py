"""Coverage, staleness, index integrity and retrieval regression reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import base_name
from shelfmark.functions.vectors import norm
from shelfmark.operators.ranking import top_within

FINGERPRINT_CHUNK = 65_536
EXAMPLES = 5


# -- index integrity ---------------------------------------------------------

def order_fingerprint(rows: DataFrame, chunk: int = FINGERPRINT_CHUNK) -> DataFrame:
    """(rows, fingerprint) of paths in position order; input (pos, path).

    One rule at every size: each ``chunk`` of positions gets the SHA-256 of
    ``path + newline`` in order, and the fingerprint is the SHA-256 of the row
    count and two sums over 60-bit pieces of SHA-256(chunk number, chunk
    digest). The sums are partial aggregates, so no task holds more than one
    chunk. Positions must be dense from 0; fingerprints compare only at the
    same chunk size, which the index manifest records.
    """
    parts = rows.groupBy(F.floor(F.col("pos") / chunk).alias("_chunk")).agg(
        F.count("*").alias("_n"),
        F.sha2(F.concat(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda r: r["path"]
        ), "\n"), F.lit("\n")), 256).alias("_digest"),
    )
    bound = F.sha2(F.concat_ws("|", F.col("_chunk").cast("string"), "_digest"), 256)

    def piece(start: int) -> Column:
        number = F.conv(F.substring(bound, start, 15), 16, 10).cast("decimal(38,0)")
        return F.coalesce(F.sum(number), F.lit(0).cast("decimal(38,0)")).cast("string")

    return parts.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), piece(1).alias("_low"),
        piece(16).alias("_high"),
    ).select("rows", F.sha2(F.concat_ws(
        "|", F.col("rows").cast("string"), "_low", "_high"), 256).alias("fingerprint"))


def verify_index(
    vectors: int | Column, fingerprint: DataFrame, manifest: DataFrame
) -> DataFrame:
    """(ok, reason) of one index against its manifest.

    ``manifest`` is zero or one row (lookup_fingerprint); ``vectors`` the
    number of stored vectors.
    """
    recorded = manifest.agg(
        F.count("*").alias("_m"), F.max("lookup_fingerprint").alias("_expected"))
    checked = fingerprint.select(
        "rows", "fingerprint", recorded.select("_m").scalar().alias("_m"),
        recorded.select("_expected").scalar().alias("_expected"))
    count = F.lit(vectors) if isinstance(vectors, int) else vectors
    reason = (
        F.when(count != F.col("rows"), "row counts differ")
        .when(F.col("_m") == 0, "manifest missing")
        .when(F.coalesce("_expected", F.lit("")) == "", "manifest without fingerprint")
        .when(F.col("_expected") != F.col("fingerprint"), "rows added, removed or reordered")
    )
    return checked.select(reason.isNull().alias("ok"), F.coalesce(reason, F.lit("")).alias("reason"))


def index_statistics(index: DataFrame) -> DataFrame:
    """One row: vectors, dimension, value type, shortest and longest norm."""
    kind = dict(index.dtypes)["vec"].removeprefix("array<").removesuffix(">")
    return index.agg(
        F.count("*").alias("vectors"), F.max(F.size("vec")).alias("dimension"),
        F.lit(kind).alias("dtype"),
        F.min(norm(F.col("vec"))).alias("min_norm"), F.max(norm(F.col("vec"))).alias("max_norm"))


# -- coverage ----------------------------------------------------------------

def coverage(base: DataFrame, artifacts: DataFrame, names: list[str]) -> DataFrame:
    """Per artifact: covers, missing and orphaned keys against one base.

    ``base`` is (key), ``artifacts`` (artifact, key), ``names`` the artifacts
    to report. All of them share one shuffle.
    """
    wanted = base.select("key", F.explode(F.array(*[F.lit(n) for n in names])).alias("artifact"))
    flags = wanted.select("artifact", "key", F.lit(1).alias("_b"), F.lit(0).alias("_a")).unionByName(
        artifacts.filter(F.col("artifact").isin(names))
        .select("artifact", "key", F.lit(0).alias("_b"), F.lit(1).alias("_a")))
    keys = flags.groupBy("artifact", "key").agg(F.max("_b").alias("_b"), F.max("_a").alias("_a"))
    return keys.groupBy("artifact").agg(
        F.sum("_a").alias("covers"),
        F.count_if((F.col("_b") == 1) & (F.col("_a") == 0)).alias("missing"),
        F.count_if((F.col("_b") == 0) & (F.col("_a") == 1)).alias("orphaned"))


def failing(rows: DataFrame) -> DataFrame:
    """Status rows that are neither ok nor blank."""
    return rows.filter((F.col("status") != "ok") & (F.col("status") != ""))


def failure_report(rows: DataFrame) -> DataFrame:
    """Per artifact: failures, note ``n state, ...``, first few names.

    ``rows`` is (artifact, pos, path, status).
    """
    bad = failing(rows)
    states = bad.groupBy("artifact", "status").agg(F.count("*").alias("n"))
    notes = states.groupBy("artifact").agg(
        F.sum("n").alias("failures"),
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("status", "n"))),
            lambda s: F.concat(s["n"].cast("string"), F.lit(" "), s["status"])), ", ")
        .alias("note"))
    shown = top_within(bad.select("artifact", "pos", "path"), ["artifact"], [F.col("pos")],
                       EXAMPLES)
    names = shown.groupBy("artifact").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda r: base_name(r["path"])
    ).alias("examples"))
    return notes.join(names, "artifact")


def source_state(records: DataFrame) -> DataFrame:
    """(artifact, source_note, source_stale) of recorded source fingerprints.

    ``records`` is (artifact, manifest_name, manifest_text, field, source_name,
    source_sha256); a NULL text or hash means the file is missing.
    """
    parsed = F.try_parse_json(F.concat(F.lit("["), F.col("manifest_text"), F.lit("]")))
    body = F.when(F.try_variant_get(parsed, "$[1]", "variant").isNull(),
                  F.try_variant_get(parsed, "$[0]", "variant"))
    usable = F.coalesce(F.schema_of_variant(body).startswith("OBJECT"), F.lit(False))
    # The field's name is data, so the lookup goes through a map.
    fields = F.from_json("manifest_text", "map<string,string>")
    recorded = F.coalesce(F.try_element_at(fields, F.col("field")), F.lit(""))
    # The notes on a source.
    note = (
        F.when(F.col("manifest_text").isNull(), "no manifest, so its source is unrecorded")
        .when(~usable, F.concat("manifest_name", F.lit(" is unreadable")))
        .when(recorded.isin("", "null", "false", "0"),
              F.concat("manifest_name", F.lit(" records no "), "field"))
        .when(F.col("source_sha256").isNull(),
              F.concat(F.lit("source "), "source_name", F.lit(" is missing")))
        .when(F.col("source_sha256") != recorded,
              F.concat(F.lit("built from superseded "), "source_name"))
    )
    return records.select("artifact", note.alias("source_note"),
                          note.isNotNull().alias("source_stale"))


def coverage_report(
    artifacts: DataFrame, covered: DataFrame, sources: DataFrame | None = None,
    failures: DataFrame | None = None,
) -> DataFrame:
    """Status line per artifact.

    ``artifacts`` is (artifact, built, base_built, base_name): whether the
    artifact and what it is measured against exist. ``covered``, ``sources``
    and ``failures`` come from ``coverage``, ``source_state``,
    ``failure_report``.
    """
    rows = artifacts.join(covered, "artifact", "left")
    if sources is not None:
        rows = rows.join(sources, "artifact", "left")
    else:
        rows = rows.withColumns({"source_note": F.lit(None).cast("string"),
                                 "source_stale": F.lit(False)})
    if failures is not None:
        rows = rows.join(failures.select("artifact", "failures", "note", "examples"),
                         "artifact", "left")
    else:
        rows = rows.withColumns({
            "failures": F.lit(None).cast("long"), "note": F.lit(None).cast("string"),
            "examples": F.lit(None).cast("array<string>")})
    measured = F.col("built") & F.col("base_built")
    missing = F.coalesce("missing", F.lit(0))
    orphaned = F.coalesce("orphaned", F.lit(0))
    # The phrases of the status line.
    reasons = F.concat_ws(
        ", ",
        F.when(missing > 0, F.concat(missing.cast("string"), F.lit(" not covered"))),
        F.when(orphaned > 0, F.concat(orphaned.cast("string"),
                                      F.lit(" no longer in catalog"))),
        F.col("source_note"),
    )
    line = F.concat(
        F.when(reasons == "", "OK").otherwise(F.concat(F.lit("STALE - "), reasons)),
        F.coalesce(F.concat(F.lit(", "), F.col("note")), F.lit("")),
    )
    status = (
        F.when(~F.col("built"), "MISSING")
        .when(~F.col("base_built"),
              F.concat(F.lit("UNMEASURABLE - "), "base_name", F.lit(" missing")))
        .otherwise(line)
    )
    source_stale = measured & F.coalesce("source_stale", F.lit(False))
    return rows.select(
        "artifact",
        F.when(F.col("built"), F.coalesce("covers", F.lit(0))).alias("covers"),
        status.alias("status"),
        (~measured | (missing > 0) | (orphaned > 0) | source_stale).alias("stale"),
        F.when(measured, missing).alias("missing"),
        F.when(measured, orphaned).alias("orphaned"),
        source_stale.alias("source_stale"),
        F.when(measured, F.col("source_note")).alias("source_note"),
        F.when(measured, F.coalesce("failures", F.lit(0))).otherwise(0).alias("failures"),
        F.when(measured, F.col("examples")).alias("examples"),
    )


def derived_coverage(
    catalog: DataFrame, indexed: DataFrame, duplicates: DataFrame,
    known_faces: DataFrame, clustered_faces: DataFrame, event_rows: DataFrame,
) -> DataFrame:
    """One row of gaps in what is derived from the indexes.

    Counts duplicate entries outside the vector index, faces not clustered,
    catalog rows without an event row, and event placements.
    """
    outside = duplicates.select("path").distinct().join(indexed.select("path"), "path", "left_anti")
    loose = known_faces.select("face_id").distinct().join(
        clustered_faces.select("face_id"), "face_id", "left_anti")
    bare = catalog.select("path").distinct().join(event_rows.select("path"), "path", "left_anti")
    placed = event_rows.filter("event_id <> 'unassigned'")
    out = outside.agg(F.count("*").alias("duplicates_outside_index"))
    for one in (
        loose.agg(F.count("*").alias("faces_not_clustered")),
        bare.agg(F.count("*").alias("without_event")),
        placed.agg(F.count_distinct("event_id").alias("events"),
                   F.count_distinct("path").alias("placed")),
    ):
        out = out.select("*", *[one.select(c).scalar().alias(c) for c in one.columns])
    return out


def label_coverage(known_faces: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: people, labelled faces, faces, percentage labelled."""
    faces = known_faces.agg(F.count("*").alias("n"))
    return labels.agg(
        F.count_distinct("name").alias("people"), F.count("*").alias("labelled")
    ).select(
        "people", "labelled", faces.scalar().alias("faces")
    ).withColumn("pct", F.when(F.col("faces") > 0, F.col("labelled") * 100.0 / F.col("faces")))


# -- retrieval regression ----------------------------------------------------

def multiset_delta(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """(by..., was, now, gained, lost): copies per value on both sides.

    Repeats count: two copies before and one after is one lost.
    """
    counted = before.select(*by, F.lit(1).alias("_b"), F.lit(0).alias("_a")).unionByName(
        after.select(*by, F.lit(0).alias("_b"), F.lit(1).alias("_a"))
    ).groupBy(*by).agg(F.sum("_b").alias("was"), F.sum("_a").alias("now"))
    return counted.withColumns({
        "gained": F.greatest(F.col("now") - F.col("was"), F.lit(0)),
        "lost": F.greatest(F.col("was") - F.col("now"), F.lit(0))})


def regression_report(
    baseline: DataFrame, measured: DataFrame,
    baseline_queries: DataFrame | None = None, measured_queries: DataFrame | None = None,
) -> DataFrame:
    """(query, kind, was, now, gained, lost) of queries that changed.

    Inputs are (query, filename) rows. ``*_queries`` (query) list the suites, so
    that a query without results is still part of one.
    """
    # Both tables are read once: a query with rows on a side is in that side's suite.
    rows = multiset_delta(baseline, measured, ["query", "filename"]).groupBy("query").agg(
        *[F.sum(c).alias(c) for c in ("was", "now", "gained", "lost")])
    for given, count, flag in ((baseline_queries, "was", "_old"), (measured_queries, "now", "_new")):
        if given is None:
            rows = rows.withColumn(flag, F.when(F.col(count) > 0, F.lit(True)))
        else:
            listed = given.select("query").distinct().withColumn(flag, F.lit(True))
            rows = rows.join(listed, "query", "full_outer")
    rows = rows.filter("_old OR _new")
    number = {c: F.coalesce(c, F.lit(0)) for c in ("was", "now", "gained", "lost")}
    kind = (
        F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "dropped")
        .when((number["gained"] > 0) | (number["lost"] > 0), "moved")
    )
    return rows.select(
        "query", kind.alias("kind"),
        F.when(F.col("_old").isNotNull(), number["was"]).alias("was"),
        F.when(F.col("_new").isNotNull(), number["now"]).alias("now"),
        number["gained"].alias("gained"), number["lost"].alias("lost"),
    ).filter("kind IS NOT NULL")


def regression_files(baseline: DataFrame, measured: DataFrame) -> DataFrame:
    """(query, filename, change, copies): the files gained and lost."""
    delta = multiset_delta(baseline, measured, ["query", "filename"])
    return delta.filter("gained > 0 OR lost > 0").select(
        "query", "filename", F.when(F.col("gained") > 0, "gained").otherwise("lost").alias("change"),
        F.greatest("gained", "lost").alias("copies"))
