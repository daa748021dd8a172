"""Catalog build, manifest reconciliation, archive profile and library views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.dates import display_time
from shelfmark.functions.text import base_name, normal_path, suffix
from shelfmark.operators.ranking import with_position

# Readable picture formats.
IMAGE_EXTENSIONS = [
    ".jpg", ".jpeg", ".png", ".heic", ".heif", ".gif", ".webp", ".tif", ".tiff",
]

_MANIFEST_FIELDS = [
    "message_date", "sender", "subject", "message_id", "thread_id", "original_filename",
]


def first_text(*columns: str) -> Column:
    """The first non-empty text of several columns."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def directory_part(relative: Column, n: int) -> Column:
    """The n-th (1-based) part of a relative path, empty if there is none."""
    return F.coalesce(F.try_element_at(F.split(relative, "/"), F.lit(n)), F.lit(""))


def last_rows(manifest: DataFrame, key: Column, order: str = "row_no") -> DataFrame:
    """The last manifest row of each non-empty key, as (``_key``, ``m``).

    A partial aggregate, so a key repeated over many rows is folded map-side.
    """
    row = F.struct(*[F.col(c) for c in manifest.columns])
    return (
        manifest.withColumn("_key", key).filter(F.coalesce("_key", F.lit("")) != "")
        .groupBy("_key").agg(F.max_by(row, order).alias("m"))
    )


def with_provenance(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, relative_path, sha256, ...) joined to their manifest row.

    By normalised path first; only files without one fall back to the content
    hash. The last manifest row of a key wins.
    """
    by_path = last_rows(manifest, normal_path(F.col("downloaded_path")))
    by_sha = last_rows(manifest, F.lower(F.trim("sha256")))
    keyed = files.withColumn("_key", normal_path(F.col("path")))
    first = keyed.join(by_path, "_key", "left").drop("_key")
    found = first.filter("m IS NOT NULL")
    rest = first.filter("m IS NULL").drop("m").withColumn("_key", F.lower("sha256"))
    second = rest.join(by_sha, "_key", "left").drop("_key")
    rows = found.unionByName(second)
    tracked = F.col("m").isNotNull()
    extra = [
        F.coalesce(F.col(f"m.{c}"), F.lit("")).alias(c)
        for c in _MANIFEST_FIELDS if c in manifest.columns
    ]
    own = [F.col(c) for c in files.columns if c != "sha256"]
    return rows.select(
        *own,
        F.when(tracked, F.trim("m.sha256")).otherwise(F.col("sha256")).alias("sha256"),
        F.when(tracked, "MANIFEST").otherwise("UNTRACKED").alias("provenance_status"),
        *extra,
    )


def build_catalog(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Catalog rows with a stored position in path order."""
    rows = with_provenance(files, manifest)
    rows = rows.withColumns({
        "image_id": F.col("sha256"),
        "filename": base_name(F.col("path")),
        "extension": suffix(F.col("path")),
        "directory_year": directory_part(F.col("relative_path"), 1),
        "directory_month": directory_part(F.col("relative_path"), 2),
    })
    return with_position(rows, [F.col("path")])


def catalog_summary(catalog: DataFrame) -> DataFrame:
    """One row: records, provenance counts, rows with an original capture date."""
    original = (
        F.count_if(F.coalesce("exif_datetime_original", F.lit("")) != "")
        if "exif_datetime_original" in catalog.columns else F.lit(0).cast("bigint")
    )
    status = F.col("provenance_status")
    return catalog.agg(
        F.count("*").alias("records"), F.count_if(status == "MANIFEST").alias("manifest"),
        F.count_if(status == "UNTRACKED").alias("untracked"),
        original.alias("with_original_date"),
    )


def reconcile_paths(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(key, on_disk, listed): every normalised path and its manifest rows."""
    disk = files.select(normal_path(F.col("path")).alias("key")).distinct().withColumn(
        "on_disk", F.lit(True))
    listed = (
        manifest.filter(F.coalesce(F.trim("downloaded_path"), F.lit("")) != "")
        .groupBy(normal_path(F.col("downloaded_path")).alias("key"))
        .agg(F.count("*").alias("listed"))
    )
    return disk.join(listed, "key", "full_outer").select(
        "key", F.coalesce("on_disk", F.lit(False)).alias("on_disk"),
        F.coalesce("listed", F.lit(0)).alias("listed"))


def orphan_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, sha256, status) of files whose path no manifest row names."""
    listed = manifest.select(normal_path(F.col("downloaded_path")).alias("_key")).filter(
        F.coalesce("_key", F.lit("")) != "").distinct()
    hashes = manifest.select(F.lower(F.trim("sha256")).alias("_sha")).filter(
        F.coalesce("_sha", F.lit("")) != "").distinct().withColumn("_known", F.lit(True))
    alone = files.withColumn("_key", normal_path(F.col("path"))).join(
        listed, "_key", "left_anti")
    status = (
        F.when(F.col("sha256").isNull(), "hash_error")
        .when(F.col("_known"), "HASH_EXISTS_IN_MANIFEST").otherwise("NO_MANIFEST_RECORD")
    )
    return alone.withColumn("_sha", F.lower("sha256")).join(hashes, "_sha", "left").select(
        "path", F.coalesce("sha256", F.lit("")).alias("sha256"), status.alias("status"))


def missing_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows without a file, unless their content was found elsewhere."""
    disk = files.select(normal_path(F.col("path")).alias("_key")).distinct()
    found = (
        orphan_files(files, manifest).filter("status = 'HASH_EXISTS_IN_MANIFEST'")
        .select(F.lower("sha256").alias("_sha")).distinct()
    )
    rows = manifest.withColumn("_key", normal_path(F.col("downloaded_path"))).withColumn(
        "_sha", F.lower(F.trim(F.coalesce("sha256", F.lit("")))))
    return (
        rows.filter(F.coalesce("_key", F.lit("")) != "")
        .join(disk, "_key", "left_anti").join(found, "_sha", "left_anti")
        .drop("_key", "_sha")
    )


def repeated_rows(manifest: DataFrame, key: Column) -> DataFrame:
    """(key, copies) of manifest keys listed more than once."""
    return (
        manifest.select(key.alias("key")).filter(F.coalesce("key", F.lit("")) != "")
        .groupBy("key").agg(F.count("*").alias("copies")).filter("copies > 1")
    )


def reconciliation_counts(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row of the reconciliation's headline counts."""
    paths = reconcile_paths(files, manifest).agg(
        F.count_if("on_disk").alias("files"), F.count_if(F.col("listed") > 0).alias("listed"),
        F.count_if(F.col("on_disk") & (F.col("listed") > 0)).alias("matched"),
        F.count_if(F.col("on_disk") & (F.col("listed") == 0)).alias("files_only"),
        F.count_if(~F.col("on_disk")).alias("manifest_only"),
        F.count_if(F.col("listed") > 1).alias("repeated_paths"),
    )
    orphans = orphan_files(files, manifest).agg(
        F.count_if(F.col("status") == "NO_MANIFEST_RECORD").alias("untracked"),
        F.count_if(F.col("status") == "HASH_EXISTS_IN_MANIFEST").alias("hash_represented"))
    gone = missing_files(files, manifest).agg(F.count("*").alias("missing"))
    hashes = repeated_rows(manifest, F.lower(F.trim("sha256"))).agg(
        F.count("*").alias("repeated_hashes"))
    # Every table here is one aggregate row.
    out = paths
    for one in (orphans, gone, hashes):
        out = out.select("*", *[
            one.select(c).scalar().alias(c) for c in one.columns])
    return out


def archive_profile(files: DataFrame) -> DataFrame:
    """One row: files, bytes, readable, unreadable, rows with EXIF and its share.

    ``files`` carries length, readable (boolean) and has_exif (boolean).
    """
    exif = F.count_if(F.col("readable") & F.col("has_exif"))
    readable = F.count_if("readable")
    return files.agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"),
        readable.alias("readable"), F.count_if(~F.col("readable")).alias("unreadable"),
        exif.alias("with_exif"),
        F.when(F.count("*") > 0, exif * 100.0 / F.count("*")).alias("exif_pct"),
    )


def frequency(rows: DataFrame, key: Column, name: str = "value") -> DataFrame:
    return rows.groupBy(key.alias(name)).agg(F.count("*").alias("n"))


def year_frequency(files: DataFrame) -> DataFrame:
    """Files per four-digit top directory."""
    year = directory_part(F.col("relative_path"), 1)
    return frequency(files.filter(year.rlike(r"^\d{4}$")), year, "year")


def dimensions(width: Column, height: Column) -> Column:
    """Struct of width and height, NULL when either is missing."""
    return F.when(
        width.isNotNull() & height.isNotNull(),
        F.struct(width.alias("width"), height.alias("height")),
    )


def library(catalog: DataFrame, captions: DataFrame, thumbnails: DataFrame) -> DataFrame:
    """Catalog rows with caption, capture time and rendition sizes.

    ``captions`` is (row_no, path, caption), ``thumbnails`` (row_no, path,
    grid_width, grid_height, lightbox_width, lightbox_height); the last row of
    a path wins.
    """
    words = captions.groupBy("path").agg(F.max_by("caption", "row_no").alias("caption"))
    sizes = thumbnails.groupBy("path").agg(F.max_by(F.struct(
        dimensions(F.col("grid_width"), F.col("grid_height")).alias("grid"),
        dimensions(F.col("lightbox_width"), F.col("lightbox_height")).alias("lightbox"),
    ), "row_no").alias("_s"))
    return (
        catalog.join(words, "path", "left").join(sizes, "path", "left")
        .select(
            "pos", "path", "sha256", "filename",
            F.coalesce("caption", F.lit("")).alias("caption"),
            display_time(F.col("best_exif_date")).alias("captured"),
            F.col("_s.grid").alias("grid"), F.col("_s.lightbox").alias("lightbox"),
        )
    )


def library_page(items: DataFrame, offset: int, limit: int) -> DataFrame:
    """Rows of one page in ``pos`` order, with the ``total`` of all rows; past the end it is empty.

    Pages count rows, not stored positions, which may have holes.
    """
    placed = with_position(items, [F.col("pos")], "_place")
    return placed.filter(
        (F.col("_place") >= offset) & (F.col("_place") < offset + limit)
    ).drop("_place").withColumn("total", placed.agg(F.count("*")).scalar())


def first_by_hash(items: DataFrame) -> DataFrame:
    """One row per content hash: the first in catalog order."""
    row = F.struct(*[F.col(c) for c in items.columns if c != "sha256"])
    return items.groupBy("sha256").agg(F.min_by(row, "pos").alias("_r")).select(
        "sha256", "_r.*")


def with_records(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Rows with ``path`` joined to their library record or a placeholder.

    A path the catalog no longer lists keeps its row with a NULL hash, so
    counts agree; re-keyed tables (``by_hash``) drop it.
    """
    record = items.select("path", *[c for c in items.columns if c not in ("path", "pos")])
    return rows.join(record, "path", "left").withColumns({
        "filename": F.coalesce("filename", base_name(F.col("path"))),
        "caption": F.coalesce("caption", F.lit("")),
    })


def by_hash(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Path-keyed rows re-keyed to the content hash; strays dropped."""
    return rows.join(items.select("path", "sha256"), "path").drop("path")


def neighbours(items: DataFrame, targets: DataFrame, reach: int = 1) -> DataFrame:
    """(sha256, pos, offset, path): rows around each target, counted in rows of ``items``."""
    placed = with_position(items.select("pos", "path"), [F.col("pos")], "_place")
    around = targets.select("sha256", "pos").join(placed.select("pos", "_place"), "pos").select(
        "sha256", "_place", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("offset"))
    around = around.select(
        "sha256", "offset", (F.col("_place") + F.col("offset")).alias("_place"))
    return around.join(placed, "_place").drop("_place")


def item_view(
    items: DataFrame, people: DataFrame, roster: DataFrame, unplaced: DataFrame,
    events: DataFrame, event_members: DataFrame, duplicates: DataFrame,
) -> DataFrame:
    """One row per content hash: record, people, unplaced faces, event, group.

    ``people`` is (name, path), ``event_members`` (event_id, path) without the
    unassigned bucket, ``duplicates`` (path, group, tier). A path has few
    people, so they are nested; its duplicate siblings, itself included, are
    the rows of its ``group``.
    """
    named = people.select("name", "path").distinct().join(roster, "name")
    nested = named.groupBy("path").agg(F.array_sort(F.collect_list(
        F.struct("name", "images", "faces"))).alias("people"))
    own = event_members.groupBy("path").agg(F.min("event_id").alias("event_id")).join(
        events, "event_id").select(
        "path", F.struct("event_id", "name", "start", "end", "images").alias("event"))
    groups = duplicates.groupBy("path").agg(
        F.min_by(F.struct("tier", "group"), F.struct(_tier_order(), "group")).alias("_g"))
    return (
        first_by_hash(items).join(nested, "path", "left").join(unplaced, "path", "left")
        .join(own, "path", "left").join(groups, "path", "left")
        .select(
            *items.columns,
            F.coalesce("people", F.array().cast(
                "array<struct<name:string,images:bigint,faces:bigint>>")).alias("people"),
            F.coalesce("unplaced", F.lit(0)).alias("unplaced"), "event",
            F.col("_g.tier").alias("tier"), F.col("_g.group").alias("group"),
        )
    )


def _tier_order() -> Column:
    return F.when(F.col("tier") == "EXACT", 0).when(F.col("tier") == "NEAR", 1).otherwise(2)
