"""Declared schemas (DDL) of the stored tables. Files are never read with inference."""

from __future__ import annotations


CATALOG = (
    "image_id STRING, source_path STRING, relative_path STRING, filename STRING, "
    "extension STRING, file_bytes BIGINT, sha256 STRING, provenance_status STRING, "
    "gmail_directory_year STRING, gmail_directory_month STRING, gmail_message_date STRING, "
    "gmail_from STRING, gmail_subject STRING, gmail_message_id STRING, "
    "gmail_thread_id STRING, original_filename STRING, width INT, height INT, "
    "image_format STRING, image_mode STRING, has_exif INT, exif_datetime_original STRING, "
    "exif_datetime_digitized STRING, exif_datetime_modified STRING, best_exif_date STRING, "
    "camera_make STRING, camera_model STRING, orientation STRING, image_error STRING"
)
MANIFEST = (
    "downloaded_path STRING, sha256 STRING, message_date STRING, `from` STRING, "
    "subject STRING, gmail_message_id STRING, gmail_thread_id STRING, "
    "original_filename STRING"
)
CAPTIONS = (
    "source_path STRING, filename STRING, caption STRING, model STRING, revision STRING")
CAPTION_LOOKUP = ("source_path STRING, filename STRING, caption STRING")
IMAGE_LOOKUP = (
    "row_index BIGINT, image_id STRING, source_path STRING, relative_path STRING, "
    "filename STRING, provenance_status STRING, gmail_directory_year STRING, "
    "gmail_directory_month STRING, gmail_message_date STRING, gmail_subject STRING, "
    "best_exif_date STRING"
)
VISUAL_LOOKUP = (
    "source_path STRING, filename STRING, sha256 STRING, width INT, height INT, "
    "bytes BIGINT, best_exif_date STRING"
)
FACE_LOOKUP = (
    "face_id STRING, source_path STRING, filename STRING, x1 INT, y1 INT, x2 INT, y2 INT, "
    "width INT, height INT, det_score DOUBLE, sex STRING, age STRING"
)
FACE_SCANNED = (
    "source_path STRING, filename STRING, faces INT, status STRING")
FACE_CLUSTERS = (
    "person STRING, face_id STRING, source_path STRING, filename STRING, x1 INT, y1 INT, "
    "x2 INT, y2 INT, det_score DOUBLE, sex STRING, age STRING"
)
EVENTS = (
    "event_id STRING, event_name STRING, event_start STRING, event_end STRING, "
    "image_count BIGINT, date_source STRING, source_path STRING, filename STRING, "
    "capture_time STRING, gmail_subject STRING, gmail_thread_id STRING"
)
DUPLICATE_GROUPS = (
    "tier STRING, `group` STRING, keep STRING, filename STRING, width INT, height INT, "
    "bytes BIGINT, best_exif_date STRING, source_path STRING"
)
THUMBNAILS = (
    "sha256 STRING, source_path STRING, grid_width INT, grid_height INT, "
    "lightbox_width INT, lightbox_height INT, status STRING"
)
PALETTE = ("sha256 STRING, hue DOUBLE, lightness DOUBLE, status STRING")
FILES_WITHOUT_MANIFEST = (
    "path STRING, sha256 STRING, status STRING, detail STRING")
MANIFEST_WITHOUT_FILE = (
    "downloaded_path STRING, original_filename STRING, sha256 STRING, message_date STRING, "
    "subject STRING, gmail_message_id STRING"
)
DUPLICATE_MANIFEST_PATHS = (
    "downloaded_path STRING, sha256 STRING, message_date STRING, subject STRING, "
    "gmail_message_id STRING"
)
REGRESSION_BASELINE = (
    "note STRING, queries MAP<STRING, STRUCT<count: INT, filenames: ARRAY<STRING>>>")
INDEX_MANIFEST = (
    "vectors BIGINT, dimension INT, dtype STRING, min_norm DOUBLE, max_norm DOUBLE, "
    "lookup_fingerprint STRING, fingerprint_chunk INT, source_sha256 STRING"
)
