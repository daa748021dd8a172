"""Readers and writers of the stored tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from shelfmark.functions.text import suffix
from shelfmark.operators.audit import FINGERPRINT_CHUNK, index_statistics, order_fingerprint
from shelfmark.operators.catalog import IMAGE_EXTENSIONS
from shelfmark.operators.people import read_label_map
from shelfmark.operators.ranking import with_position
from shelfmark.schemas import INDEX_MANIFEST, REGRESSION_BASELINE


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A headed UTF-8 CSV (a byte-order mark is skipped) with declared types.

    Cells that do not fit their type fail the read; an empty cell is NULL, but
    a quoted one is an empty text where the type is one.
    """
    fields = StructType.fromDDL(schema).fields
    # Cells come as text: Spark's reader has one value for NULL, and every text may be one.
    cells = spark.read.schema(StructType([StructField(f.name, StringType()) for f in fields])).csv(
        path, header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST",
        enforceSchema=False, nullValue=uuid.uuid4().hex, emptyValue="",
        charToEscapeQuoteEscaping='"',
    )

    def typed(field: StructField) -> Column:
        cell = F.col(_quoted(field.name))
        if isinstance(field.dataType, StringType):
            return cell
        one = StructType([StructField("cell", field.dataType)])
        return F.from_csv(F.nullif(cell, F.lit("")), one.toDDL(), {"mode": "FAILFAST"})[
            "cell"].alias(field.name)

    return cells.select(*map(typed, fields))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def read_optional(
    spark: SparkSession, path: str, schema: str
) -> tuple[DataFrame, bool]:
    """(table, exists): a missing file reads as an empty table and False.

    "Nothing recorded" and "never built" are different answers, so callers get
    both.
    """
    return _or_empty(spark, lambda: read_csv(spark, path, schema), schema)


def read_optional_table(
    spark: SparkSession, path: str, schema: str
) -> tuple[DataFrame, bool]:
    """``read_optional`` for a table of ``append_table`` or ``write_table``."""
    return _or_empty(spark, lambda: spark.read.schema(schema).parquet(path), schema)


def _or_empty(
    spark: SparkSession, read: Callable[[], DataFrame], schema: str
) -> tuple[DataFrame, bool]:
    try:
        return read(), True
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema), False


def write_csv(df: DataFrame, path: str) -> None:
    """A headed CSV that ``read_csv`` reads back as it was: NULL is an empty cell, texts are whole."""
    df.write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"', emptyValue='""',
        charToEscapeQuoteEscaping='"',  # unset it is NUL, which then is lost from texts
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_table(df: DataFrame, path: str) -> None:
    """Full rewrite. The target must not be a source of ``df``."""
    df.write.mode("overwrite").parquet(path)


def append_table(df: DataFrame, path: str) -> None:
    """Append; a task's rows appear only when its file is committed."""
    df.write.mode("append").parquet(path)


def list_files(
    spark: SparkSession, root: str, extensions: list[str] | None = None
) -> DataFrame:
    """(path, relative_path, length, modified) of pictures under ``root``.

    The content column is never read. Positions follow the path order and are
    added by the catalog build.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    wanted = IMAGE_EXTENSIONS if extensions is None else extensions
    plain = _plain_path(F.col("path"))
    base = root.rstrip("/") + "/"
    return files.select(
        plain.alias("path"), F.col("length"), F.col("modificationTime").alias("modified")
    ).filter(suffix(F.col("path")).isin(wanted)).withColumn(
        "relative_path", F.when(F.startswith(F.col("path"), F.lit(base)),
                                F.substr(F.col("path"), F.lit(len(base) + 1)))
        .otherwise(F.col("path")))


def _plain_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^file:/*", "/")


def hash_files(
    spark: SparkSession, root: str, extensions: list[str] | None = None
) -> DataFrame:
    """(path, length, sha256) of each picture's content, one file per row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    wanted = IMAGE_EXTENSIONS if extensions is None else extensions
    return files.filter(suffix(F.col("path")).isin(wanted)).select(
        _plain_path(F.col("path")).alias("path"), "length",
        F.sha2("content", 256).alias("sha256"))


def publish_index(
    rows: DataFrame, path: str, source_sha256: str = ""
) -> DataFrame:
    """Write a vector index (path, vec, ...) with positions and its manifest.

    A vector lives in its row, so nothing depends on file order; ``pos`` fixes
    the catalog order and feeds the fingerprint, whose chunk size is recorded
    with it. Returns the one manifest row.
    """
    with_position(rows, [F.col("path")]).write.mode("overwrite").parquet(f"{path}/vectors")
    stored = read_index(rows.sparkSession, path)
    manifest = index_statistics(stored).select(
        "*", order_fingerprint(stored.select("pos", "path")).select("fingerprint").scalar()
        .alias("lookup_fingerprint"), F.lit(FINGERPRINT_CHUNK).alias("fingerprint_chunk"),
        F.lit(source_sha256).alias("source_sha256"))
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return read_manifest(rows.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/vectors")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_MANIFEST).json(f"{path}/manifest")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(face_id, name) from a JSON file of {name: [face_id, ...]}."""
    return read_label_map(spark.read.text(path, wholetext=True))


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(query, filename) from a regression baseline; a query without results has a NULL filename."""
    stored = spark.read.schema(REGRESSION_BASELINE).json(path, multiLine=True)
    return stored.select(F.explode("queries").alias("query", "_q")).select(
        "query", F.explode_outer("_q.filenames").alias("filename"))


def write_baseline(
    measured: DataFrame, path: str, queries: DataFrame | None = None, note: str = ""
) -> None:
    """Store (query, filename) rows as the next run's baseline, as ``read_baseline`` reads it.

    ``queries`` (query) names the whole suite, so that queries without results
    are kept. The file is one object for a suite that people write by hand:
    {note, queries: {query: {count, filenames}}}.
    """
    named = measured.select("query", "filename")
    if queries is not None:
        named = named.unionByName(queries.select("query", F.lit(None).cast("string").alias("filename")))
    found = F.collect_list("filename")  # leaves NULLs out
    each = named.groupBy("query").agg(F.struct(
        F.size(found).alias("count"), F.array_sort(found).alias("filenames")).alias("entry"))
    each.agg(F.map_from_entries(F.collect_list(F.struct("query", "entry"))).alias("queries")).select(
        F.lit(note).alias("note"), "queries").coalesce(1).write.mode("overwrite").json(path)
