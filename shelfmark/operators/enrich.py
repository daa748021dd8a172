"""Resumable enrichment: what is left to do, a caller's function over it, statuses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import base_name
from shelfmark.functions.vectors import norm
from shelfmark.operators.ranking import rank_within

MIN_SCORE = 0.60
MIN_PIXELS = 40

# Longest edge in pixels of each rendition.
RENDITIONS = {"grid": 400, "lightbox": 1600}

GIVEN = 256  # rows whose results leave together, about


def todo(catalog: DataFrame, done: DataFrame, force: bool = False,
         limit: int | None = None) -> DataFrame:
    """Catalog rows without a done row, optionally the first ``limit`` by position."""
    rows = catalog if force else catalog.join(done.select("path").distinct(), "path", "left_anti")
    return rows.orderBy("pos").limit(limit) if limit else rows


def run_enricher(
    rows: DataFrame, enrich: Callable, schema: str, batch_rows: int | None = None,
) -> DataFrame:
    """Apply a caller's function; failures become status rows that say why.

    ``enrich`` gets a row as a dict and yields dicts of ``schema``. With
    ``batch_rows`` it gets a pandas frame of up to so many rows instead and
    returns one list of dicts per row, as models that work on batches do; a
    batch that fails is tried again row by row, so one bad row fails alone.
    The output is (path, status, reason, found, outputs), one row per input:
    a row that was read without results differs from one that could not be.
    """
    def whole(frame: pd.DataFrame) -> list[list[dict]]:
        if batch_rows:
            made = [list(found) for found in enrich(frame)]
            if len(made) != len(frame):
                raise ValueError(f"{len(made)} results for {len(frame)} rows")
            return made
        return [list(enrich(record)) for record in frame.to_dict("records")]

    def tried(frame: pd.DataFrame) -> Iterator[tuple[list[dict], str]]:
        try:
            yield from [(made, "") for made in whole(frame)]
        except Exception as error:  # noqa: BLE001  (any failure is a status)
            if len(frame) == 1:
                yield [], f"{type(error).__name__}: {error}"
            else:
                for i in range(len(frame)):
                    yield from tried(frame.iloc[i:i + 1])

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = batch_rows or 1
        given = max(step, GIVEN // step * step)
        for whole_frame in frames:
            # Results leave in pieces, so that those of a whole batch are never held.
            for start in range(0, len(whole_frame), given):
                frame = whole_frame.iloc[start:start + given]
                results = [r for i in range(0, len(frame), step)
                           for r in tried(frame.iloc[i:i + step])]
                yield pd.DataFrame({
                    "path": frame["path"].to_numpy(),
                    "status": ["unreadable" if r else "ok" for _, r in results],
                    "reason": [r for _, r in results], "found": [len(made) for made, _ in results],
                    "outputs": [made for made, _ in results]})

    return rows.mapInPandas(batches, stored_schema(schema))


def stored_schema(schema: str) -> str:
    """The columns of ``run_enricher`` whose outputs have ``schema``."""
    return ("path string, status string, reason string, found int, "
            f"outputs array<struct<{schema}>>")


def scanned_rows(enriched: DataFrame) -> DataFrame:
    """(path, filename, found, status, reason): the ledger the next run skips by."""
    return enriched.select(
        "path", base_name(F.col("path")).alias("filename"), "found", "status", "reason")


def output_rows(enriched: DataFrame, first_id: int = 0, id_name: str = "face_id") -> DataFrame:
    """The enrichers' output rows with ids continuing from ``first_id``."""
    flat = enriched.select("path", F.posexplode("outputs").alias("_i", "_o")).select(
        "path", "_i", "_o.*")
    numbered = rank_within(flat, [], [F.col("path"), F.col("_i")], "_r")
    return numbered.withColumn(
        id_name, (F.col("_r") - 1 + first_id).cast("string")).drop("_r", "_i")


def acceptable(score: Column, width: Column, height: Column, vector: Column,
               min_score: float = MIN_SCORE, min_pixels: int = MIN_PIXELS) -> Column:
    """Whether a detection is sure, large and non-zero enough to keep."""
    return F.coalesce(
        (score >= min_score) & (width >= min_pixels) & (height >= min_pixels)
        & (norm(vector) > 0),
        F.lit(False))


def quality_counts(detections: DataFrame, keep: Column) -> DataFrame:
    """One row: kept and rejected detections, in one pass."""
    return detections.agg(
        F.count_if(keep).alias("kept"), F.count_if(~keep).alias("rejected"))


def fit_longest(width: Column, height: Column, longest: Column) -> Column:
    """Struct (width, height) fitted to a longest edge; NULL without area.

    Never enlarges, keeps at least one pixel, and rounds half to even.
    """
    edge = F.greatest(width, height)
    scale = longest / edge.cast("double")

    def scaled(side: Column) -> Column:
        return F.when(edge <= longest, side).otherwise(
            F.greatest(F.lit(1), F.bround(side * scale, 0).cast("int")))

    return F.when((width > 0) & (height > 0), F.struct(
        scaled(width).cast("int").alias("width"), scaled(height).cast("int").alias("height")))


def pending_renditions(
    catalog: DataFrame, existing: DataFrame, force: bool = False
) -> DataFrame:
    """(sha256, kind, longest) still to render; ``existing`` is (sha256, kind)."""
    kinds = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.lit(e).alias("longest"))
        for k, e in RENDITIONS.items()])
    wanted = catalog.select("sha256").distinct().select("sha256", F.explode(kinds).alias("_k"))
    wanted = wanted.select("sha256", "_k.kind", "_k.longest")
    return wanted if force else wanted.join(existing, ["sha256", "kind"], "left_anti")


def rendition_plan(catalog: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """Pending renditions with target sizes and the one decode size per hash.

    ``catalog`` is (pos, sha256, width, height); the first row of a hash
    supplies the size.
    """
    pending = pending_renditions(catalog, existing, force)
    draft = pending.groupBy("sha256").agg(F.max("longest").alias("draft_longest"))
    source = catalog.groupBy("sha256").agg(
        F.min_by(F.struct("width", "height"), "pos").alias("_s"))
    target = fit_longest(F.col("_s.width"), F.col("_s.height"), F.col("longest"))
    return (
        pending.join(draft, "sha256").join(source, "sha256")
        .select("sha256", "kind", "longest", "draft_longest",
                target["width"].alias("width"), target["height"].alias("height"),
                F.when(target.isNull(), "unreadable").otherwise("pending").alias("status"))
    )


__all__ = [
    "acceptable", "fit_longest", "output_rows", "pending_renditions", "quality_counts",
    "rendition_plan", "run_enricher", "scanned_rows",
    "stored_schema", "todo",
]
