"""Incremental forms of two batch jobs: enrichment of landed rows, live events.

Both are additions for sources that keep growing; the batch jobs do not need
them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from shelfmark.operators.enrich import run_enricher, scanned_rows


def enrich_landed(
    spark: SparkSession, landing: str, schema: StructType, out: str, checkpoint: str,
    enrich: Callable[[dict], Iterable[dict]], outputs: str,
) -> StreamingQuery:
    """Enrich every Parquet file that landed since the last run, then stop.

    The stream's checkpoint is the list of finished files. A batch that is
    replayed after a failure overwrites its own folder, so nothing is doubled.
    """
    rows = spark.readStream.schema(schema).parquet(landing)

    def store(batch: DataFrame, number: int) -> None:
        made = run_enricher(batch, enrich, outputs)
        made.write.mode("overwrite").parquet(f"{out}/enriched/batch={number}")
        stored = spark.read.parquet(f"{out}/enriched/batch={number}")
        scanned_rows(stored).write.mode("overwrite").parquet(f"{out}/scanned/batch={number}")

    return (
        rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def live_events(rows: DataFrame, key: str, ts: str = "ts", gap: str = "72 hours",
                late: str = "1 hour") -> DataFrame:
    """Sessions of a stream per key: (key, start, end, n), closed by the watermark.

    ``end`` is the last row's time, not the window's end, which lies one gap
    later. The newest session of a key stays open until the watermark passes.
    """
    return (
        rows.withWatermark(ts, late)
        .groupBy(F.col(key), F.session_window(F.col(ts), gap).alias("_w"))
        .agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))
        .drop("_w")
    )
