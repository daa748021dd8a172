"""Session helpers: builder defaults, durable cuts of the lineage, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Set by local sessions only: over how many partitions given tables are dealt.
LOCAL_SPREAD = "shelfmark.local.spread"

# What one batch handed to a Python worker may hold; Spark's own bound is eight times that.
BATCH_BYTES = "8m"


def bound_batches(spark: SparkSession, size: str = BATCH_BYTES) -> None:
    """Batches that go by their bytes, however long the texts of a table are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def local_session(app: str = "shelfmark", cores: str = "*", **conf) -> SparkSession:
    """A local session for tests and benches. Clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # A long session keeps the figures of its last queries: skipped stages are dropped first.
        .config("spark.ui.retainedStages", "20000")
        # No stack trace for every column expression: plans are built twice as fast.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        # Lists of a few values per key are hashed; the default sorts from 128 keys on.
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "100000")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set(LOCAL_SPREAD, str(spark.sparkContext.defaultParallelism))
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for durable intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (a local test session) is a folder of our own chosen and recorded.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(root)
    return root


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the checkpoint folder (with writer ``options``) and read it back.

    Used where a plan must not be evaluated twice (range bounds are sampled)
    or where several later steps read the same expensive rows. The copy is a
    Parquet table, so it keeps column pruning and size statistics and outlives
    any executor.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/shelfmark/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hash-partitioned on ``keys`` over all shuffle partitions.

    For steps that cost far more than their bytes suggest: adaptive coalescing
    goes by size and would give a few cores all of the work.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
            spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)
