"""Ordinals that do not need a whole group in one task, and small-window cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import materialize

RRF_K = 60
CUT_CEILING = 40
CUT_FLOOR = 0.35

_CHUNK_SHIFT = 33  # monotonically_increasing_id: partition above, row below


def rank_within(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank",
    few_groups: bool = False,
) -> DataFrame:
    """Add the exact 1-based ordinal of every row inside its ``by`` group.

    A plain ``row_number`` puts each group into one task; here one query's
    ranking may be a whole catalog. Rows are range-partitioned on (group,
    order), so a large group is cut into as many chunks as it needs; a row's
    ordinal is its place in its chunk plus the size of the group's earlier
    chunks. ``order`` must be total (end it with a key). The sorted rows are
    materialised because sampled range bounds differ between evaluations.
    ``few_groups`` says the caller has bounded the number of groups.
    """
    keys = [F.col(c) for c in by]
    spread = (
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    spread = materialize(spread, "rank").withColumn(
        "_chunk", F.shiftright("_slot", _CHUNK_SHIFT)
    )
    # One row per (group, chunk): at most groups + partitions rows.
    sizes = spread.groupBy(*by, "_chunk").agg(
        F.count("*").alias("_n"), F.min("_slot").alias("_first")
    )
    if by:
        earlier = (
            Window.partitionBy(*by).orderBy("_chunk")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        offsets = sizes.select(
            *by, "_chunk", "_first",
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        )
    else:
        # One order: its chunks, one row per partition, are added up by the driver.
        found, before = [], 0
        for row in sorted(sizes.collect(), key=lambda r: r["_chunk"]):
            found.append((row["_chunk"], row["_first"], before))
            before += row["_n"]
        offsets = df.sparkSession.createDataFrame(
            found, "_chunk long, _first long, _before long")
    if few_groups or not by:
        offsets = F.broadcast(offsets)  # groups + partitions rows at most
    ordinal = F.col("_slot") - F.col("_first") + F.col("_before") + 1
    return (
        spread.join(offsets, [*by, "_chunk"])
        .withColumn(name, ordinal)
        .drop("_slot", "_chunk", "_first", "_before")
    )


def with_position(df: DataFrame, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """Add a 0-based catalog position over the whole table."""
    return rank_within(df, [], order, name).withColumn(name, F.col(name) - 1)


def top_within(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int | Column,
    name: str = "rank",
) -> DataFrame:
    """The first ``n`` rows of each group; the limit is pushed below the shuffle."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)


def salted_top(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, salts: int = 16,
) -> DataFrame:
    """The first ``n`` rows of each group, in two levels.

    Every task leaves ``n`` rows of a group, and with many tasks one reducer
    would meet them all; a first round over ``salts`` shares of each group
    leaves it ``salts`` x ``n`` rows. The row hash must tell rows apart.
    """
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    share = top_within(df.withColumn("_salt", salt), [*by, "_salt"], order, n)
    return top_within(share.drop("rank", "_salt"), by, order, n)


def largest(groups: DataFrame, size: str, key: str, n: int) -> DataFrame:
    """The ``n`` groups of the greatest ``size``, numbered from 1; ties by ``key``.

    The limit is taken in every task first, so no task sees all groups.
    """
    head = groups.orderBy(F.desc(size), key).limit(n)
    order = Window.orderBy(F.desc(size), key)  # n rows
    return head.withColumn("place", F.row_number().over(order))


def reciprocal_rank(rank: Column, k: int = RRF_K) -> Column:
    return 1.0 / (rank + F.lit(k))


def fuse_rankings(
    image: DataFrame, caption: DataFrame, k: int = RRF_K
) -> DataFrame:
    """Full-outer fusion of two (query_id, path, rank) tables, absent side = 0."""
    left = image.select("query_id", "path", F.col("rank").alias("image_rank"))
    right = caption.select("query_id", "path", F.col("rank").alias("caption_rank"))
    return left.join(right, ["query_id", "path"], "full_outer").withColumn(
        "score",
        F.coalesce(reciprocal_rank(F.col("image_rank"), k), F.lit(0.0))
        + F.coalesce(reciprocal_rank(F.col("caption_rank"), k), F.lit(0.0)),
    )


def gradient_cut(
    top: DataFrame, by: Sequence[str],
    floor: float = CUT_FLOOR, ceiling: int = CUT_CEILING,
) -> DataFrame:
    """(group, cut, plateau): where a falling score sequence flattens.

    ``top`` holds each group's ranked scores. Only the first ``ceiling`` ranks
    are read, so each window holds at most that many rows. Fewer than three
    scores, or a first drop of zero, keep them all without a plateau.
    """
    window = Window.partitionBy(*by).orderBy("rank")
    drops = (
        top.filter(F.col("rank") <= ceiling)
        .withColumn("_drop", F.col("score") - F.lead("score").over(window))
        .withColumn("_lead", F.first("_drop").over(window))
    )
    flat = F.min(F.when(F.col("_drop") < F.col("_lead") * floor, F.col("rank")))
    usable = (F.count("*") >= 3) & (F.max("_lead") > 0)
    return drops.groupBy(*by).agg(
        F.when(usable & flat.isNotNull(), flat).otherwise(F.count("*")).cast("int").alias("cut"),
        F.coalesce(usable & flat.isNotNull(), F.lit(False)).alias("plateau"),
    )


def spread_trim(
    df: DataFrame, by: Sequence[str], score: str = "score",
    drop_ratio: float = 0.80, when: Column | None = None, flag: str = "trimmed",
    few_groups: bool = False,
) -> DataFrame:
    """Flag the tail of each group: below best - ratio * (best - worst).

    Groups under four rows, or without any spread, keep everything. The
    bounds come from a partial aggregate and a join, not a window, so a group
    of any size stays spread out. ``few_groups`` says the caller has bounded
    the number of groups, so their bounds are broadcast.
    """
    bounds = df.groupBy(*by).agg(
        F.max(score).alias("_best"), F.min(score).alias("_worst"),
        F.count("*").alias("_n"),
    )
    below = (
        (F.col("_n") >= 4)
        & (F.col("_best") > F.col("_worst"))
        & (F.col(score) < F.col("_best") - (F.col("_best") - F.col("_worst")) * drop_ratio)
    )
    if when is not None:
        below = below & when
    return (
        df.join(F.broadcast(bounds) if few_groups else bounds, list(by))
        .withColumn(flag, F.coalesce(below, F.lit(False)))
        .drop("_best", "_worst", "_n")
    )
