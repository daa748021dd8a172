"""Duplicate groups in three tiers, with a keeper per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.components import connected_components, thin_edges
from shelfmark.operators.cosine import COSINE, cosine_edges
from shelfmark.operators.hamming import DISTANCE, hamming_edges
from shelfmark.operators.ranking import rank_within
from shelfmark.session import materialize

TIERS = ("EXACT", "NEAR", "SIMILAR")
PAGE = 1_000  # members per nested row


def exact_members(catalog: DataFrame) -> DataFrame:
    """(pos, lead) of rows sharing a content hash; empty hashes are ignored."""
    hashed = catalog.select(
        "pos", F.lower(F.trim("sha256")).alias("_sha")
    ).filter(F.col("_sha") != "")
    groups = hashed.groupBy("_sha").agg(
        F.min("pos").alias("lead"), F.count("*").alias("_n")
    ).filter(F.col("_n") > 1)
    return hashed.join(groups, "_sha").select("pos", "lead")


def near_members(
    signatures: DataFrame, distance: int = DISTANCE
) -> DataFrame:
    """(pos, lead) of rows chained by close signatures; input (pos, signature)."""
    rows = signatures.select(F.col("pos").alias("id"), "signature")
    return _members(thin_edges(hamming_edges(rows, distance)))


def similar_members(vectors: DataFrame, threshold: float = COSINE) -> DataFrame:
    """(pos, lead) of rows chained by close vectors; input (pos, vec)."""
    rows = vectors.filter("vec IS NOT NULL").select(F.col("pos").alias("id"), "vec")
    return _members(cosine_edges(rows, threshold))


def _members(edges: DataFrame) -> DataFrame:
    found = connected_components(edges)
    return found.select(F.col("node").alias("pos"), F.col("component").alias("lead"))


def not_covered(members: DataFrame, prior: DataFrame) -> DataFrame:
    """Members of the groups holding at least one row outside ``prior``.

    A group inside the union of earlier tiers' members adds nothing, even if
    no single earlier group holds all of it.
    """
    known = prior.select("pos").distinct().withColumn("_known", F.lit(True))
    groups = (
        members.join(known, "pos", "left").groupBy("lead")
        .agg(F.bool_and(F.coalesce("_known", F.lit(False))).alias("_covered"))
        .filter(~F.col("_covered")).select("lead")
    )
    return members.join(groups, "lead", "left_semi").select("pos", "lead")


def _number(name: str) -> Column:
    return F.coalesce(F.expr(f"try_cast(nullif(trim({name}), '') AS BIGINT)"), F.lit(0))


def keeper_order(catalog: DataFrame) -> Column:
    """What a keeper maximises: pixels, bytes, then the capture date text.

    A missing date sorts as ``9999`` and the latest date wins, so an undated
    row beats a dated one; then the earliest row stays first.
    """
    def column(name: str) -> Column:
        if name not in catalog.columns:
            return F.lit(0).cast("bigint")
        if dict(catalog.dtypes)[name] == "string":
            return _number(name)
        return F.coalesce(F.col(name).cast("bigint"), F.lit(0).cast("bigint"))

    date = (
        F.coalesce(F.nullif(F.col("best_exif_date"), F.lit("")), F.lit("9999"))
        if "best_exif_date" in catalog.columns else F.lit("9999")
    )
    return F.struct(
        (column("width") * column("height")).alias("pixels"), column("bytes").alias("bytes"),
        date.alias("date"), (-F.col("pos")).alias("earlier"),
    )


def keepers(members: DataFrame, catalog: DataFrame, by: list[str]) -> DataFrame:
    """(group key, keeper): the row to keep, found by a partial aggregate."""
    order = catalog.select("pos", keeper_order(catalog).alias("_order"))
    return members.join(order, "pos").groupBy(*by).agg(
        F.max_by("pos", "_order").alias("keeper"), F.count("*").alias("size")
    )


def grouped_report(tiers: DataFrame, catalog: DataFrame) -> DataFrame:
    """Report rows from (tier, pos, lead): numbered groups with a keep flag."""
    groups = keepers(tiers, catalog, ["tier", "lead"])
    numbered = rank_within(
        groups, ["tier"], [F.col("lead")], "number", few_groups=True
    ).select(
        "tier", "lead", "keeper",
        F.concat(F.lower("tier"), F.lit("-"), F.col("number").cast("string")).alias("group"),
    )
    return (
        tiers.join(numbered, ["tier", "lead"])
        .join(catalog, "pos")
        .select("tier", "group", (F.col("pos") == F.col("keeper")).alias("keep"),
                *[c for c in catalog.columns])
    )


def duplicate_tiers(
    catalog: DataFrame, signatures: DataFrame, vectors: DataFrame,
    distance: int = DISTANCE, threshold: float = COSINE,
) -> DataFrame:
    """(tier, pos, lead) after dropping groups covered by earlier tiers."""
    exact = materialize(exact_members(catalog), "exact")
    near = materialize(not_covered(near_members(signatures, distance), exact), "near")
    earlier = exact.unionByName(near)
    similar = not_covered(similar_members(vectors, threshold), earlier)
    out = None
    for tier, rows in zip(TIERS, (exact, near, similar)):
        tagged = rows.select(F.lit(tier).alias("tier"), "pos", "lead")
        out = tagged if out is None else out.unionByName(tagged)
    return out


def duplicate_report(
    catalog: DataFrame, signatures: DataFrame, vectors: DataFrame,
    distance: int = DISTANCE, threshold: float = COSINE,
) -> DataFrame:
    """Every duplicate group of a catalog, largest picture kept."""
    tiers = materialize(
        duplicate_tiers(catalog, signatures, vectors, distance, threshold), "tiers")
    return grouped_report(tiers, catalog)


def redundancy(report: DataFrame) -> DataFrame:
    """One row per tier: groups, entries, and rows that could go (EXACT, NEAR)."""
    sizes = report.groupBy("tier", "group").agg(F.count("*").alias("_n"))
    return sizes.groupBy("tier").agg(
        F.count("*").alias("groups"), F.sum("_n").alias("entries"),
        F.sum(F.when(F.col("tier") != "SIMILAR", F.col("_n") - 1).otherwise(0))
        .alias("redundant"),
    )


def nested_groups(members: DataFrame, page: int = PAGE) -> DataFrame:
    """(tier, group, page, members): report groups with nested members.

    A group of any size comes out whole, in pages of at most ``page`` members
    by position; ordinary groups have the one page 0.
    """
    placed = rank_within(members, ["tier", "group"], [F.col("pos")], "_at")
    paged = placed.withColumn("page", F.floor((F.col("_at") - 1) / page).cast("int"))
    entry = F.struct("pos", "path", "keep")
    return paged.groupBy("tier", "group", "page").agg(
        F.array_sort(F.collect_list(entry)).alias("members"))
