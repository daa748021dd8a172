"""People in a catalog: clusters of faces, their names, and what they appear in.

``faces`` is (pos, face_id, cluster, path, det_score, sex, age); a NULL or
``unassigned`` cluster is a face the clusterer did not place. ``labels`` is
(face_id, name), one row per named face.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import padded_id
from shelfmark.operators.filters import UNASSIGNED
from shelfmark.operators.ranking import rank_within, top_within
from shelfmark.session import materialize

SHEET_LIMIT = 24


def read_label_map(lines: DataFrame) -> DataFrame:
    """(face_id, name) from JSON text rows ``value`` of {name: [face_id, ...]}.

    A face listed under two names belongs to the later one.
    """
    maps = lines.select(
        F.from_json("value", "map<string,array<string>>").alias("_m"),
        F.monotonically_increasing_id().alias("_row"),
    )
    faces = maps.select("_row", F.posexplode(F.map_entries("_m")).alias("_i", "_e")).select(
        F.struct("_row", "_i").alias("_at"), F.col("_e.key").alias("name"),
        F.explode("_e.value").alias("face_id"),
    )
    return faces.groupBy("face_id").agg(F.max_by("name", "_at").alias("name"))


def people_index(faces: DataFrame, labels: DataFrame) -> DataFrame:
    """(name, path, face_id): placed faces of named people, unnamed dropped."""
    named = labels.filter(F.coalesce("name", F.lit("")) != "")
    return faces.join(named, "face_id").select("name", "path", "face_id")


def people_roster(index: DataFrame) -> DataFrame:
    """(name, images, faces): distinct paths and faces per person."""
    return index.groupBy("name").agg(
        F.count_distinct("path").alias("images"), F.count("*").alias("faces"))


def unplaced_counts(faces: DataFrame) -> DataFrame:
    """(path, unplaced): faces per path the clusterer left out, where any."""
    return (
        faces.filter(F.coalesce("cluster", F.lit(UNASSIGNED)) == UNASSIGNED)
        .groupBy("path").agg(F.count("*").alias("unplaced"))
    )


def name_clusters(members: DataFrame) -> DataFrame:
    """Rename (id, cluster) labels by size: ``Person_001`` is the largest.

    Equal sizes keep the order of their lowest member; noise is ``unassigned``.
    """
    sizes = members.filter("cluster IS NOT NULL").groupBy("cluster").agg(
        F.count("*").alias("_n"))
    named = rank_within(sizes, [], [F.desc("_n"), F.col("cluster")], "_r").select(
        "cluster", padded_id("Person_", F.col("_r")).alias("person"))
    return members.join(named, "cluster", "left").withColumn(
        "person", F.coalesce("person", F.lit(UNASSIGNED)))


def _most_common(value: str) -> Column:
    """The most frequent value; ties go to the one seen first."""
    return F.max(F.struct(F.col("_n"), (-F.col("_first")).alias("_f"),
                          F.col(value).alias("value"))).getField("value")


def cluster_summary(faces: DataFrame) -> DataFrame:
    """Per cluster: faces, images, age range and median, dominant sex.

    Ages that are not plain digits are left out.
    """
    age = F.when(F.col("age").cast("string").rlike(r"^\d+$"), F.col("age").cast("int"))
    placed = faces.withColumn("cluster", F.coalesce("cluster", F.lit(UNASSIGNED)))
    base = placed.groupBy("cluster").agg(
        F.count("*").alias("faces"), F.count_distinct("path").alias("images"),
        F.min(age).alias("youngest"), F.max(age).alias("oldest"),
        F.percentile(age, 0.5).cast("int").alias("median_age"),
    )
    sexes = placed.groupBy("cluster", "sex").agg(
        F.count("*").alias("_n"), F.min("pos").alias("_first"))
    return base.join(
        sexes.groupBy("cluster").agg(_most_common("sex").alias("dominant_sex")), "cluster")


def cluster_sheet(faces: DataFrame, limit: int = SHEET_LIMIT) -> DataFrame:
    """The best-detected faces of each cluster, for a contact sheet."""
    return top_within(faces, ["cluster"], [F.desc("det_score"), F.col("pos")], limit)


def label_votes(faces: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, name, votes): each cluster's most common stored name."""
    votes = faces.join(labels, "face_id").groupBy("cluster", "name").agg(
        F.count("*").alias("_n"), F.min("pos").alias("_first"))
    return votes.groupBy("cluster").agg(
        _most_common("name").alias("name"), F.max("_n").alias("votes"))


def label_status(faces: DataFrame, labels: DataFrame) -> DataFrame:
    """Per cluster: faces, name, votes, the share note when not unanimous, and its place.

    The list shows large clusters first, equally large ones as they first
    come, and the unassigned last.
    """
    sizes = faces.groupBy("cluster").agg(
        F.count("*").alias("faces"), F.min("pos").alias("_came"))
    rows = sizes.join(label_votes(faces, labels), "cluster", "left")
    note = F.when(F.col("name").isNull(), "-").when(
        F.col("votes") < F.col("faces"),
        F.format_string("%s  (%d/%d known)", "name", "votes", "faces"),
    ).otherwise(F.col("name"))
    noted = materialize(rows.withColumn("note", note).withColumn(
        "last", F.coalesce(F.col("cluster") == UNASSIGNED, F.lit(True))), "label-status")
    return rank_within(
        noted, [], [F.col("last"), F.desc("faces"), F.col("_came"), F.col("cluster")], "place"
    ).drop("_came", "_first")


def label_totals(status: DataFrame) -> DataFrame:
    """One row: clusters, named clusters, faces, covered faces, coverage."""
    named = F.col("name").isNotNull()
    covered = F.sum(F.when(named, F.col("faces")).otherwise(0))
    return status.agg(
        F.count("*").alias("clusters"), F.count_if(named).alias("named_clusters"),
        F.sum("faces").alias("faces"), covered.alias("covered_faces"),
        (covered * 100.0 / F.sum("faces")).alias("coverage_pct"),
    )


def set_label(faces: DataFrame, labels: DataFrame, cluster: str, name: str) -> DataFrame:
    """Labels after naming a cluster: its faces leave any other name.

    Naming two clusters alike merges them; a name left without faces is gone.
    """
    mine = faces.filter(F.col("cluster") == cluster).select("face_id").distinct()
    kept = labels.join(mine, "face_id", "left_anti").select("face_id", "name")
    return kept.unionByName(mine.withColumn("name", F.lit(name)))


def forget_label(labels: DataFrame, name: str) -> DataFrame:
    return labels.filter(F.col("name") != name).select("face_id", "name")


def labels_json(labels: DataFrame, page: int = 10_000) -> DataFrame:
    """(name, page, value): JSON lines of {name: [face_id, ...]}, ids in order.

    A person with very many faces takes several lines; ``read_label_map``
    reads them back as one.
    """
    placed = rank_within(labels, ["name"], [F.col("face_id")], "_at")
    paged = placed.withColumn("page", F.floor((F.col("_at") - 1) / page).cast("int"))
    per_name = paged.groupBy("name", "page").agg(
        F.array_sort(F.collect_list("face_id")).alias("_ids"))
    return per_name.select("name", "page", F.to_json(F.create_map("name", "_ids")).alias("value"))
