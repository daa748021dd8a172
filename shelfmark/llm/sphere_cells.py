"""Near-duplicate vectors: spherical k-means cells and blocked cosine products.

Centroids are fitted on a bounded sample; every vector is then indexed. Each
has one home cell and is also sent to lower-numbered cells whose border it is
near: two vectors at the threshold angle a are apart by at most sin(a) across
any border, which is the margin, so every pair is found. (A smaller ``reach``
allows for that many times sin(a) / sqrt(d) in d dimensions. This misses pairs
where differences do not spread evenly over all dimensions.) A pair is compared
in the home cell of one of the two, once. Where the sample shows that the margin
leaves so little apart that cells move more rows than blocks of the whole table,
the table is one cell.

Equal vectors are one class. Cells are cut into blocks, and pairs of blocks
are compared by one product each; a task reports per vector its number of
links and the smallest vector it is joined with inside the block pair, never
the pairs themselves, so a dense group costs rows in proportion to its size.

Cells grow with the data, to n ** 0.4 for each of one or more independent
clusterings, and crossing these gives the cells of very large tables.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import joined, partitions, sorted_groups
from shelfmark.llm.vectors import components, from_bytes, to_bytes
from shelfmark.operators.components import connected_components
from shelfmark.session import materialize

SAMPLE, MOST_CENTROIDS, BLOCK = 16_384, 1_024, 1_024


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that very large or small ones keep their direction."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def spherical_kmeans(rows: np.ndarray, count: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit ``rows``; an empty cell keeps its centroid."""
    rng = np.random.default_rng(seed)
    centroids = rows[rng.choice(len(rows), min(count, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        home = np.concatenate([
            (rows[s:s + 4096] @ centroids.T).argmax(axis=1) for s in range(0, len(rows), 4096)])
        order = np.argsort(home, kind="stable")
        cells, starts = np.unique(home[order], return_index=True)
        sums = np.add.reduceat(rows[order], starts, axis=0)
        norms = np.linalg.norm(sums, axis=1)
        centroids[cells[norms > 0]] = sums[norms > 0] / norms[norms > 0, None]
    return centroids


def _classes(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, key, vec): null dim for vectors that take no part."""

    def kernel(batches):
        for batch in batches:
            rows = [None if v is None or not v.any() else v
                    for v in components(batch.column(1))]
            data = [None if v is None else to_bytes(v) for v in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0),
                 pa.array([None if v is None else len(v) for v in rows], pa.int64()),
                 pa.array([None if d is None else xxhash.xxh128_digest(d) for d in data],
                          pa.binary()),
                 pa.array(data, pa.binary())], names=["vec_id", "dim", "key", "vec"])

    return vectors.mapInArrow(kernel, "vec_id long, dim long, key binary, vec binary")


def _gaps(centroids: np.ndarray) -> np.ndarray:
    return np.maximum(np.sqrt(np.maximum(2 - 2 * (centroids @ centroids.T), 0)), 1e-9)


def _margin(cosine: float, reach: float, dim: int) -> float:
    return math.sqrt(1 - cosine * cosine) * min(1.0, reach / math.sqrt(dim))


def _entered(rows: np.ndarray, centroids: np.ndarray, gaps: np.ndarray, margin: float):
    """(home cell of each row, which cells it is in or near)."""
    score = rows @ centroids.T
    best = score.argmax(axis=1)
    inside = (score[np.arange(len(rows)), best][:, None] - score) / gaps[best] <= margin
    inside[np.arange(len(rows)), best] = True
    return best, inside


def _place(classes: DataFrame, models: dict[int, list[np.ndarray]], cosine: float,
           reach: float) -> DataFrame:
    """(dim, cell, home, class_id, copies, vec): a row for the home cell and each cell nearby."""
    apart = {dim: [_gaps(c) for c in cs] for dim, cs in models.items()}

    def cells(rows: np.ndarray, dim: int):
        margin = _margin(cosine, reach, dim)
        home, near = np.zeros(len(rows), np.int64), [[0] for _ in range(len(rows))]
        for centroids, gaps in zip(models.get(dim, []), apart.get(dim, [])):
            best, inside = _entered(rows, centroids, gaps, margin)
            home = home * len(centroids) + best
            near = [[at * len(centroids) + c for at in ats for c in np.flatnonzero(ok).tolist()]
                    for ats, ok in zip(near, inside)]
        return home, near

    def kernel(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            dims = table.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = table.take(pa.array(np.flatnonzero(dims == dim)))
                for at in range(0, part.num_rows, 2048):
                    piece = part.slice(at, 2048)
                    home, near = cells(unit_rows(from_bytes(piece.column("vec"), dim)), dim)
                    lists = [[c for c in cs if c <= h] for h, cs in zip(home.tolist(), near)]
                    row = np.repeat(np.arange(len(home)), [len(c) for c in lists])
                    cell = np.concatenate([np.array(c, np.int64) for c in lists])
                    out = piece.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [out.column("dim").combine_chunks(), pa.array(cell),
                         pa.array(cell == home[row]), out.column("class_id").combine_chunks(),
                         out.column("copies").combine_chunks(),
                         out.column("vec").combine_chunks()],
                        names=["dim", "cell", "home", "class_id", "copies", "vec"])

    return classes.select("dim", "class_id", "copies", "vec").mapInArrow(
        kernel, "dim long, cell long, home boolean, class_id long, copies long, vec binary")


def _compare(placed: DataFrame, cosine: float) -> DataFrame:
    """(class_id, links, peer): links counted with copies, per pair of blocks."""
    sizes = placed.groupBy("dim", "cell").agg(
        F.ceil(F.count("*") / BLOCK).alias("blocks"), F.count_if("home").alias("homes")
    ).filter("homes > 0")
    rows = placed.join(sizes, ["dim", "cell"])
    own = F.pmod(F.xxhash64("class_id", F.lit(3)), F.col("blocks"))
    rows = rows.withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("dim", "cell", F.least("own", "other").alias("i"),
                       F.greatest("own", "other").alias("j"), "own", "home", "class_id",
                       "copies", "vec")
    keys = ["dim", "cell", "i", "j"]

    def kernel(batches):
        for group in sorted_groups(batches, keys):
            if group.num_rows < 2:
                continue
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            unit = unit_rows(from_bytes(group.column("vec"), group.column("dim")[0].as_py()))
            name, own, copies, home = (
                group.column(c).to_numpy() for c in ("class_id", "own", "copies", "home"))
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            linked = unit[left] @ unit[right].T >= cosine
            linked &= home[left][:, None] | home[right][None, :]
            if i == j:
                np.fill_diagonal(linked, False)
            rows_l, rows_r = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
            if not len(rows_l):
                continue
            left, right, linked = left[rows_l], right[rows_r], linked[np.ix_(rows_l, rows_r)]
            peer_l, peer_r = joined(name[left], name[right], linked)
            parts = [(name[left], linked @ copies[right], peer_l)]
            if i != j:
                parts.append((name[right], linked.T @ copies[left], peer_r))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts)],
                names=["class_id", "links", "peer"])

    return (
        rows.repartition(partitions(rows), *keys).sortWithinPartitions(*keys)
        .mapInArrow(kernel, "class_id long, links long, peer long")
    )


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding",
                 cosine: float = 0.95, reach: float = math.inf) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``.

    Links join vectors of a cosine of at least ``cosine``. Vectors that are
    null, empty or zero, or hold null or non-finite components, and rows with
    a null id, link with nothing; so do vectors of different length with each
    other. Rows of equal id count as vectors of their own in n_links. Other
    columns are ignored and an empty table gives no rows.
    """
    rows = materialize(_classes(vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(vec_col).cast("array<double>").alias("vec"))), "vectors")
    classes = materialize(
        rows.filter("key IS NOT NULL AND vec_id IS NOT NULL").groupBy("dim", "key")
        .agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies"),
             F.any_value("vec").alias("vec")), "classes")
    total = classes.count()
    models = _fit(classes, total, cosine, reach)
    placed = materialize(_place(classes, models, cosine, reach), "placed")
    found = materialize(_compare(placed, cosine), "found")
    comps = connected_components(
        found.filter("class_id <> peer").select(F.col("class_id").alias("src"),
                                                F.col("peer").alias("dst")))
    counts = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    facts = classes.select("dim", "key", "class_id", "copies").join(counts, "class_id", "left").join(
        comps, F.col("class_id") == F.col("node"), "left").select(
        "dim", "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "class_id").alias("component_id"))
    named = rows.select("vec_id", "dim", "key",
                        F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("own"))
    result = named.join(facts.withColumnRenamed("key", "own"), ["dim", "own"], "left")
    return result.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _worthwhile(unit: np.ndarray, layers: list[np.ndarray], margin: float, total: float) -> bool:
    """Whether cells move fewer rows than the blocks of one cell; judged on a sample."""
    unit = unit[:2048]
    copies = math.prod(
        _entered(unit, c, _gaps(c), margin)[1].sum() / len(unit) for c in layers)
    copies = (1 + copies) / 2  # only to lower-numbered cells
    held = total * copies / math.prod(map(len, layers))
    return copies * math.ceil(held / BLOCK) < math.ceil(total / BLOCK)


def _fit(classes: DataFrame, total: int, cosine: float,
         reach: float) -> dict[int, list[np.ndarray]]:
    """Centroids by vector length, from the SAMPLE classes first in hash order.

    Lengths the sample does not hold, and those whose cells would not pay, are
    one cell, cut into blocks like any other.
    """
    if not total:
        return {}
    wanted = total ** 0.4
    layers = 1 if wanted <= MOST_CENTROIDS else 2
    count = max(1, math.ceil(min(wanted ** (1 / layers), MOST_CENTROIDS)))
    sample = classes.orderBy(F.xxhash64("class_id")).limit(SAMPLE).select("dim", "vec").toArrow()
    dims = sample.column("dim").to_numpy()
    models = {}
    for dim in np.unique(dims).tolist():
        part = sample.filter(pa.array(dims == dim))
        unit = unit_rows(from_bytes(part.column("vec"), dim))
        models[dim] = [spherical_kmeans(unit, min(count, max(1, len(unit) // 8)), seed)
                       for seed in range(layers)]
        if not _worthwhile(unit, models[dim], _margin(cosine, reach, dim),
                           total * len(unit) / len(dims)):
            models[dim] = []
    return models
