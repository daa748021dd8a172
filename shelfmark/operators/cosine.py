"""Exact cosine self-join, and density clustering on top of it.

Vectors are laid out as a tree of three levels: cells around pivots, chunks of
a cell that fit a task, and blocks that a task cuts from its chunk by halving
it between far points. Every level has a centre and the greatest angle to it
(a cap), and each vector is stored once, in its block. Two caps whose centres
lie further apart than both radii and the threshold's angle hold no pair, so
cells rule out cells, chunks then rule out blocks, and only the blocks that are
left are brought together, one row each. They meet as a product of partitions,
which are read again for each other and never shuffled. This is exact at every
size; where the geometry allows no pruning it becomes plain block-by-block
comparison. Equal vectors are compared once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.components import HeldEdges, connected_components, thin_edges
from shelfmark.session import materialize, spread

BLOCK = 1_024  # vectors in a block
WIDE_BLOCK = 4_096  # the same where there are many: a block is handed over once for every other
BLOCK_BYTES = 1 << 21  # of a block beyond BLOCK vectors
CHUNK_BLOCKS = 32  # blocks that a task cuts from one chunk
CHUNK_ROWS = 32_768  # vectors of a chunk at most
STRIP = 1 << 18  # cosines of two blocks that are held at a time
HITS = 1 << 20  # pairs that are handed on at a time
TILE = 64  # blocks of BLOCK vectors in a partition of the product; a task meets two partitions
PIVOTS = 1_024  # the first level is that wide at most; the levels below it grow with the data

COSINE = 0.92
EPS = 0.45
MIN_SAMPLES = 3

_SLACK = 1e-6  # of angles, far above their rounding


def _unit_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(column), -1)
    length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.where(length == 0, 1.0, length)


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with a 128-bit key (_k1, _k2) of ``vec``, so that no vector is a shuffle key."""
    return rows.withColumns({"_k1": F.xxhash64("vec"), "_k2": F.xxhash64(F.lit(1), "vec")})


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(id, vec, copies, _k1, _k2): one row per distinct vector, its lowest id and count."""
    return keyed(rows).groupBy("_k1", "_k2").agg(
        F.min("id").alias("id"), F.any_value("vec").alias("vec"), F.count("*").alias("copies")
    ).select("id", "vec", "copies", "_k1", "_k2")


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _cap(unit: np.ndarray) -> tuple[np.ndarray, float]:
    """A centre of the rows and the greatest angle to it."""
    middle = unit.sum(axis=0)
    length = np.sqrt((middle * middle).sum())
    centre = middle / length if length > 0 else unit[0]
    return centre, float(_angles(unit @ centre).max())


def cut_blocks(unit: np.ndarray, block: int) -> list[np.ndarray]:
    """Row numbers of blocks of at most ``block`` rows, parted between far points."""
    done, stack = [], [np.arange(len(unit))]
    while stack:
        rows = stack.pop()
        if len(rows) <= block:
            done.append(rows)
            continue
        own = unit[rows]
        one = own[(own @ own[0]).argmin()]
        other = own[(own @ one).argmin()]
        lean = own @ (other - one)
        nearer = lean > 0
        if min(nearer.sum(), len(rows) - nearer.sum()) < len(rows) // 8:
            nearer = np.zeros(len(rows), bool)  # too uneven: half of them
            nearer[np.argpartition(lean, len(rows) // 2)[len(rows) // 2:]] = True
        stack += [rows[nearer], rows[~nearer]]
    return done


def _pivots(vectors: DataFrame, cells: int) -> np.ndarray:
    picked = vectors.orderBy(F.xxhash64("id"), "id").limit(cells).select("vec").collect()
    raw = np.array([row["vec"] for row in picked], dtype=np.float64).reshape(len(picked), -1)
    length = np.sqrt((raw * raw).sum(axis=1, keepdims=True))
    return raw / np.where(length == 0, 1.0, length)


def _layout(vectors: DataFrame, cells: int, block: int) -> tuple[DataFrame, np.ndarray]:
    """(blocks, pivots): one row per block (cell, chunk, block, centre, radius, away, its vectors).

    ``away`` is the greatest angle of its vectors to the cell's pivot.
    """
    pivots = _pivots(vectors, cells)

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            near = _unit_rows(batch.column("vec")) @ pivots.T
            best = near.argmax(axis=1)
            away = _angles(near[np.arange(len(best)), best])
            yield pa.RecordBatch.from_arrays(
                [pa.array(best), pa.array(away), *batch.columns],
                names=["cell", "away", "id", "vec", "copies"])

    kind = dict(vectors.dtypes)["vec"]
    placed = materialize(
        vectors.select(F.col("id").cast("long"), "vec", F.col("copies").cast("long"))
        .mapInArrow(assign, f"cell long, away double, id long, vec {kind}, copies long"), "cells")
    sizes = placed.groupBy("cell").agg(
        F.ceil(F.count("*") / min(block * CHUNK_BLOCKS, max(block, CHUNK_ROWS))).alias("_chunks"))
    dealt = placed.join(sizes, "cell").withColumn(
        "chunk", F.pmod(F.xxhash64("id"), F.col("_chunks"))).drop("_chunks")

    def pack(table: pa.Table) -> pa.Table:
        unit, away = _unit_rows(table.column("vec")), table.column("away").to_numpy()
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        cell, chunk = table.column("cell")[0].as_py(), table.column("chunk")[0].as_py()
        rows = []
        for i, own in enumerate(cut_blocks(unit, block)):
            centre, radius = _cap(unit[own])
            rows.append({
                "cell": cell, "chunk": chunk, "block": (cell << 48) + (chunk << 16) + i,
                "centre": centre.tobytes(), "radius": radius, "away": float(away[own].max()),
                "ids": ids[own].astype("<i8").tobytes(),
                "copies": copies[own].astype("<i8").tobytes(), "unit": unit[own].tobytes()})
        return pa.Table.from_pylist(rows, schema=layout)

    layout = pa.schema([("cell", pa.int64()), ("chunk", pa.int64()), ("block", pa.int64()),
                        ("centre", pa.binary()), ("radius", pa.float64()), ("away", pa.float64()),
                        ("ids", pa.binary()), ("copies", pa.binary()), ("unit", pa.binary())])
    # A chunk is some CHUNK_BLOCKS blocks, whatever a cell's share of all vectors.
    blocks = spread(dealt, "cell", "chunk").groupBy("cell", "chunk").applyInArrow(
        pack, "cell long, chunk long, block long, centre binary, radius double, away double, "
              "ids binary, copies binary, unit binary")
    return materialize(blocks, "blocks"), pivots


def near_blocks(blocks: DataFrame, pivots: np.ndarray, threshold: float) -> DataFrame:
    """(a, b): the pairs of blocks, a <= b, that may hold a pair at the threshold.

    Cells are compared by their caps first (at most PIVOTS of them, on the
    driver), then the blocks of two chunks at once.
    """
    reach = math.acos(max(-1.0, min(1.0, threshold))) + _SLACK
    spark = blocks.sparkSession
    radius = np.full(len(pivots), -np.inf)
    for row in blocks.groupBy("cell").agg(F.max("away").alias("away")).collect():
        radius[row["cell"]] = row["away"]
    apart = _angles(pivots @ pivots.T) if len(pivots) else np.zeros((0, 0))
    one, two = np.nonzero(np.triu(apart <= radius[:, None] + radius[None, :] + reach))
    pairs = spark.createDataFrame(
        pa.table({"cell_a": pa.array(one, pa.int64()), "cell_b": pa.array(two, pa.int64())}))
    chunks = blocks.groupBy("cell", "chunk").agg(F.collect_list(
        F.struct("block", "radius", "centre")).alias("caps"))

    def side(name: str) -> DataFrame:
        return chunks.select(*(F.col(c).alias(f"{c}_{name}") for c in ("cell", "chunk", "caps")))

    met = pairs.join(side("a"), "cell_a").join(side("b"), "cell_b").filter(
        "cell_a < cell_b OR chunk_a <= chunk_b")

    def caps(scalar):
        rows = scalar.as_py()
        return (np.array([r["block"] for r in rows]), np.array([r["radius"] for r in rows]),
                np.array([np.frombuffer(r["centre"]) for r in rows]))

    def kernel(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                (a, ra, ca), (b, rb, cb) = (caps(batch.column(c)[i]) for c in ("caps_a", "caps_b"))
                near = _angles(ca @ cb.T) <= ra[:, None] + rb[None, :] + reach
                at, to = np.nonzero(near)
                keep = np.full(len(at), True) if (a[0] >> 16) != (b[0] >> 16) else a[at] <= b[to]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[at][keep]), pa.array(b[to][keep])], names=["a", "b"])

    return met.select("caps_a", "caps_b").mapInArrow(kernel, "a long, b long")


class _Vectors:
    def __init__(self, batch: pa.RecordBatch, i: int, side: str):
        def array(name: str, kind) -> np.ndarray:
            return np.frombuffer(batch.column(f"{name}_{side}")[i].as_buffer(), kind)

        self.block = batch.column(side)[i].as_py()
        self.ids, self.copies = array("ids", "<i8"), array("copies", "<i8")
        self.unit = array("unit", "<f8").reshape(len(self.ids), -1)
        self.core = array("core", bool) if f"core_{side}" in batch.schema.names else None


def near_vectors(left: np.ndarray, right: np.ndarray, threshold: float, same: bool = False):
    """Chunks (at, to, cosines) of the pairs of unit rows at or above the threshold.

    Short floats leave out what their rounding can't bring up to the threshold;
    what is left is computed in doubles. ``same`` rows meet once, and not themselves.
    """
    dim = left.shape[1]
    least = threshold - (dim + 4) * 2.0 ** -22  # over four times the rounding of a short product
    one, two = left.astype(np.float32), np.ascontiguousarray(right.astype(np.float32).T)
    rows = max(1, STRIP // len(right))
    held, size = [], 0
    for start in range(0, len(left), rows):
        skip = start if same else 0  # earlier rows have met these
        spots = np.flatnonzero(one[start:start + rows] @ two[:, skip:] >= least)
        at, to = np.divmod(spots, len(right) - skip)
        at, to = at + start, to + skip
        if same:
            later = at < to
            at, to = at[later], to[later]
        if len(at) * 8 > STRIP:  # so many that they cost more one by one
            cosines = (left[start:start + rows] @ right.T)[at - start, to]
        else:
            cosines = np.einsum("ij,ij->i", left[at], right[to])
        near = cosines >= threshold
        held.append((at[near], to[near], cosines[near]))
        size += len(held[-1][0])
        if size >= HITS:
            yield tuple(map(np.concatenate, zip(*held)))
            held, size = [], 0
    if size:
        yield tuple(map(np.concatenate, zip(*held)))


def _block_rows(vectors: DataFrame, n: int) -> int:
    """BLOCK, or more where that leaves every worker some pairs of blocks and a block small."""
    first = vectors.select(F.size("vec")).first()
    workers = vectors.sparkSession.sparkContext.defaultParallelism
    wide = min(WIDE_BLOCK, BLOCK_BYTES // (8 * max(1, first[0] if first else 1)))
    return max(BLOCK, min(wide, n // (4 * workers)))


class Layout:
    """Blocks of a table of distinct vectors and the pairs of blocks that have to be compared."""

    def __init__(self, vectors: DataFrame, threshold: float, cells: int | None = None,
                 block: int | None = None):
        if threshold > 0:  # vectors without a direction are near to nothing
            vectors = vectors.filter(F.exists("vec", lambda x: x != 0))
        if cells is None or block is None:
            n = vectors.count()
            block = _block_rows(vectors, n) if block is None else block
            cells = min(PIVOTS, math.ceil(n / block)) if cells is None else cells
        self.threshold = threshold
        self.tile = max(1, TILE * BLOCK // max(BLOCK, block))  # wider ones, so many the fewer
        blocks, pivots = _layout(vectors, cells, block)
        self.pairs = materialize(near_blocks(blocks, pivots, threshold), "pairs")
        # Every block with the blocks it has to meet: as many as there are at most.
        near = self.pairs.groupBy(F.col("a").alias("block")).agg(F.collect_list("b").alias("near"))
        self.blocks = materialize(blocks.join(near, "block"), "near")

    def compared(self) -> tuple[int, int]:
        """(pairs of blocks that are compared, all there are)."""
        n = self.blocks.count()
        return self.pairs.count(), n * (n + 1) // 2

    def meet(self, kernel, schema: str, extra: DataFrame | None = None, last=None) -> DataFrame:
        """``kernel(left, right, at, to, cosines)`` over the pairs at or above the threshold.

        A task meets two partitions of ``tile`` blocks, one row a block. ``extra``
        adds a column ``core`` by block; ``last()`` gives a task's last batches.
        """
        blocks, columns = self.blocks, ["ids", "copies", "unit"]
        if extra is not None:
            blocks, columns = materialize(blocks.join(extra, "block"), "cores"), [*columns, "core"]
        workers = blocks.sparkSession.sparkContext.defaultParallelism
        tiles = max(math.ceil(blocks.count() / self.tile), math.ceil(math.sqrt(4 * workers)))

        def side(name: str, *more: str) -> DataFrame:
            return blocks.select(F.col("block").alias(name), *more,
                                 *(F.col(c).alias(f"{c}_{name}") for c in columns)).coalesce(tiles)

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    left, right = _Vectors(batch, i, "a"), _Vectors(batch, i, "b")
                    for found in near_vectors(left.unit, right.unit, threshold,
                                              left.block == right.block):
                        yield from kernel(left, right, *found)
            if last is not None:
                yield from last()

        threshold = self.threshold
        met = side("a", "near").join(
            side("b").hint("shuffle_replicate_nl"), F.array_contains("near", F.col("b")))
        return met.drop("near").mapInArrow(run, schema)


def cosine_pairs(
    rows: DataFrame, threshold: float = COSINE, cells: int | None = None, block: int | None = None,
) -> DataFrame:
    """(src, dst, sim) for every pair of distinct vectors at or above ``threshold``.

    ``rows`` is (id: BIGINT, vec), ids of distinct vectors; ``src < dst``.
    """
    def kernel(left, right, at, to, cosines):
        one, two = left.ids[at], right.ids[to]
        yield pa.RecordBatch.from_pydict({
            "src": np.minimum(one, two), "dst": np.maximum(one, two), "sim": cosines})

    vectors = rows.select("id", "vec", F.lit(1).alias("copies"))
    return Layout(vectors, threshold, cells, block).meet(kernel, "src long, dst long, sim double")


def cosine_edges(
    rows: DataFrame, threshold: float = COSINE, cells: int | None = None, block: int | None = None,
) -> DataFrame:
    """(src, dst) edges with the components of "cosine at least ``threshold``".

    Equal vectors form a star; each task passes on a spanning forest.
    """
    lone = materialize(distinct_vectors(rows), "vectors")
    stars = (
        keyed(rows).drop("vec").join(
            lone.select("_k1", "_k2", F.col("id").alias("lead")), ["_k1", "_k2"])
        .filter("id <> lead").select(F.col("lead").alias("src"), F.col("id").alias("dst"))
    )
    pairs = cosine_pairs(lone.select("id", "vec"), threshold, cells, block)
    return stars.unionByName(thin_edges(pairs.select("src", "dst")))


def neighbour_counts(layout: Layout, vectors: DataFrame) -> DataFrame:
    """(id, neighbours): rows within the threshold, itself and copies included."""
    def kernel(left, right, at, to, cosines):
        for mine, other, one, two in ((left, right, at, to), (right, left, to, at)):
            total = np.bincount(one, weights=other.copies[two].astype(float),
                                minlength=len(mine.ids)).astype(np.int64)
            seen = total > 0
            yield pa.RecordBatch.from_pydict({"id": mine.ids[seen], "n": total[seen]})

    own = vectors.select("id", F.col("copies").cast("long").alias("n"))
    return layout.meet(kernel, "id long, n long").unionByName(own).groupBy("id").agg(
        F.sum("n").alias("neighbours"))


def _core_bits(layout: Layout, cores: DataFrame) -> DataFrame:
    """(block, core): which of a block's vectors are core, a byte each in their order."""
    def members(batches):
        for batch in batches:
            for block, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(ids, "<i8")
                yield pa.RecordBatch.from_pydict({
                    "block": np.full(len(own), block), "at": np.arange(len(own)), "id": own})

    spots = layout.blocks.select("block", "ids").mapInArrow(
        members, "block long, at long, id long")
    bit = F.when(F.col("core"), F.lit(b"\1")).otherwise(F.lit(b"\0"))
    listed = spots.join(cores, "id").groupBy("block").agg(  # as many as a block holds
        F.array_sort(F.collect_list(F.struct("at", bit.alias("bit")))).alias("_bits"))
    return listed.select("block", F.aggregate(
        "_bits", F.lit(b""), lambda all_, one: F.concat(all_, one["bit"])).alias("core"))


def _density_links(layout: Layout, cores: DataFrame) -> DataFrame:
    """(src, dst, border): core-core links, thinned later, and border-core pairs.

    A border row has fewer than min_samples neighbours, so its pairs are few.
    """
    held = HeldEdges()  # each task has its own copy

    def out(src, dst, border: bool):
        return pa.RecordBatch.from_pydict(
            {"src": src, "dst": dst, "border": np.full(len(src), border)})

    def kernel(left, right, at, to, cosines):
        one, two = left.ids[at], right.ids[to]
        core_a, core_b = left.core[at], right.core[to]
        both = np.flatnonzero(core_a & core_b)
        for forest in held.add(one[both], two[both]):
            yield out(*forest, False)
        edge = np.flatnonzero(core_a != core_b)
        outer = np.where(core_a[edge], two[edge], one[edge])
        inner = np.where(core_a[edge], one[edge], two[edge])
        yield out(outer, inner, True)

    def last():
        for forest in held.rest():
            yield out(*forest, False)

    return layout.meet(
        kernel, "src long, dst long, border boolean", _core_bits(layout, cores), last)


def density_clusters(
    rows: DataFrame, eps: float = EPS, min_samples: int = MIN_SAMPLES,
    cells: int | None = None, block: int | None = None,
) -> DataFrame:
    """(id, cluster): density clusters over cosine distance, NULL for noise.

    A row with at least ``min_samples`` rows within ``eps`` (itself included)
    is core; linked cores share a cluster, named by its lowest core id; a
    border row joins the reachable cluster with the lowest name.
    """
    threshold = 1.0 - eps
    vectors = materialize(distinct_vectors(rows), "vectors")
    layout = Layout(vectors, threshold, cells, block)
    cores = materialize(
        neighbour_counts(layout, vectors)
        .select("id", (F.col("neighbours") >= min_samples).alias("core")),
        "cores",
    )
    links = materialize(_density_links(layout, cores), "links")
    joined = connected_components(
        thin_edges(links.filter(~F.col("border")).select("src", "dst"))
    )
    core_label = (
        cores.filter("core").select("id")
        .join(joined.select(F.col("node").alias("id"), "component"), "id", "left")
        .select("id", F.coalesce("component", "id").alias("cluster"))
    )
    border = (
        links.filter("border")
        .join(core_label.select(F.col("id").alias("dst"), "cluster"), "dst")
        .groupBy(F.col("src").alias("id")).agg(F.min("cluster").alias("cluster"))
    )
    labels = core_label.unionByName(border)
    named = vectors.select(F.col("id").alias("lead"), "_k1", "_k2").join(
        labels.select(F.col("id").alias("lead"), "cluster"), "lead", "left")
    return keyed(rows.select("id", "vec")).drop("vec").join(
        named, ["_k1", "_k2"]).select("id", "cluster")
