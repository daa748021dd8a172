"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import materialize

MAX_ROUNDS = 64
HELD = 1 << 20  # edges that a task holds before it thins them


def star_forest(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lowest node, node) edges with the components of the given ones, one per node but the lowest."""
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    one, two = at[:len(src)], at[len(src):]
    low = np.arange(len(nodes))
    while True:
        least = np.minimum(low[one], low[two])
        new = low.copy()
        np.minimum.at(new, one, least)
        np.minimum.at(new, two, least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    moved = low != np.arange(len(nodes))
    return nodes[low[moved]], nodes[moved]


class HeldEdges:
    """Edges of one task, thinned to a forest whenever HELD of them have gathered."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, src: np.ndarray, dst: np.ndarray):
        """Takes edges; yields a forest that is too wide to be held on."""
        self.parts.append((src, dst))
        self.size += len(src)
        if self.size >= HELD:
            self._thin()
            if self.size >= HELD // 2:
                yield from self.rest()

    def rest(self):
        """Yields what is held, thinned."""
        if self.size:
            self._thin()
            yield self.parts[0]
        self.parts, self.size = [], 0

    def _thin(self) -> None:
        self.parts = [star_forest(*(np.concatenate(side) for side in zip(*self.parts)))]
        self.size = len(self.parts[0][0])


def thin_edges(edges: DataFrame) -> DataFrame:
    """Edges (src, dst: BIGINT) with the same components, few per node of a task.

    The edges of a task become the stars of their own components, so a dense
    neighbourhood leaves it as a tree. At most HELD edges are remembered.
    """

    def kernel(batches):
        held = HeldEdges()

        def out(forests):
            for src, dst in forests:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(src), pa.array(dst)], names=["src", "dst"])

        for batch in batches:
            yield from out(held.add(batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        yield from out(held.rest())

    return edges.select(
        F.col("src").cast("long"), F.col("dst").cast("long")
    ).filter("src IS NOT NULL AND dst IS NOT NULL").mapInArrow(kernel, "src long, dst long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge; component = lowest node.

    Each round links every node's larger neighbours to its lowest one, then
    every smaller neighbour likewise (Kiveris et al., 2014), which takes
    logarithmically many rounds. Only minima are aggregated, so a hub's
    neighbours are combined map-side and never gathered; the join back on a
    hub is split by the adaptive skew join. Every round is written to the
    checkpoint folder, and the loop ends when a round changes nothing. Beyond
    MAX_ROUNDS it raises; it never returns unsettled components.
    """
    high, low = F.greatest("src", "dst"), F.least("src", "dst")
    stars = materialize(
        edges.filter("src <> dst").select(high.alias("u"), low.alias("v")).distinct(),
        "edges",
    )
    state = _fingerprint(stars)
    for _ in range(MAX_ROUNDS):
        if state[0] == 0:
            break
        stars = materialize(_small_star(_large_star(stars)), "edges")
        now = _fingerprint(stars)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("component rounds did not settle")
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _fingerprint(stars: DataFrame) -> tuple:
    return tuple(stars.agg(
        F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))
    ).first())


def _large_star(stars: DataFrame) -> DataFrame:
    both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("_m")).select(
        "u", F.least("u", "_m").alias("_m")
    )
    return (
        both.join(lowest, "u").filter("v > u")
        .select(F.col("v").alias("u"), F.col("_m").alias("v"))
        .distinct()
    )


def _small_star(stars: DataFrame) -> DataFrame:
    lowest = stars.groupBy("u").agg(F.min("v").alias("_m"))
    moved = (
        stars.join(lowest, "u").filter("v <> _m")
        .select(F.col("v").alias("u"), F.col("_m").alias("v"))
    )
    return moved.unionByName(lowest.select("u", F.col("_m").alias("v"))).distinct()
