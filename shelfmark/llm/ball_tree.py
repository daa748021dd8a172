"""Exact top-k by inner product: a ball tree per shard, with the kth score shared.

Candidates are dealt into shards of bounded size. Every query first meets its
own shard, which gives it k results and a kth score; with that score it meets
all other shards, in blocks of queries. Inside a shard a ball tree is built
(split in halves along the line between two far points) and a query visits the
leaves in order of the upper bound q.c + |q| r; nodes whose bound is below the
current kth score are never opened, nor anything beneath them.

Scores are whole numbers. Products run in double precision as long as every
possible sum stays below 2**53, else in Python's integers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import matrix, partitions, sorted_groups
from shelfmark.llm.vectors import components
from shelfmark.session import materialize

SHARD, QUERIES, LEAF = 4_096, 1_024, 64
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


class BallTree:
    """Nodes of a shard in depth-first order; children follow their parent."""

    def __init__(self, rows: np.ndarray):
        self.order = np.arange(len(rows))
        self.spans: list[tuple[int, int]] = []
        self.parents: list[int] = []
        self.leaf: list[bool] = []
        centers, radii = [], []
        stack = [(0, len(rows), -1)]
        while stack:
            start, stop, parent = stack.pop()
            own = rows[self.order[start:stop]]
            center = own.mean(axis=0)
            away = np.sqrt(((own - center) ** 2).sum(axis=1))
            number = len(self.spans)
            self.spans.append((start, stop))
            self.parents.append(parent)
            centers.append(center)
            radii.append(away.max(initial=0.0))
            self.leaf.append(stop - start <= LEAF or radii[-1] == 0)
            if not self.leaf[-1]:
                far = own[away.argmax()]
                other = own[((own - far) ** 2).sum(axis=1).argmax()]
                half = (stop - start) // 2
                ranks = np.argpartition(own @ (other - far), half)
                self.order[start:stop] = self.order[start:stop][ranks]
                stack += [(start + half, stop, number), (start, start + half, number)]
        self.centers, self.radii = np.array(centers), np.array(radii)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No row of node j scores higher than [i, j] for query i (with room for rounding)."""
        spread = np.linalg.norm(queries, axis=1)[:, None] * self.radii[None, :]
        best = queries @ self.centers.T + spread
        room = np.linalg.norm(queries, axis=1)[:, None] * (
            np.linalg.norm(self.centers, axis=1) + self.radii)[None, :]
        return best + 1e-9 * room + 1e-6


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0))
    if top * queries.shape[1] < 2.0 ** 53:
        return (queries.astype(float) @ rows.astype(float).T).astype(np.int64)
    exact = queries.astype(object) @ rows.astype(object).T
    return np.clip(exact, LOWEST, HIGHEST).astype(np.int64)


def search_shard(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray,
                 floor: np.ndarray, k: int):
    """(query position, id, score) of rows that may be among a query's ``k`` best.

    ``floor`` is a score that k rows elsewhere reach; rows below it are left
    out. Ties go to the smaller id, and a query is never its own result.
    """
    tree = BallTree(rows.astype(float))
    bound = tree.bounds(queries.astype(float))
    best_s = np.full((len(queries), k), LOWEST, np.int64)
    best_i = np.full((len(queries), k), HIGHEST, np.int64)
    kth = floor.copy()
    alive = bound >= kth[:, None]
    for node, parent in enumerate(tree.parents):  # a closed node closes its children
        if parent >= 0:
            alive[:, node] &= alive[:, parent]
    leaves = np.flatnonzero(tree.leaf)
    ahead = np.argsort(-bound[:, leaves], axis=1, kind="stable")
    for step in range(len(leaves)):
        node = leaves[ahead[:, step]]
        at = np.arange(len(queries))
        open_ = at[alive[at, node] & (bound[at, node] >= kth)]
        if not len(open_):
            if not (bound[at, node] >= kth).any():
                break
            continue
        for leaf in np.unique(node[open_]).tolist():
            mine = open_[node[open_] == leaf]
            start, stop = tree.spans[leaf]
            members = tree.order[start:stop]
            scores = _products(queries[mine], rows[members])
            names = np.broadcast_to(ids[members], scores.shape)
            usable = (scores >= kth[mine][:, None]) & (names != query_ids[mine][:, None])
            hit = usable.any(axis=1)
            if not hit.any():
                continue
            mine = mine[hit]
            scores = np.where(usable[hit], scores[hit], LOWEST)
            names = np.where(usable[hit], names[hit], HIGHEST)
            all_s = np.concatenate([best_s[mine], scores], axis=1)
            all_i = np.concatenate([best_i[mine], names], axis=1)
            first = np.lexsort((all_i, ~all_s), axis=1)[:, :k]
            best_s[mine] = np.take_along_axis(all_s, first, axis=1)
            best_i[mine] = np.take_along_axis(all_i, first, axis=1)
            full = best_i[mine, k - 1] != HIGHEST
            kth[mine] = np.where(full, np.maximum(kth[mine], best_s[mine, k - 1]), kth[mine])
    query, place = np.nonzero(best_i != HIGHEST)
    return query, best_i[query, place], best_s[query, place]


def quantized(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, dim, vec) with floor(scale * x) as 64-bit integers; unusable vectors are left out."""

    def kernel(batches):
        for batch in batches:
            rows = [None if v is None else np.clip(np.floor(v * float(scale)), -2.0 ** 62, 2.0 ** 62)
                    for v in components(batch.column(1))]
            kept = [i for i, v in enumerate(rows) if v is not None]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept, pa.int64())),
                 pa.array([len(rows[i]) for i in kept], pa.int64()),
                 pa.array([rows[i].astype("<i8").tobytes() for i in kept], pa.binary())],
                names=["vec_id", "dim", "vec"])

    return vectors.mapInArrow(kernel, "vec_id long, dim long, vec binary")


def _search(dealt: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(query_id, vec_id, score) inside each group of candidate and query rows."""

    def kernel(batches):
        for group in sorted_groups(batches, keys):
            asks = group.column("asks").to_numpy()
            ids, floor = group.column("vec_id").to_numpy(), group.column("floor").to_numpy()
            rows = matrix(group.column("vec"), "<i8")
            ask, give = np.flatnonzero(asks), np.flatnonzero(~asks)
            if len(ask) and len(give):
                query, found, score = search_shard(
                    rows[give], ids[give], rows[ask], ids[ask], floor[ask], k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[ask][query]), pa.array(found), pa.array(score)],
                    names=["query_id", "vec_id", "score"])

    return (
        dealt.repartition(partitions(dealt), *keys).sortWithinPartitions(*keys)
        .mapInArrow(kernel, "query_id long, vec_id long, score long")
    )


def top_k(vectors: DataFrame, *, k: int = 20, scale: int = 64, every: int = 20,
          id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD,
          query_rows: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of all other rows for each query.

    Queries are the rows whose id is divisible by ``every``; equal scores go to
    the smaller id. Null vectors, empty ones, those with null or non-finite
    components and rows with a null id take no part, and vectors of different
    length do not meet. Rows that share an id are candidates of their own and
    one query. Components are clipped to 2**62 and scores to 64 bits. Other
    columns are ignored; an empty table gives no rows.
    """
    rows = materialize(quantized(
        vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                       F.col(vec_col).cast("array<double>").alias("vec"))
        .filter("vec_id IS NOT NULL"), scale), "quantized")
    total = max(1, rows.count())
    shards = math.ceil(total / shard_rows)
    blocks = math.ceil(total / every / query_rows)
    shard = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(shards))
    block = F.pmod(F.xxhash64("vec_id", F.lit(12)), F.lit(blocks))
    lowest = F.lit(LOWEST).cast("long")
    give = rows.select("dim", shard.alias("shard"), F.lit(False).alias("asks"), "vec_id", "vec",
                       lowest.alias("floor"))
    asking = rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    ask = asking.select("dim", shard.alias("shard"), F.lit(True).alias("asks"), "vec_id", "vec",
                        lowest.alias("floor"))
    near = materialize(_search(give.unionByName(ask), ["dim", "shard"], k), "near")
    if shards == 1:
        found = near
    else:
        kth = near.groupBy("query_id").agg(
            F.count("*").alias("n"), F.min("score").alias("least"))
        known = asking.join(kth, F.col("vec_id") == F.col("query_id"), "left").select(
            "dim", "vec_id", "vec", shard.alias("own"), block.alias("block"),
            F.when(F.col("n") >= k, F.col("least")).otherwise(lowest).alias("floor"))
        # Each block of queries against each shard but the one already seen.
        ask = known.select(
            "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
            "block", F.lit(True).alias("asks"), "vec_id", "vec", "floor", "own"
        ).filter("shard <> own").drop("own")
        give = give.select(
            "dim", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1)
                                                  .cast("long"))).alias("block"), "asks", "vec_id", "vec", "floor")
        far = _search(give.unionByName(ask), ["dim", "shard", "block"], k)
        found = near.unionByName(far)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
