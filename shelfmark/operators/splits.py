"""Two vector indexes as splits of packed rows, met by blocks of packed requests.

A stored index holds each path's image and caption vector side by side, some
thousand rows to a split, one row per split. Requests are packed the same way,
a block to a row. Scoring is the product of splits and blocks: Spark deals the
splits over the tasks and brings the blocks to them (by broadcast where they
are small, block of partitions by block of partitions otherwise), so neither
vectors nor requests pass the driver and the vectors are never shuffled. A
task reads a split once for all requests of a block.

Who may see what is a set of marks, (place in the split, slot in the block),
joined to the splits by their number. The splits are stored in buckets of that
number, so this join moves marks only.

Scores are summed dimension by dimension in double: equal vectors score equal
bits in any split, and ties are settled by path.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import checkpoint_root, materialize

SPLIT_ROWS, SPLIT_BYTES = 2_048, 4 << 20  # the smaller of the two ends a split
BLOCK = 128  # requests in a block, about
GROUPS = 8  # target lists of a block that are counted apart
TARGETS = 4_096  # targets in a list, about
PLACE = 1 << 16  # a mark is place * PLACE + slot
SIDES = ("image", "caption")


@dataclass(frozen=True)
class StoredIndex:
    """``splits`` (one row each) and ``places`` (path, split, at, has_image, has_caption)."""

    splits: DataFrame
    places: DataFrame


def _bucketed(df: DataFrame, label: str, key: str) -> DataFrame:
    """``df`` written in buckets of ``key`` in the checkpoint folder.

    The catalog entry only carries the layout to the reader and goes again;
    the files stay.
    """
    spark = df.sparkSession
    name = f"shelfmark_{label}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).format("parquet").option(
        "path", f"{checkpoint_root(spark)}/shelfmark/{name}").saveAsTable(name)
    stored = spark.table(name)
    stored.schema  # resolved before the entry goes
    spark.sql(f"DROP TABLE {name}")
    return stored


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(which rows have a vector, dimension-major values, bytes a value); missing ones are zero."""
    has = column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.drop_null().flatten()
    width = 4 if pa.types.is_float32(column.type.value_type) else 8
    values = flat.to_numpy(zero_copy_only=False).astype(f"<f{width}")
    dim = len(values) // max(1, int(has.sum()))
    whole = np.zeros((dim, len(has)), f"<f{width}")
    if dim:
        whole[:, has] = values.reshape(-1, dim).T
    return has, whole, width


def store_index(image: DataFrame, caption: DataFrame) -> StoredIndex:
    """Pack (path, vec) tables into splits. A path may lack either vector."""

    def kernel(batches):
        count = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = [_vectors(batch.column(i)) for i in (1, 2)]
            a_row = sum(whole.shape[0] * width for _, whole, width in sides)
            size = max(1, min(SPLIT_ROWS, SPLIT_BYTES // max(1, a_row)))
            for at in range(0, batch.num_rows, size):
                row = {"split": count, "paths": batch.column(0)[at:at + size].to_pylist()}
                count += 1
                for side, (has, whole, width) in zip(SIDES, sides):
                    row |= {f"has_{side}": has[at:at + size].tobytes(),
                            side: whole[:, at:at + size].tobytes(), f"{side}_width": width}
                yield pa.RecordBatch.from_pylist([row], schema=layout)

    layout = pa.schema([
        ("split", pa.int64()), ("paths", pa.list_(pa.string())),
        *((f"{p}{side}{s}", kind) for side in SIDES for p, s, kind in (
            ("has_", "", pa.binary()), ("", "", pa.binary()), ("", "_width", pa.int32())))])
    rows = image.filter("vec IS NOT NULL").select("path", F.col("vec").alias("image")).join(
        caption.filter("vec IS NOT NULL").select("path", F.col("vec").alias("caption")),
        "path", "full_outer")
    splits = _bucketed(rows.select("path", "image", "caption").mapInArrow(
        kernel, "split long, paths array<string>, has_image binary, image binary, "
                "image_width int, has_caption binary, caption binary, caption_width int"),
        "splits", "split")
    places = splits.select("split", F.posexplode("paths").alias("at", "path"),
                           "has_image", "has_caption").select(
        "path", "split", "at",
        *((F.substring(F.col(f"has_{s}"), F.col("at") + 1, F.lit(1)) == F.lit(b"\1")).alias(
            f"has_{s}") for s in SIDES))
    return StoredIndex(splits, places)


# -- requests and marks ---------------------------------------------------------

def request_blocks(requests: DataFrame, total: int) -> DataFrame:
    """(block, asked): requests packed by a hash of their id, about BLOCK to a row.

    ``requests`` is (query_id, image_query, caption_query, has_filter, depth).
    A request's slot is its place in ``asked``.
    """
    blocks = max(1, -(-total // BLOCK))
    return materialize(
        requests.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).agg(
            F.array_sort(F.collect_list(F.struct(
                "query_id", "image_query", "caption_query", "has_filter", "depth")))
            .alias("asked")), "blocks")


def request_slots(blocks: DataFrame) -> DataFrame:
    """(query_id, block, slot, image_query, caption_query, has_filter) of every request."""
    return blocks.select("block", F.posexplode("asked").alias("slot", "_a")).select(
        "block", "slot", *(F.col(f"_a.{c}").alias(c) for c in (
            "query_id", "image_query", "caption_query", "has_filter")))


def pair_marks(pairs: DataFrame, index: StoredIndex, blocks: DataFrame) -> DataFrame:
    """(split, marks): for each block of requests, which rows of the split are paired with which.

    ``pairs`` is (query_id, path). The rows of a split times the requests of a
    block bound a list of marks.
    """
    slots = request_slots(blocks).select("query_id", "block", "slot")
    mark = (F.col("at") * PLACE + F.col("slot")).alias("mark")
    return (
        pairs.select("query_id", "path").join(slots, "query_id")
        .join(index.places.select("path", "split", "at"), "path")
        .select("split", "block", mark)
        .groupBy("split", "block").agg(F.collect_list("mark").alias("marks"))
        .groupBy("split").agg(F.collect_list(F.struct("block", "marks")).alias("marked"))
    )


def _met(index: StoredIndex, blocks: DataFrame, marks: DataFrame | None) -> DataFrame:
    """Splits x blocks with the marks of each pair (null where there are none)."""
    splits = index.splits
    none = F.lit(None).cast("array<int>")
    if marks is None:
        return splits.crossJoin(blocks).withColumn("marks", none)
    # Marks are narrow and sent to the splits' buckets; sorting splits is spared.
    marked = splits.join(marks.hint("SHUFFLE_HASH"), "split", "left")
    own = F.filter("marked", lambda m: m["block"] == F.col("block"))
    return marked.crossJoin(blocks).withColumn(
        "marks", F.when(F.size(own) > 0, own[0]["marks"]).otherwise(none)).drop("marked")


# -- kernels ----------------------------------------------------------------------

class _Split:
    def __init__(self, batch: pa.RecordBatch, i: int):
        def value(name):
            return batch.column(name)[i].as_py()

        self.paths = batch.column("paths")[i].values
        self.n = len(self.paths)
        self.has, self.by_dim = {}, {}
        for side in SIDES:
            self.has[side] = np.frombuffer(value(f"has_{side}"), bool)
            flat = np.frombuffer(value(side), f"<f{value(f'{side}_width')}")
            self.by_dim[side] = flat.reshape(-1, self.n).astype(np.float64)


class _Asked:
    """The requests of one block."""

    def __init__(self, asked: list[dict]):
        self.ids = pa.array([a["query_id"] for a in asked], pa.string())
        self.filtered = np.array([bool(a["has_filter"]) for a in asked])
        self.slots = [a.get("slot", i) for i, a in enumerate(asked)]
        self.depth = [a.get("depth") or 0 for a in asked]
        self.has, self.queries = {}, {}
        for side in SIDES:
            vectors = [a[f"{side}_query"] for a in asked]
            self.has[side] = np.array([v is not None for v in vectors])
            dim = max((len(v) for v in vectors if v is not None), default=0)
            self.queries[side] = np.array(
                [v if v is not None else [0.0] * dim for v in vectors], np.float64)

    def scores(self, split: _Split, side: str) -> np.ndarray:
        """[row, request] products; NaN where either vector is missing."""
        total = np.zeros((split.n, len(self.ids)))
        by_dim, queries = split.by_dim[side], self.queries[side]
        for d in range(min(len(by_dim), queries.shape[1])):
            total += by_dim[d][:, None] * queries[:, d][None, :]
        total[~split.has[side]] = np.nan
        total[:, ~self.has[side]] = np.nan
        return total

    def allowed(self, split: _Split, marks: np.ndarray | None) -> np.ndarray:
        """[row, request]: what a request may see; everything without a filter."""
        seen = np.zeros((split.n, len(self.ids)), bool)
        if marks is not None and self.filtered.any():
            place = {slot: i for i, slot in enumerate(self.slots)}
            at, slot = marks // PLACE, marks % PLACE
            column = np.array([place.get(s, -1) for s in slot.tolist()])
            seen[at[column >= 0], column[column >= 0]] = True
        seen[:, ~self.filtered] = True
        return seen


def _meetings(batches, key: str) -> Iterator[tuple[_Split, object, _Asked, np.ndarray | None]]:
    """(split, block key, requests, marks) of every row; each part is read once while it repeats."""
    known: dict = {}
    last, split = None, None
    for batch in batches:
        numbers, keys = batch.column("split").to_pylist(), batch.column(key).to_pylist()
        for i, (number, block) in enumerate(zip(numbers, keys)):
            if number != last:
                last, split = number, _Split(batch, i)
            if block not in known:
                known[block] = _Asked(batch.column("asked")[i].as_py())
                known[block].raw = batch.column("asked")[i] if key == "list" else None
            marks = batch.column("marks")[i]
            yield split, block, known[block], (
                marks.values.to_numpy() if marks.is_valid else None)


def _rows(ids: pa.Array, paths: pa.Array, slots: np.ndarray, rows: np.ndarray,
          image: np.ndarray, caption: np.ndarray, sides: list[str] | None = None):
    columns = {
        "query_id": ids.take(pa.array(slots)), "path": paths.take(pa.array(rows)),
        "image_score": pa.array(image[rows, slots], from_pandas=True),
        "caption_score": pa.array(caption[rows, slots], from_pandas=True)}
    if sides is not None:
        columns = {"side": pa.array(sides, pa.string())} | columns
    return pa.RecordBatch.from_pydict(columns)


_SCORED = "query_id string, path string, image_score double, caption_score double"


def _first(scores: np.ndarray, paths: pa.Array, rows: np.ndarray, depth: int) -> np.ndarray:
    """The ``depth`` best of ``rows`` by falling score, then path."""
    if rows.size > depth:
        edge = -np.partition(-scores[rows], depth - 1)[depth - 1]
        rows = rows[scores[rows] >= edge]
    names = paths.take(pa.array(rows)).to_pylist()
    order = sorted(range(len(rows)), key=lambda i: (-scores[rows[i]], names[i]))
    return rows[order[:depth]]


def best_rows(index: StoredIndex, blocks: DataFrame, marks: DataFrame | None = None,
              sides: tuple[str, ...] = SIDES) -> DataFrame:
    """(side, query_id, path, image_score, caption_score): each split's best rows per request.

    A superset of the best ``depth`` rows of either side over the whole index.
    A task remembers the best ``depth``-th row any of its splits has shown and
    leaves out what is behind it.
    """

    def kernel(batches):
        edges: dict = {}
        for split, block, asked, marks_ in _meetings(batches, "block"):
            seen = asked.allowed(split, marks_)
            scores = {side: asked.scores(split, side) for side in SIDES}
            slots, rows, labels = [], [], []
            for side in sides:
                usable = seen & ~np.isnan(scores[side])
                for q, depth in enumerate(asked.depth):
                    own = np.flatnonzero(usable[:, q])
                    column = scores[side][:, q]
                    edge = edges.get((block, side, q))
                    if edge is not None:
                        own = own[-column[own] <= edge[0]]
                    if not own.size or not depth:
                        continue
                    own = _first(column, split.paths, own, depth)
                    last = -column[own[-1]], split.paths[int(own[-1])].as_py()
                    if edge is not None:
                        tied = own[-column[own] == edge[0]]
                        late = [r for r in tied.tolist()
                                if split.paths[r].as_py() > edge[1]]
                        own = own[~np.isin(own, late)]
                    elif own.size < depth:
                        last = None
                    if last is not None and own.size == depth:
                        edges[block, side, q] = last if edge is None else min(edge, last)
                    slots.append(np.full(own.size, q))
                    rows.append(own)
                    labels += [side] * own.size
            if labels:
                yield _rows(asked.ids, split.paths, np.concatenate(slots), np.concatenate(rows),
                            scores["image"], scores["caption"], labels)

    return _met(index, blocks, marks).mapInArrow(kernel, f"side string, {_SCORED}")


def score_all(index: StoredIndex, blocks: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """(query_id, path, image_score, caption_score) of every row a request may see."""

    def kernel(batches):
        for split, _, asked, marks_ in _meetings(batches, "block"):
            rows, slots = np.nonzero(asked.allowed(split, marks_))
            yield _rows(asked.ids, split.paths, slots, rows, asked.scores(split, "image"),
                        asked.scores(split, "caption"))

    return _met(index, blocks, marks).mapInArrow(kernel, _SCORED)


def score_pairs(index: StoredIndex, blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, path, image_score, caption_score) of given (query_id, path) rows in the index."""

    def kernel(batches):
        for split, _, asked, marks in _meetings(batches, "block"):
            at, slot = marks // PLACE, marks % PLACE
            found = {}
            for side in SIDES:
                total = np.zeros(len(at))
                by_dim, queries = split.by_dim[side], asked.queries[side]
                for d in range(min(len(by_dim), queries.shape[1])):
                    total += by_dim[d][at] * queries[slot, d]
                total[~(split.has[side][at] & asked.has[side][slot])] = np.nan
                found[side] = pa.array(total, from_pandas=True)
            yield pa.RecordBatch.from_pydict({
                "query_id": asked.ids.take(pa.array(slot)),
                "path": split.paths.take(pa.array(at)),
                "image_score": found["image"], "caption_score": found["caption"]})

    met = _met(index, blocks, pair_marks(pairs, index, blocks))
    return met.filter("marks IS NOT NULL").mapInArrow(kernel, _SCORED)


class _Counter:
    """Rows ahead of each target of one request, on one side."""

    def __init__(self, targets: list[tuple[float, str]]):
        targets.sort(key=lambda t: (-t[0], t[1]))
        self.edges = np.array([-s for s, _ in targets])
        self.names = [path for _, path in targets]
        self.first = np.zeros(len(targets) + 1, np.int64)

    def add(self, scores: np.ndarray, rows: np.ndarray, paths: pa.Array) -> None:
        keys = -scores[rows]
        low = np.searchsorted(self.edges, keys, side="left")
        place = np.searchsorted(self.edges, keys, side="right")
        ties = np.flatnonzero(low < place)
        if ties.size:
            tied = paths.take(pa.array(rows[ties])).to_pylist()
            for t, path in zip(ties.tolist(), tied):
                at = bisect_left(self.names, path, int(low[t]), int(place[t]))
                # A target is not ahead of itself.
                if at < place[t] and self.names[at] == path:
                    at += 1
                place[t] = at
        self.first += np.bincount(place, minlength=self.first.size)


def counted_ranks(index: StoredIndex, blocks: DataFrame, targets: DataFrame,
                  marks: DataFrame | None = None) -> DataFrame:
    """(query_id, path, image_rank, caption_rank): exact ranks of a few rows, nothing sorted whole.

    ``targets`` is (query_id, path, image_score, caption_score), a null score
    for a side that has no such row. Every task counts the rows it sees ahead
    of each target and gives one number per target.
    """
    sizes = targets.groupBy("query_id").agg(F.ceil(F.count("*") / TARGETS).alias("_lists"))
    listed = (
        targets.join(sizes, "query_id")
        .groupBy("query_id", F.pmod(F.xxhash64("path"), F.col("_lists")).alias("_list"))
        .agg(F.collect_list(F.struct("path", "image_score", "caption_score")).alias("targets"))
        .join(request_slots(blocks), "query_id")
    )
    lists = listed.groupBy(
        "block", F.pmod(F.xxhash64("query_id"), F.lit(GROUPS)).alias("_g"), "_list").agg(
        F.collect_list(F.struct("slot", "query_id", "image_query", "caption_query", "has_filter",
                                "targets")).alias("asked")
    ).select(F.concat_ws("-", "block", "_g", "_list").alias("list"), "block", "asked")
    lists = materialize(lists, "targets")

    def kernel(batches):
        counters: dict = {}
        for split, key, asked, marks_ in _meetings(batches, "list"):
            if key not in counters:
                own = counters[key] = {}
                for q, request in enumerate(asked.raw.as_py()):
                    for side in SIDES:
                        own[q, side] = _Counter([
                            (t[f"{side}_score"], t["path"]) for t in request["targets"]
                            if t[f"{side}_score"] is not None])
                counters[key, "ids"] = asked.ids.to_pylist()
                asked.raw = None
            seen = asked.allowed(split, marks_)
            for side in SIDES:
                scores = asked.scores(split, side)
                usable = seen & ~np.isnan(scores)
                for q in range(len(asked.slots)):
                    counter = counters[key][q, side]
                    rows = np.flatnonzero(usable[:, q])
                    if counter.names and rows.size:
                        counter.add(scores[:, q], rows, split.paths)
        for key, own in counters.items():
            if isinstance(key, tuple):
                continue
            ids = counters[key, "ids"]
            for (q, side), counter in own.items():
                if counter.names:
                    yield pa.RecordBatch.from_pydict({
                        "query_id": pa.array([ids[q]] * len(counter.names), pa.string()),
                        "path": pa.array(counter.names, pa.string()),
                        "side": pa.array([side] * len(counter.names), pa.string()),
                        "ahead": pa.array(np.cumsum(counter.first[:-1]), pa.int64())})

    partial = _met(index, lists, marks).mapInArrow(
        kernel, "query_id string, path string, side string, ahead long")
    return partial.groupBy("query_id", "path").agg(*(
        (F.sum(F.when(F.col("side") == side, F.col("ahead"))) + 1).alias(f"{side}_rank")
        for side in SIDES))
