"""Exact Hamming self-join of 64-bit signatures by blocks that are read again, not shuffled.

Signatures are packed into blocks of one row each, and the blocks meet as a
product of partitions. Nothing is exploded or shuffled by key, so a value that
most signatures share makes no task larger. Inside a task two blocks meet on
band values that must agree where those tell the signatures apart, and
otherwise one against all; both ways are exact. Where only components are asked
for, a block is linked in itself first, and two blocks only by what joins them.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.hashing import HASH_BITS
from shelfmark.operators.components import HeldEdges, thin_edges
from shelfmark.operators.links import compare_all as _by_all
from shelfmark.operators.links import link_rows, spans
from shelfmark.session import materialize

DISTANCE = 6
BLOCK = 32_768  # signatures in a block
LINK_BLOCK = 1 << 18  # signatures in a block where only components are asked for
LOOKUP = 16  # comparisons that cost as much as one candidate of a band
SAMPLE = 2_048  # rows of a block by which the number of candidates is judged


def _slices(positions: list[int], parts: int) -> list[int]:
    """The bit positions dealt into ``parts`` masks."""
    cuts = [len(positions) * i // parts for i in range(parts + 1)]
    return [
        sum(1 << p for p in positions[a:b]) for a, b in zip(cuts, cuts[1:])
    ]


def band_masks(distance: int, bands: int) -> list[int]:
    """Masks of every choice of ``bands - distance`` of ``bands`` bit bands.

    Two signatures at most ``distance`` bits apart differ in at most that many
    bands, so they agree on at least one of these masks.
    """
    parts = _slices(list(range(HASH_BITS)), bands)
    return [sum(parts[b] for b in chosen) for chosen in combinations(range(bands), bands - distance)]


def _agreeing(left: np.ndarray, right: np.ndarray, mask: np.uint64):
    """(order, first, last): right[order[first[i]:last[i]]] agree with left[i] under the mask."""
    keys = right & mask
    order = np.argsort(keys)
    keys = keys[order]
    wanted = left & mask
    return order, np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, "right")


def _few_candidates(left: np.ndarray, right: np.ndarray, masks: list[np.uint64]) -> bool:
    """Whether looking up band values costs less than comparing all; only the cost hangs on it."""
    one, two = (side[::-(-len(side) // SAMPLE)] for side in (left, right))
    met = 0
    for mask in masks:
        _, first, last = _agreeing(one, two, mask)
        met += int((last - first).sum())
    return met * LOOKUP < len(one) * len(two)


def _by_bands(left: np.ndarray, right: np.ndarray, distance: int, masks: list[np.uint64]):
    for k, mask in enumerate(masks):
        order, first, last = _agreeing(left, right, mask)
        for start, stop, inside in spans(first, last):
            at = np.repeat(np.arange(start, stop), last[start:stop] - first[start:stop])
            to = order[inside]
            differing = left[at] ^ right[to]
            near = np.bitwise_count(differing) <= distance
            for earlier in masks[:k]:  # the first mask under which two agree gives the pair
                near &= (differing & earlier) != 0
            yield at[near], to[near]


def near_rows(left: np.ndarray, right: np.ndarray, distance: int, masks: list[int]):
    """Chunks (at, to) of every pair of rows at most ``distance`` bits apart, each pair once."""
    masks = [np.uint64(m) for m in masks]
    if not len(left) or not len(right):
        return iter(())
    if _few_candidates(left, right, masks):
        return _by_bands(left, right, distance, masks)
    return _by_all(left, right, distance)


def _blocks(signatures: DataFrame, block: int, label=None) -> DataFrame:
    """(block, ids, sigs): the rows packed, at most ``block`` to a row.

    ``label(sigs)`` adds a number for every signature, as a column ``low``.
    """
    # As many as let every worker meet some pair of blocks, however few rows there are. Where
    # blocks are linked, one of twice the rows takes twice the time: then there are fewer.
    workers = signatures.sparkSession.sparkContext.defaultParallelism
    pairs = (8 if label is None else 2) * workers
    n = max(math.ceil(signatures.count() / block), math.ceil(math.sqrt(pairs)))

    def pack(batches):
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def row(table: pa.Table, number: int) -> pa.RecordBatch:
            ids, sigs = (table.column(c).to_numpy() for c in (0, 1))
            packed = {"block": pa.array([number], pa.int64()), "ids": [ids.astype("<i8").tobytes()],
                      "sigs": [sigs.astype("<i8").tobytes()]}
            if label is not None:
                packed["low"] = [label(sigs.view(np.uint64)).astype("<i8").tobytes()]
            return pa.RecordBatch.from_pydict(packed)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= block:
                table = pa.Table.from_batches(held)
                for at in range(0, size - block + 1, block):
                    yield row(table.slice(at, block), number)
                    number += 1
                held = table.slice(size - size % block).to_batches()
                size %= block
        if size:
            yield row(pa.Table.from_batches(held), number)

    dealt = signatures.select(
        F.col("id").cast("long"), F.col("signature").cast("long")
    ).filter("id IS NOT NULL AND signature IS NOT NULL").repartition(n, "signature")
    schema = "block long, ids binary, sigs binary" + (", low binary" if label is not None else "")
    return materialize(dealt.mapInArrow(pack, schema), "signature_blocks")


def _meet(blocks: DataFrame, kernel, schema: str, last=None) -> DataFrame:
    """``kernel(one, two)`` over every two blocks, and every block with itself.

    A side is a dictionary of the block's columns as arrays, and its number.
    ``last()`` gives a task's last batches.
    """
    columns = [c for c in blocks.columns if c != "block"]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from kernel(*({"block": batch.column(n)[i].as_py()} | {
                    c: np.frombuffer(batch.column(f"{c}_{n}")[i].as_buffer(),
                                     "<u8" if c == "sigs" else "<i8") for c in columns}
                    for n in ("a", "b")))
        if last is not None:
            yield from last()

    def side(name: str) -> DataFrame:
        return blocks.select(F.col("block").alias(name),
                             *(F.col(c).alias(f"{c}_{name}") for c in columns))

    # Of the two orders of a pair one is taken, so that every task has about half of its own.
    low_first = F.pmod(F.xxhash64(F.least("a", "b"), F.greatest("a", "b")), F.lit(2)) == 0
    once = (F.col("a") == F.col("b")) | (low_first == (F.col("a") < F.col("b")))
    return side("a").join(side("b").hint("shuffle_replicate_nl"), once).mapInArrow(run, schema)


def hamming_pairs(
    signatures: DataFrame, distance: int = DISTANCE, bands: int | None = None, block: int = BLOCK,
) -> DataFrame:
    """(src, dst, bits) for every pair of *distinct* signatures within ``distance``.

    ``signatures`` is (id: BIGINT, signature: BIGINT) with each signature once;
    ``src < dst`` are ids. ``bands`` sets how long the band values are, ``block``
    how many signatures a block holds; neither changes the pairs. The table is
    read more than once, so it should be written.
    """
    masks = band_masks(distance, distance + 2 if bands is None else bands)

    def kernel(left, right):
        for at, to in near_rows(left["sigs"], right["sigs"], distance, masks):
            if left["block"] == right["block"]:
                keep = at < to
                at, to = at[keep], to[keep]
            if len(at):
                one, two = left["ids"][at], right["ids"][to]
                differing = left["sigs"][at] ^ right["sigs"][to]
                yield pa.RecordBatch.from_pydict({
                    "src": np.minimum(one, two), "dst": np.maximum(one, two),
                    "bits": np.bitwise_count(differing).astype(np.int32)})

    return _meet(_blocks(signatures, block), kernel, "src long, dst long, bits int")


def hamming_edges(
    rows: DataFrame, distance: int = DISTANCE, bands: int | None = None, block: int = LINK_BLOCK,
) -> DataFrame:
    """(src, dst) edges whose components are those of "within ``distance`` bits".

    Rows of one signature form a star around their lowest id instead of a
    clique; only one row per signature enters the join. A block has its own
    components linked when it is packed, so two blocks only add the edges that
    join components of theirs.
    """
    lone = materialize(rows.groupBy("signature").agg(F.min("id").alias("lead")), "lone")
    stars = (
        rows.join(lone, "signature").filter("id <> lead")
        .select(F.col("lead").alias("src"), F.col("id").alias("dst"))
    )
    blocks = _blocks(lone.select(F.col("lead").alias("id"), "signature"), block,
                     lambda sigs: link_rows(sigs, distance, bands))
    held = HeldEdges()  # each task has its own copy

    def out(forests):
        for src, dst in forests:
            yield pa.RecordBatch.from_pydict({"src": src, "dst": dst})

    def kernel(left, right):
        ids = np.concatenate([left["ids"], right["ids"]])
        if left["block"] == right["block"]:
            before, low = np.arange(len(left["ids"])), left["low"]
        else:
            size = len(left["ids"])
            before = np.concatenate([left["low"], right["low"] + size])
            low = link_rows(np.concatenate([left["sigs"], right["sigs"]]), distance, bands,
                            before, size)
            before = np.unique(before)
            low = low[before]
        moved = low != before
        if moved.any():
            yield from out(held.add(ids[low[moved]], ids[before[moved]]))

    pairs = _meet(blocks, kernel, "src long, dst long", lambda: out(held.rest()))
    return stars.unionByName(thin_edges(pairs))
