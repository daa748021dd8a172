"""Vector code compression: product codes fitted and assigned on Hilbert-sorted flat blocks.

Components become whole numbers and every vector is cut into equal parts. The
parts of one position are sorted along a Hilbert curve and packed into flat
blocks of neighbours; a block stores its min/max box, the sums of its
components, its parts and the rows they belong to. In each round a block
measures the nearest and the farthest any point of its box can be from every
codebook entry. Entries that are never nearer than another's farthest point
are out; what is left is the block's shortlist. With one entry left the
block's sums go to it and no part is looked at; else a small kernel of exact
whole-number products settles every part among the shortlist. Equal parts
share a block without extent, which is settled once.

Only the codebooks (at most ``entries`` per part) reach the driver. Sums are
added in tasks, then by Spark per entry and component.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.vectors import components
from shelfmark.session import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1_024
BLOCK = 128  # parts in a flat block
TASK_BYTES = 32 << 20  # of parts that one task sorts into blocks
LIMIT = (1 << 31) - 1  # components are clipped to this
KEY_BITS = 64
LONGEST = (1 << 63) - 1


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``cells`` (whole numbers under 2**bits) on the Hilbert curve.

    Skilling's transform (2004), all rows at once, component by component.
    The keys have bits x components bits, at most 64, and sort as signed longs.
    """
    axes = cells.astype(np.uint64).T.copy()
    one, zero = np.uint64(1), np.uint64(0)
    for level in range(bits - 1, 0, -1):
        bit, below = one << np.uint64(level), (one << np.uint64(level)) - one
        for i in range(len(axes)):
            high = (axes[i] & bit) != 0
            swap = np.where(high, zero, (axes[0] ^ axes[i]) & below)
            axes[0] ^= np.where(high, below, swap)
            axes[i] ^= swap
    for i in range(1, len(axes)):
        axes[i] ^= axes[i - 1]
    turn = np.zeros(axes.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        bit = one << np.uint64(level)
        turn ^= np.where((axes[-1] & bit) != 0, bit - one, zero)
    axes ^= turn
    keys = np.zeros(axes.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            keys = (keys << one) | ((axis >> np.uint64(level)) & one)
    return (keys ^ (one << np.uint64(KEY_BITS - 1))).view(np.int64)


class Curve:
    """The grid of one part position: the range of its first entries in 2**bits cells a side.

    Up to 64 components take part, those of the widest range. The curve only
    decides which parts are neighbours, never a result.
    """

    def __init__(self, entries: np.ndarray):
        low, high = entries.min(axis=0), entries.max(axis=0)
        self.used = np.argsort(low - high, kind="stable")[:KEY_BITS]
        self.bits = max(1, KEY_BITS // len(self.used))
        self.low, self.width = low[self.used], (high - low)[self.used] + 1

    def keys(self, parts: np.ndarray) -> np.ndarray:
        side = 1 << min(self.bits, 31)
        cells = (parts[:, self.used] - self.low) * side // self.width
        return hilbert_keys(np.clip(cells, 0, side - 1), min(self.bits, 31))


def exact(width: int, *values: np.ndarray) -> type:
    """A number type in which squared distances of ``width`` components are exact."""
    top = max(int(max(-v.min(initial=0), v.max(initial=0))) for v in values)
    worst = width * (2 * top) ** 2
    return float if worst < 1 << 53 else np.int64 if worst < 1 << 63 else object


def box_shortlist(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Ascending indexes of the entries that may be nearest to a point of the box."""
    kind = exact(len(low), low, high, entries)
    under, over = low.astype(kind) - entries.astype(kind), entries.astype(kind) - high.astype(kind)
    near = (np.maximum(np.maximum(under, over), 0) ** 2).sum(axis=1)
    far = (np.maximum(-under, -over) ** 2).sum(axis=1)
    return np.flatnonzero(near <= far.min())


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each part's nearest entry (ties to the lower one) and the squared distance."""
    kind = exact(parts.shape[1], parts, entries)
    a, b = parts.astype(kind), entries.astype(kind)
    squares = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
    best = squares.argmin(axis=1)
    return best, squares[np.arange(len(a)), best]


class Block:
    """One flat block as read from its row."""

    def __init__(self, row: dict):
        self.dim, self.part, self.n = row["dim"], row["part"], row["n"]
        self.low, self.high = (np.frombuffer(row[k], "<i4").astype(np.int64)
                               for k in ("low", "high"))
        self.sums = np.frombuffer(row["sums"], "<i8")
        self._parts, self._owners = row["parts"], row["owners"]

    @property
    def parts(self) -> np.ndarray:
        return np.frombuffer(self._parts, "<i4").reshape(self.n, -1).astype(np.int64)

    @property
    def owners(self) -> np.ndarray:
        return np.frombuffer(self._owners, "<i8")

    def settle(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray] | int:
        """The only entry in reach, or (index, squared distance) of every part."""
        short = box_shortlist(self.low, self.high, entries)
        if len(short) == 1:
            return int(short[0])
        if (self.low == self.high).all():
            return int(short[nearest(self.low[None, :], entries[short])[0][0]])
        index, square = nearest(self.parts, entries[short])
        return short[index], square


def _blocks_of(batches):
    for batch in batches:
        for row in batch.to_pylist():
            yield Block(row)


def _whole(vectors: DataFrame, n_parts: int) -> DataFrame:
    """(vec_id, label, dim, ints) of usable vectors; ints are little-endian 32-bit numbers."""

    def kernel(batches):
        for batch in batches:
            rows = [None if v is None or len(v) % n_parts else
                    np.clip(np.floor(v * float(SCALE)), -LIMIT, LIMIT).astype("<i4")
                    for v in components(batch.column(2))]
            kept = [i for i, v in enumerate(rows) if v is not None]
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at),
                 pa.array([len(rows[i]) for i in kept], pa.int64()),
                 pa.array([rows[i].tobytes() for i in kept], pa.binary())],
                names=["vec_id", "label", "dim", "ints"])

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.mapInArrow(kernel, f"vec_id long, label {label}, dim long, ints binary")


def _first_entries(whole: DataFrame, n_parts: int, entries: int) -> dict[int, np.ndarray]:
    """Vector length -> [part, entry, component] of the smallest ids (null ids last)."""
    order = Window.partitionBy("dim").orderBy(F.asc_nulls_last("vec_id"), "ints")
    head = whole.withColumn("place", F.row_number().over(order)).filter(
        F.col("place") <= entries)
    rows: dict[int, list] = {}
    for row in sorted(head.select("dim", "place", "ints").collect()):  # entries a length
        rows.setdefault(row["dim"], []).append(np.frombuffer(row["ints"], "<i4"))
    return {dim: np.array(own, np.int64).reshape(len(own), n_parts, -1).transpose(1, 0, 2)
            for dim, own in rows.items()}


def _packed(whole: DataFrame, books: dict[int, np.ndarray], n_parts: int) -> DataFrame:
    """Flat blocks of neighbours on the curve, one row each."""
    curves = {dim: [Curve(part) for part in book] for dim, book in books.items()}

    def cut(batches):
        for batch in batches:
            owners = batch.column(0).to_numpy()
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == dim)
                ints = np.frombuffer(
                    b"".join(batch.column(2).take(pa.array(mine)).to_pylist()), "<i4")
                parts = ints.reshape(len(mine), n_parts, -1)
                for part in range(n_parts):
                    own = np.ascontiguousarray(parts[:, part])
                    keys = curves[dim][part].keys(own.astype(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(mine), dim)), pa.array(np.full(len(mine), part)),
                         pa.array(keys), pa.array(owners[mine]),
                         pa.array([v.tobytes() for v in own], pa.binary())],
                        names=["dim", "part", "key", "owner", "ints"])

    def pack(batches):
        for batch in batches:
            dims, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ints, owners = batch.column(4).to_pylist(), batch.column(3).to_numpy()
            turns = np.flatnonzero((np.diff(dims) != 0) | (np.diff(part) != 0)) + 1
            rows = []
            for start, stop in zip([0, *turns], [*turns, len(dims)]):
                for at in range(start, stop, BLOCK):
                    to = min(at + BLOCK, stop)
                    own = np.frombuffer(b"".join(ints[at:to]), "<i4").reshape(to - at, -1)
                    rows.append({
                        "dim": int(dims[at]), "part": int(part[at]), "n": to - at,
                        "low": own.min(axis=0).tobytes(), "high": own.max(axis=0).tobytes(),
                        "sums": own.sum(axis=0, dtype=np.int64).tobytes(),
                        "parts": own.tobytes(), "owners": owners[at:to].astype("<i8").tobytes()})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=layout)

    layout = pa.schema([(n, pa.int64()) for n in ("dim", "part", "n")]
                       + [(n, pa.binary()) for n in ("low", "high", "sums", "parts", "owners")])
    size = whole.agg(F.sum(F.length("ints") + 32 * n_parts)).first()[0] or 0
    tasks = max(math.ceil(size / TASK_BYTES),
                int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = ["dim", "part", "key", "owner"]  # the row's number splits a crowd of equal parts
    # A task gets its few MB as one run of the curve and writes them as blocks.
    return (
        whole.select("row", "dim", "ints")
        .mapInArrow(cut, "dim long, part long, key long, owner long, ints binary")
        .repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
        .mapInArrow(pack, "dim long, part long, n long, low binary, high binary, sums binary, "
                          "parts binary, owners binary")
    )


def _next_entries(blocks: DataFrame, books: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """One round: entries move to the whole-number mean of the parts nearest to them."""

    def kernel(batches):
        totals: dict[int, np.ndarray] = {}
        counts: dict[int, np.ndarray] = {}
        for block in _blocks_of(batches):
            book = books[block.dim]
            total = totals.setdefault(block.dim, np.zeros(book.shape, np.int64))
            count = counts.setdefault(block.dim, np.zeros(book.shape[:2], np.int64))
            won = block.settle(book[block.part])
            if isinstance(won, int):
                total[block.part, won] += block.sums
                count[block.part, won] += block.n
            else:
                np.add.at(total[block.part], won[0], block.parts)
                np.add.at(count[block.part], won[0], 1)
        for dim, total in totals.items():
            part, entry = np.nonzero(counts[dim])
            width = total.shape[2]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(part) * width, dim)), pa.array(np.repeat(part, width)),
                 pa.array(np.repeat(entry, width)),
                 pa.array(np.tile(np.arange(width), len(part))),
                 pa.array(np.repeat(counts[dim][part, entry], width)),
                 pa.array(total[part, entry].ravel())],
                names=["dim", "part", "entry", "place", "n", "total"])

    moved = (
        blocks.mapInArrow(kernel, "dim long, part long, entry long, place long, n long, total long")
        .groupBy("dim", "part", "entry", "place")
        .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    )
    after = {dim: book.copy() for dim, book in books.items()}
    for row in moved.collect():  # parts x entries x components of a length
        after[row["dim"]][row["part"], row["entry"], row["place"]] = int(row["total"]) // row["n"]
    return after


def _assigned(blocks: DataFrame, books: dict[int, np.ndarray]) -> DataFrame:
    """(row, part, entry, square) of every part."""

    def kernel(batches):
        for block in _blocks_of(batches):
            entries = books[block.dim][block.part]
            won = block.settle(entries)
            if isinstance(won, int):
                squares = nearest(block.parts, entries[won:won + 1])[1]
                won = (np.full(block.n, won), squares)
            index, square = won
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.owners), pa.array(np.full(block.n, block.part)),
                 pa.array(index.astype(np.int64)),
                 pa.array([min(int(s), LONGEST) for s in square.tolist()], pa.int64())],
                names=["row", "part", "entry", "square"])

    return blocks.mapInArrow(kernel, "row long, part long, entry long, square long")


def _digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, *, n_parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS, id_col: str = "vec_id", vec_col: str = "embedding",
             label_col: str = "label") -> DataFrame:
    """(vec_id, label, codes, error, codebooks_sha256) of every usable vector.

    ``codes`` is the array of its parts' entries, ``error`` the sum of their
    squared distances in units of 1/1024. Null and empty vectors, those with
    null or non-finite components and those whose length is not a multiple of
    ``n_parts`` give no row. Every length has codebooks of its own; lengths are
    few. Components beyond 2**31 units are clipped, distances to 64 bits. Rows
    that share an id are vectors of their own, null ids come last among the
    first entries, fewer vectors than ``entries`` make a smaller codebook, and
    an empty table gives no rows. Other columns are ignored.
    """
    whole = materialize(_whole(vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
        F.col(vec_col).cast("array<double>").alias("vec")), n_parts)
        .withColumn("row", F.monotonically_increasing_id()), "whole")
    books = _first_entries(whole, n_parts, entries)
    blocks = materialize(_packed(whole, books, n_parts), "blocks")
    for _ in range(rounds if books else 0):
        books = _next_entries(blocks, books)
    names = whole.select("row", "vec_id", "label", "dim", F.lit(True).alias("named"),
                         *(F.lit(None).cast("long").alias(c) for c in ("part", "entry", "square")))
    # One exchange by row brings a vector's name and its parts together.
    found = names.unionByName(_assigned(blocks, books), allowMissingColumns=True)
    pieces = [F.max(F.when(F.col("part") == p, F.col("entry"))) for p in range(n_parts)]
    sums = [F.max(F.when(F.col("part") == p, F.col("square"))).cast("decimal(38,0)")
            for p in range(n_parts)]
    error = sums[0]
    for more in sums[1:]:
        error = error + more
    digests = {dim: _digest(book) for dim, book in books.items()}
    known = F.create_map(*(F.lit(v) for pair in digests.items() for v in pair)) if digests \
        else F.lit(None).cast("map<long,string>")
    return found.groupBy("row").agg(
        *(F.max_by(c, "named").alias(c) for c in ("vec_id", "label", "dim")),
        F.array(*pieces).alias("codes"),
        F.least(error, F.lit(LONGEST).cast("decimal(38,0)")).cast("long").alias("error"),
    ).select("vec_id", "label", "codes", "error",
             F.element_at(known, F.col("dim")).alias("codebooks_sha256"))


def vector_codes(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), see ``compress``.

    ``code`` has two hex digits a part; ``label_error`` is the error summed
    over the vectors of an equal label, null labels together.
    """
    coded = materialize(compress(vectors, **options), "coded")
    sums = coded.groupBy("label").agg(F.least(
        F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)"))
        .cast("long").alias("label_error")).withColumnRenamed("label", "of")
    digits = F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", F.array_join(digits, "").alias("code"), "error", "label_error",
        "codebooks_sha256")
