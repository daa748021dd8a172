"""Pieces that several operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side of a few fixed-width columns is broadcast up to this many rows (tens
# of MB in memory) and joined by shuffle beyond.
BROADCAST_ROWS = 500_000


def checked_broadcast(table: DataFrame) -> DataFrame:
    """``table`` (written, narrow) for broadcast if it is counted to be small enough."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def partitions(df: DataFrame) -> int:
    """How many partitions work on rows that cost more than their bytes say."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")),
               spark.sparkContext.defaultParallelism)


def lean(kernel, rows: int = 256):
    """``kernel`` for texts: fed small slices of each batch, memory given back at the end.

    A batch may hold ten thousand texts; as Python strings they would be alive
    together. Workers outlive a task, so what its allocators still hold is
    returned to the system.
    """

    def run(batches):
        try:
            yield from kernel(
                batch.slice(at, rows) for batch in batches
                for at in range(0, batch.num_rows, rows))
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every system has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased runs of anything but 0x20 and 0x09-0x0D.

    ``bytes.lower`` and ``bytes.split`` know only ASCII letters and white
    space, which is exactly this rule on UTF-8.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, remembered for the frequent ones."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_ROLL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    values = (values ^ (values >> np.uint64(32))) * _MIX
    return values ^ (values >> np.uint64(29))


def runs(values: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of ``length`` consecutive values."""
    total = np.zeros(len(values) - length + 1, np.uint64)
    for i in range(length):
        total = total * _ROLL + values[i:len(values) - length + 1 + i]
    return mixed(total)


def shingle_set(text: str | None, hashes: WordHashes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word runs; a shorter text is one run."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    return np.unique(runs(hashes.of(words), size))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of batches sorted by ``keys`` (integers), one table each."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        if not table.num_rows:
            continue
        new = np.zeros(table.num_rows - 1, bool)
        for key in keys:
            column = table.column(key).to_numpy()
            new |= column[1:] != column[:-1]
        bounds = [0, *(np.flatnonzero(new) + 1)]
        for start, end in zip(bounds, bounds[1:]):
            yield table.slice(start, end - start)
        held = table.slice(bounds[-1])
    if held is not None:
        yield held


def matrix(column: pa.ChunkedArray | pa.Array, dtype: str) -> np.ndarray:
    """Equally long binary values as the rows of a matrix."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1)


def joined(names_l: np.ndarray, names_r: np.ndarray, linked: np.ndarray):
    """The smallest name each row and column is connected with through ``linked``."""
    left, right, top = names_l.copy(), names_r.copy(), np.iinfo(np.int64).max
    while True:
        new_l = np.minimum(left, np.where(linked, right[None, :], top).min(axis=1, initial=top))
        new_r = np.minimum(right, np.where(linked, new_l[:, None], top).min(axis=0, initial=top))
        if (new_l == left).all() and (new_r == right).all():
            return left, right
        left, right = new_l, new_r
