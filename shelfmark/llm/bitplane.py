"""Token ids in files of bit or byte planes.

A file holds whole documents. Its ids are cut into blocks of a fixed size; a
block is transposed into planes (all first bytes, all second bytes, ..., or
the same by bits), each compressed with zstandard on its own. Behind them lie
the chunk index (place, id count and plane sizes of each block) and the table
of documents (id, token count), so any range of ids is read by decoding only
the blocks it touches.

Documents are dealt out by ranges of their id and sorted inside a partition, a
task writes its own files, and only partition totals are summed up globally.
Files carry the attempt in their name and are known by the manifest that
successful tasks return, so repeated or lost attempts leave nothing that is
read. Files go through Arrow's file systems, under the folder that the cluster
names for checkpoints.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import lean, partitions
from shelfmark.llm.tokens import encoding, slices
from shelfmark.session import checkpoint_root, materialize

MAGIC = b"IDPLANE1"
TAIL = "<QII8s"  # place of the index, its size, size of the documents, magic


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of 32-bit ids: 4 of bytes, or 32 of bits."""
    if not bits:
        return [p.tobytes() for p in ids.astype("<u4").view(np.uint8).reshape(-1, 4).T]
    return [np.packbits((ids >> b).astype(np.uint8) & 1).tobytes() for b in range(32)]


def from_planes(planes: list[bytes], count: int, bits: bool) -> np.ndarray:
    if not bits:
        flat = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
        return np.ascontiguousarray(flat).view("<u4").ravel()
    ids = np.zeros(count, "<u4")
    for b, plane in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(plane, np.uint8), count=count).astype("<u4") << b
    return ids


class PlaneWriter:
    """Writes one file; holds one block and the list of documents."""

    def __init__(self, out, block: int, bits: bool, level: int = 3):
        self.out, self.block, self.bits = out, block, bits
        self.press = zstandard.ZstdCompressor(level=level)
        self.held: list[np.ndarray] = []
        self.pending = self.total = self.at = 0
        self.index: list[list[int]] = []
        self.docs: list = []
        self.counts: list[int] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids))
        self.held.append(ids)
        self.pending += len(ids)
        self.total += len(ids)
        if self.pending >= self.block:
            flat = np.concatenate(self.held)
            full = len(flat) // self.block * self.block
            for start in range(0, full, self.block):
                self._chunk(flat[start:start + self.block])
            self.held, self.pending = [flat[full:]], len(flat) - full

    def _chunk(self, ids: np.ndarray) -> None:
        planes = [self.press.compress(p) for p in to_planes(ids, self.bits)]
        self.index.append([self.at, len(ids), *map(len, planes)])
        for plane in planes:
            self.out.write(plane)
            self.at += len(plane)

    def close(self) -> None:
        if self.pending:
            self._chunk(np.concatenate(self.held))
        head = json.dumps({"block": self.block, "bits": self.bits, "chunks": self.index})
        index = self.press.compress(head.encode())
        table = pa.table({"doc_id": pa.array(self.docs, pa.int64()),
                          "n": pa.array(self.counts, pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        docs = self.press.compress(sink.getvalue().to_pybytes())
        self.out.write(index)
        self.out.write(docs)
        self.out.write(struct.pack(TAIL, self.at, len(index), len(docs), MAGIC))
        self.out.close()


class PlaneReader:
    """Reads a file, or any range of its ids."""

    def __init__(self, source):
        self.source, self.unpress = source, zstandard.ZstdDecompressor()
        size = struct.calcsize(TAIL)
        source.seek(source.size() - size)
        at, index, docs, magic = struct.unpack(TAIL, source.read(size))
        if magic != MAGIC:
            raise ValueError("not a file of id planes")
        source.seek(at)
        head = json.loads(self.unpress.decompress(source.read(index)))
        self.bits, self.chunks, self.block = head["bits"], head["chunks"], head["block"]
        with pa.ipc.open_stream(self.unpress.decompress(source.read(docs))) as stream:
            self.docs = stream.read_all()

    def chunk(self, number: int) -> np.ndarray:
        at, count, *sizes = self.chunks[number]
        self.source.seek(at)
        planes = [self.unpress.decompress(self.source.read(n)) for n in sizes]
        return from_planes(planes, count, self.bits)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file, from the blocks they lie in."""
        first, last = start // self.block, (stop - 1) // self.block
        if stop <= start:
            return np.zeros(0, "<u4")
        flat = np.concatenate([self.chunk(i) for i in range(first, last + 1)])
        return flat[start - first * self.block:stop - first * self.block]

    def documents(self) -> Iterator[tuple]:
        """(doc_id, token count, crc32 of the ids) in order, a block at a time."""
        number, flat = 0, b""
        for doc_id, n in zip(self.docs["doc_id"].to_pylist(), self.docs["n"].to_pylist()):
            crc, need = 0, n * 4
            while need > len(flat):
                crc, need = zlib.crc32(flat, crc), need - len(flat)
                flat = memoryview(self.chunk(number).tobytes())
                number += 1
            yield doc_id, n, zlib.crc32(flat[:need], crc)
            flat = flat[need:]


def write_planes(docs: DataFrame, folder: str, vocabulary: str, *, end_id: int, id_col: str,
                 text_col: str, block: int, file_ids: int, bits: bool) -> DataFrame:
    """Write the files; (part, seq, name, docs, ids, before) of each, ``before`` in its part."""

    def kernel(batches):
        with encoding(vocabulary) as model:
            yield from written_by(batches, model)

    def written_by(batches, model):
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        store, root = pafs.FileSystem.from_uri(folder)
        writer, rows, before = None, [], 0

        def finish():
            nonlocal writer, before
            rows.append((part, len(rows), name, len(writer.docs), writer.total, before))
            before += writer.total
            writer.close()
            writer = None

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, stop in slices(texts):
                for key, data in zip(keys[start:stop], model.encode(texts[start:stop])):
                    if writer is None:
                        name = f"part-{part:05d}-{len(rows):05d}-{attempt}.ids"
                        writer = PlaneWriter(store.open_output_stream(f"{root}/{name}"),
                                             block, bits)
                    ids = np.frombuffer(data, model.dtype).astype("<u4")
                    writer.add(key, np.append(ids, np.uint32(end_id)))
                    if writer.total >= file_ids:
                        finish()
        if writer is not None:
            finish()
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in zip(*rows)],
                names=["part", "seq", "name", "docs", "ids", "before"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(partitions(rows), "doc_id").sortWithinPartitions(
        "doc_id", "text")
    written = dealt.mapInArrow(
        lean(kernel), "part long, seq long, name string, docs long, ids long, before long")
    return materialize(written, "manifest")


def read_planes(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    ``start`` is summed over partition totals: one row per partition.
    """
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("ids"))
    bases = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids"))
                         .alias("base"))
    files = manifest.join(bases, "part").select(
        "name", (F.col("base") + F.col("before")).alias("start"))

    def kernel(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(f"{root}/{name}") as source:
                    ids, counts, crcs = zip(*PlaneReader(source).documents())
                starts = start + np.cumsum([0, *counts[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()),
                     pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(partitions(files), "name").mapInArrow(
        kernel, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary: str, *, end_id: int = 2, id_col: str = "doc_id",
                text_col: str = "text", block: int = 65_536, file_ids: int = 4_000_000,
                bits: bool = False) -> DataFrame:
    """Write ``docs`` as id files and return (doc_id, start, n_tokens, ids_crc32) read back.

    Documents lie in ascending id order (null ids first, equal ids by text),
    each followed by ``end_id``; a null or empty text is the end id alone.
    A file is closed at the first document end past ``file_ids``, so a very
    long text makes a longer file but is encoded and written block by block.
    Other columns are ignored; an empty table writes nothing.
    """
    root = checkpoint_root(docs.sparkSession)
    folder = f"{root}/shelfmark/ids-{uuid.uuid4().hex}"
    store, path = pafs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    manifest = write_planes(docs, folder, vocabulary, end_id=end_id, id_col=id_col,
                            text_col=text_col, block=block, file_ids=file_ids, bits=bits)
    return read_planes(manifest, folder)
