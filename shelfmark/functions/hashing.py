"""Signatures and distances over 64-bit hashes."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from shelfmark.functions.text import tokens

HASH_BITS = 64
MD5_BYTES = 55  # texts that fit one block of MD5
MD5_ROWS = 4_096  # words that are hashed at once

_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MD5_ADD = [np.uint32(int(abs(math.sin(i + 1)) * 2 ** 32)) for i in range(64)]
_MD5_TURN = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))


def hamming(left: Column, right: Column) -> Column:
    return F.bit_count(left.bitwiseXOR(right))


def token_hash(token: Column) -> Column:
    """64 bits of a token's MD5 as a signed BIGINT."""
    digest = F.md5(token)
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("bigint")
    return F.shiftleft(high, 32).bitwiseOR(low)


def _md5_starts(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first 64 bits of the MD5 of each piece of ``data``, all of at most MD5_BYTES bytes."""
    n = len(size)
    block = np.zeros((n, 64), np.uint8)  # one block of MD5 each: text, end mark, number of bits
    row = np.repeat(np.arange(n), size)
    spot = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    block[row, spot] = data[first[row] + spot]
    block[np.arange(n), size] = 0x80
    block[:, 56], block[:, 57] = size * 8 & 255, size * 8 >> 8
    word = np.ascontiguousarray(block.view("<u4").T)
    a, b, c, d = (np.full(n, x, np.uint32) for x in _MD5_START)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += word[g]
        f += _MD5_ADD[i]
        turn = _MD5_TURN[i // 16][i % 4]
        a, d, c, b = d, c, b, b + (f << np.uint32(turn) | f >> np.uint32(32 - turn))
    ends = np.stack([a + np.uint32(_MD5_START[0]), b + np.uint32(_MD5_START[1])], axis=1)
    return ends.astype("<u4").view(">u8").ravel().astype(np.uint64)


def token_hashes(words: pa.StringArray) -> np.ndarray:
    """``token_hash`` of every word, as unsigned numbers."""
    n = len(words)
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset:words.offset + n + 1].astype(np.int64)
    first, size = ends[:-1], np.diff(ends)
    data = np.frombuffer(data, np.uint8)
    short = np.flatnonzero(size <= MD5_BYTES)
    for at in range(0, len(short), MD5_ROWS):  # as many as stay in the processor's cache
        own = short[at:at + MD5_ROWS]
        out[own] = _md5_starts(data, first[own], size[own])
    for i in np.flatnonzero(size > MD5_BYTES):
        digest = hashlib.md5(data[first[i]:first[i] + size[i]].tobytes()).digest()
        out[i] = int.from_bytes(digest[:8], "big")
    return out


def bit_votes(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many of each text's hashes have each bit; texts lie one behind the other, none empty."""
    # Eight bits of a hash are counted at once in a byte each, over at most 255 hashes.
    pieces = -(-size // 255)
    first = np.cumsum(pieces) - pieces
    inside = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
    starts = np.repeat(np.cumsum(size) - size, pieces) + 255 * inside
    votes = np.empty((len(size), HASH_BITS), np.int64)
    for i in range(8):
        lanes = np.add.reduceat(hashes >> np.uint64(i) & np.uint64(0x0101010101010101), starts)
        each = lanes.astype("<u8").view(np.uint8).reshape(-1, 8)
        votes[:, i::8] = np.add.reduceat(each, first, axis=0, dtype=np.int64)
    return votes


def _row_votes(batches):
    for batch in batches:
        key, listed = batch.column(0), batch.column(1)
        size = np.diff(listed.offsets.to_numpy())
        some = size > 0
        if not some.any():
            continue
        words = listed.flatten().dictionary_encode()
        hashes = token_hashes(words.dictionary)[words.indices.to_numpy()]
        votes = bit_votes(hashes, size[some])
        yield pa.RecordBatch.from_arrays(
            [key.filter(pa.array(some)), pa.array(size[some].astype(np.int64)),
             *(pa.array(votes[:, i]) for i in range(HASH_BITS))],
            names=[batch.schema.names[0], "_n", *(f"_b{i}" for i in range(HASH_BITS))])


def text_signatures(rows: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, signature): a 64-bit majority signature of each whole text.

    It takes the place of a picture hash for catalogs of text: close texts get
    signatures a few bits apart. Rows without a token get none. Every row's
    tokens are hashed, each word once a batch, and counted where the row is
    read; rows of one key are summed.
    """
    words = rows.select(F.col(key), tokens(F.col(text)).alias("_t"))
    counted = StructType([words.schema[0], *(
        StructField(c, LongType()) for c in ("_n", *(f"_b{i}" for i in range(HASH_BITS))))])
    votes = words.mapInArrow(_row_votes, counted).groupBy(key).agg(
        F.sum("_n").alias("_n"), *(F.sum(f"_b{i}").alias(f"_b{i}") for i in range(HASH_BITS)))
    signature = F.lit(0).cast("bigint")
    for i in range(HASH_BITS):
        bit = F.when(F.col(f"_b{i}") * 2 > F.col("_n"), F.lit(1).cast("bigint")).otherwise(
            F.lit(0).cast("bigint")
        )
        signature = signature.bitwiseOR(F.shiftleft(bit, i))
    return votes.select(key, signature.alias("signature"))
