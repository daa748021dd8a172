"""Filter interaction audit: what each filter removes, in every order of applying them.

One scan of the texts gives every document the set of filters it fails, as a
mask. Documents are then counted by part and mask, so that 2**n counts a part
hold all that the orders can tell. In an order, a mask's document is removed
at the first of its filters. All orders that begin with the same letters lie
next to each other in lexicographic order, so those in which a mask falls at a
step are a few intervals of Lehmer ranks: per step, the mask's counts are
added where an interval begins and taken away where it ends, and a prefix sum
over the ranks gives the removals of all orders at once.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import lean
from shelfmark.session import materialize

CAPITALS, MARKS = bytes(range(0x41, 0x5B)), b"#$%&*|"
FOLLOWING = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point
NAMES = "ABCDE"
REPEATED = 1 << 4  # the mask of E


def text_failures(raw: bytes) -> int:
    """Mask of the filters A to D that a text fails."""
    words = raw.split()  # at 0x20 and 0x09-0x0D
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    points = len(raw.translate(None, FOLLOWING))
    return ((len(words) < 50)
            | (100 * len(set(words)) < 65 * len(words)) << 1
            | (100 * capitals > 5 * points) << 2
            | (len(raw.translate(None, MARKS)) < len(raw)) << 3)


def _facts(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest): texts reduced to four failures and 128 bits."""

    def kernel(batches):
        for batch in batches:
            texts = [raw or b"" for raw in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([text_failures(raw) for raw in texts], pa.int32()),
                 pa.array([hashlib.blake2b(raw, digest_size=16).digest() for raw in texts],
                          pa.binary())],
                names=["doc_id", "part", "mask", "digest"])

    name = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(lean(kernel), f"doc_id {name}, part string, mask int, digest binary")


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and by the filters they fail.

    E is decided by joining each text's smallest id to the documents by id and
    digest, so a text held by a third of all rows is only ever a partial
    minimum. Rows without an id are apart: they fail no E, and have no labels.
    """
    facts = materialize(_facts(docs), "facts")
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    named = facts.filter("doc_id IS NOT NULL")
    firsts = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn(
        "first", F.lit(True))
    judged = named.join(firsts, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    nameless = facts.filter("doc_id IS NULL").select(
        "part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    rows = judged.select(
        "part", F.when(F.col("first"), F.col("mask"))
        .otherwise(F.col("mask").bitwiseOR(F.lit(REPEATED))).alias("mask"),
        F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"),
    ).unionByName(nameless)
    return rows.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


@functools.cache
def removal_intervals(n: int) -> list[np.ndarray]:
    """For each mask over ``n`` filters, rows (step, first rank, rank after the last).

    The orders that begin with given letters start at the Lehmer rank whose
    digits are each letter's place among those not yet used, and are as many
    as the rest can be arranged. A mask falls at the last of these letters if
    it holds that one and none before it.
    """
    found: list[list] = [[] for _ in range(1 << n)]
    for step in range(n):
        size = math.factorial(n - 1 - step)
        for letters in itertools.permutations(range(n), step + 1):
            rank = 0
            for place, letter in enumerate(letters):
                digit = letter - sum(used < letter for used in letters[:place])
                rank += digit * math.factorial(n - 1 - place)
            before = sum(1 << used for used in letters[:-1])
            for mask in range(1 << n):
                if mask >> letters[-1] & 1 and not mask & before:
                    found[mask].append((step, rank, rank + size))
    return [np.array(rows, np.int64).reshape(-1, 3) for rows in found]


@functools.cache
def orders(n: int) -> np.ndarray:
    """Filter at each [rank, step]; permutations come in lexicographic order."""
    return np.array(list(itertools.permutations(range(n))), np.int64)


def order_totals(counts: np.ndarray) -> dict[str, np.ndarray]:
    """[rank, step] totals of a part from its [mask, (documents, good, toxic)] counts."""
    n = len(counts).bit_length() - 1
    spans, by_rank = removal_intervals(n), orders(n)
    ends = np.zeros((n, math.factorial(n) + 1, 3), np.int64)
    for mask in np.flatnonzero(counts.any(axis=1)).tolist():
        step, start, stop = spans[mask].T
        np.add.at(ends, (step, start), counts[mask])
        np.subtract.at(ends, (step, stop), counts[mask])
    removed = ends.cumsum(axis=1)[:, :-1].transpose(1, 0, 2)
    bits = np.arange(len(counts))
    fails = np.array([counts[bits >> f & 1 == 1, 0].sum() for f in range(n)])
    gone = removed[:, :, 0]
    share = np.array([gone[by_rank == f].sum() for f in range(n)])
    return {
        "kept": counts[:, 0].sum() - gone.cumsum(axis=1), "removed": gone,
        "redundant": fails[by_rank] - gone, "unique_fails": counts[1 << by_rank, 0],
        "good_lost": removed[:, :, 1], "toxic_lost": removed[:, :, 2], "shapley": share[by_rank],
    }


def interactions(counts: DataFrame, names: str = NAMES) -> DataFrame:
    """(part, filter_order, step, kept ... shapley) from (part, mask, n, good, toxic).

    One row per part, order and step. Bit i of a mask is the filter names[i].
    """
    n = len(names)
    fields = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    labels = pa.array(["".join(names[f] for f in order) for order in orders(n).tolist()])
    size = len(labels)

    def kernel(batches):
        for batch in batches:
            for part, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table = np.zeros((1 << n, 3), np.int64)
                for row in held:
                    table[row["mask"]] = row["n"], row["good"], row["toxic"]
                totals = order_totals(table)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * (size * n), pa.string()),
                     labels.take(pa.array(np.repeat(np.arange(size), n))),
                     pa.array(np.tile(np.arange(1, n + 1), size).astype(np.int32)),
                     *(pa.array(totals[f].ravel()) for f in fields)],
                    names=["part", "filter_order", "step", *fields])

    held = counts.groupBy("part").agg(  # at most 2**n rows a part
        F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("held"))
    return held.mapInArrow(kernel, "part string, filter_order string, step int, " + ", ".join(
        f"{f} long" for f in fields))


def audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "source") -> DataFrame:
    """The five filters in all 120 orders, per part of the documents.

    A document fails A with under 50 words, B if 100 x distinct words are
    under 65 x words, C if 100 x A-Z are over 5 x code points, D if it holds
    any of #$%&*|, E if a smaller id has the same text. Null texts are empty
    ones and fail A only (and E); a null part is the empty string. Rows that
    repeat an id with its text count each and fail no E for each other.
    Several labels of one id count if any of them is 1; null labels are not 1.
    An empty table gives no rows, other columns are ignored.
    """
    light = docs.select(F.col(id_col).alias("doc_id"),
                        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                        F.col(text_col).cast("string").alias("text"))
    return interactions(failure_counts(light, labels.select(
        F.col("doc_id"), F.col("quality"), F.col("toxic"))))
