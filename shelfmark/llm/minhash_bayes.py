"""Near-duplicate documents: banded MinHash, sequential Bayesian pruning, exact sets.

Documents with one and the same shingle set are a class from the start and only
its smallest id is compared. Signatures of 128 minima in 32 bands of 4 make a
pair of similarity 0.75 a candidate but for 5e-6 of cases. Of a candidate pair
16 minima at a time are compared, and it is dropped as soon as the posterior
probability (uniform prior) that its similarity reaches the threshold falls
under ``miss``; what survives is decided on the full sets.

No bucket is ever expanded into its pairs. Members are first compared with one
member of the bucket, twice with different ones; links found so far are turned
into components, and a bucket whose other members are in one component is
done. What is left (members that are alike but not similar enough) is compared
in blocks of bounded size inside the tasks: pairs between different components
that survive the pruning make families, and within blocks of a family they are
decided on the full sets. Tasks report whom a document is joined with, never
pairs, so a group of many near copies costs a few rows per member, and no link
between components is lost.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import (
    WordHashes, checked_broadcast, joined, lean, matrix, mixed, partitions, shingle_set, sorted_groups,
)
from shelfmark.operators.components import connected_components
from shelfmark.session import materialize

BANDS, ROWS, BATCH, BLOCK = 32, 4, 16, 256


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_17)
    return (rng.integers(0, 1 << 31, count, np.uint32) * np.uint32(2) + np.uint32(1),
            rng.integers(0, 1 << 32, count, np.uint32))


def signature(shingles: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """One minimum per permutation; ``shingles`` must not be empty."""
    low = np.full(len(mult), 0xFFFFFFFF, np.uint32)
    narrow = (shingles >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(narrow), 1024):
        part = narrow[None, start:start + 1024] * mult[:, None] + add[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return low


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """A hash of each band of ROWS minima, different for equal minima in other bands."""
    parts = sig.reshape(BANDS, ROWS).astype(np.uint64)
    total = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + parts[:, i])
    return total


def least_matches(threshold: float, miss: float, total: int = BANDS * ROWS) -> list[int]:
    """Per batch: fewest matches of n with P(similarity >= threshold) >= ``miss``.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper
    tail is the probability of at most m successes in n + 1 trials.
    """
    bounds = []
    for n in range(BATCH, total + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss and m < n:
            m += 1
            tail += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        bounds.append(m)
    return bounds


def surviving(left: np.ndarray, right: np.ndarray, bounds: list[int]) -> np.ndarray:
    """Positions of the signature pairs that no batch rules out."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int32)
    for i, least in enumerate(bounds):
        part = slice(i * BATCH, (i + 1) * BATCH)
        matches = matches + (left[alive, part] == right[alive, part]).sum(axis=1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
    return alive


def _sign(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n_shingles, key, bands, sig) of (doc_id, text); the last three null without words.

    ``sig`` keeps one byte of each minimum: different minima agree in it once
    in 256, which makes pruning a little more careful, never less.
    """
    mult, add = _permutations(BANDS * ROWS)

    def kernel(batches):
        hashes = WordHashes()
        for batch in batches:
            sizes, keys, bands, sigs = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, hashes, shingle)
                sizes.append(len(found))
                keys.append(xxhash.xxh128_digest(found.tobytes()) if len(found) else None)
                sig = signature(found, mult, add) if len(found) else None
                bands.append(None if sig is None else band_hashes(sig).view(np.int64))
                sigs.append(None if sig is None else (sig & np.uint32(255)).astype("u1").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "key", "bands", "sig"])

    return docs.mapInArrow(
        lean(kernel), "doc_id long, n_shingles long, key binary, bands array<long>, sig binary")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, shingles) of (doc_id, text)."""

    def kernel(batches):
        hashes = WordHashes()
        for batch in batches:
            found = [shingle_set(t, hashes, shingle) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, found)])
            flat = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)],
                names=["doc_id", "shingles"])

    return docs.mapInArrow(lean(kernel), "doc_id long, shingles array<long>")


class _Verifier:
    """Decides candidate pairs (a, b); keeps the sets it has read for later rounds."""

    def __init__(self, docs: DataFrame, sigs: DataFrame, shingle: int, percent: int,
                 bounds: list[int]):
        self.docs, self.sigs, self.shingle = docs, sigs, shingle
        self.percent, self.bounds = percent, bounds
        self.sets: DataFrame | None = None

    def prune(self, pairs: DataFrame) -> DataFrame:
        bounds = self.bounds
        both = pairs.join(self.sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")),
                          "a").join(
            self.sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb")), "b")

        def kernel(batches):
            for batch in batches:
                if batch.num_rows:
                    alive = surviving(matrix(batch.column(2), "u1"),
                                      matrix(batch.column(3), "u1"), bounds)
                    yield batch.select([0, 1]).take(pa.array(alive))

        return both.select("a", "b", "sa", "sb").mapInArrow(kernel, "a long, b long")

    def read_sets(self, ids: DataFrame) -> DataFrame:
        """All sets read so far, those of ``ids`` (doc_id, distinct) among them."""
        if self.sets is not None:
            ids = ids.join(self.sets.select("doc_id"), "doc_id", "left_anti")
        ids = materialize(ids, "ids")
        more = materialize(
            _sets(self.docs.join(checked_broadcast(ids), "doc_id", "left_semi"), self.shingle),
            "sets")
        self.sets = more if self.sets is None else self.sets.unionByName(more)
        return self.sets

    def links(self, survivors: DataFrame) -> DataFrame:
        """The pairs of ``survivors`` (written) that are similar enough by their full sets."""
        sets = self.read_sets(
            survivors.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        both = survivors.join(
            sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a"
        ).join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        return both.select("a", "b", shared.alias("n"),
                           (F.size("x") + F.size("y")).alias("sizes")).filter(
            F.col("n") * 100 >= (F.col("sizes") - F.col("n")) * self.percent).select("a", "b")


def _open_buckets(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(bucket, doc, comp) of the buckets whose members are not all in one component."""
    named = members.join(comps, F.col("doc") == F.col("node"), "left").select(
        "bucket", "doc", F.coalesce("component", "doc").alias("comp"))
    mixed = named.groupBy("bucket").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    return named.join(mixed.select("bucket"), "bucket")


def _blocks(members: DataFrame, group: str) -> DataFrame:
    """``members`` once per pair (i, j) of blocks of their ``group`` that they are in."""
    sizes = members.groupBy(group).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    own = F.pmod(F.xxhash64("doc", F.lit(5)), F.col("blocks"))
    rows = members.join(sizes, group).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn(
        "j", F.greatest("own", "other")).drop("other", "blocks")
    return rows.repartition(partitions(rows), group, "i", "j").sortWithinPartitions(
        group, "i", "j")


def _candidates(group: pa.Table, bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of one pair of blocks, of different components, that no batch rules out."""
    comp, own = group.column("comp").to_numpy(), group.column("own").to_numpy()
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    if i == j:
        left, right = np.triu_indices(len(comp), 1)
    else:
        left, right = (v.ravel() for v in np.meshgrid(
            np.flatnonzero(own == i), np.flatnonzero(own == j), indexing="ij"))
    apart = comp[left] != comp[right]
    left, right = left[apart], right[apart]
    if not len(left):
        return left, right
    sig = matrix(group.column("sig"), "u1")
    alive = np.concatenate([
        surviving(sig[left[s:s + 16_384]], sig[right[s:s + 16_384]], bounds) + s
        for s in range(0, len(left), 16_384)])
    return left[alive], right[alive]


def _stars(doc: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    """(a, b): each document of the pairs with the smallest one they join it with."""
    rows = np.unique(np.concatenate([left, right]))
    linked = np.zeros((len(rows), len(rows)), bool)
    x, y = np.searchsorted(rows, left), np.searchsorted(rows, right)
    linked[x, y] = linked[y, x] = True
    first, _ = joined(doc[rows], doc[rows], linked)
    return pa.RecordBatch.from_arrays([pa.array(first), pa.array(doc[rows])], names=["a", "b"])


def _families(members: DataFrame, sigs: DataFrame, bounds: list[int]) -> DataFrame:
    """(doc, comp, family) of members that have a surviving pair in one of their buckets."""
    rows = members.join(sigs.select(F.col("doc_id").alias("doc"), "sig"), "doc")

    def kernel(batches):
        for group in sorted_groups(batches, ["bucket", "i", "j"]):
            if group.num_rows > 1:
                left, right = _candidates(group, bounds)
                if len(left):
                    yield _stars(group.column("doc").to_numpy(), left, right)

    stars = materialize(_blocks(rows, "bucket").mapInArrow(kernel, "a long, b long").filter(
        "a <> b").distinct(), "families")
    named = connected_components(stars.toDF("src", "dst"))
    return members.select("doc", "comp").distinct().join(
        named.select(F.col("node").alias("doc"), F.col("component").alias("family")), "doc")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets share; values that only one set has are left out."""
    sizes = [len(x) for x in sets]
    values, column, counts = np.unique(
        np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    keep = counts[column] > 1
    number = np.cumsum(counts > 1) - 1
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float64)
    for start in range(0, int(number[-1]) + 1 if len(number) else 0, 8_192):
        lo, hi = np.searchsorted(column, [start, start + 8_192])
        dense = np.zeros((len(sets), 8_192), np.float32)
        dense[row[lo:hi], column[lo:hi] - start] = 1
        total += dense @ dense.T
    return total.astype(np.int64)


def _family_links(members: DataFrame, sigs: DataFrame, sets: DataFrame, bounds: list[int],
                  percent: int) -> DataFrame:
    """(a, b): links of each family by full sets, as one row per document and pair of blocks."""
    rows = members.join(sigs.select(F.col("doc_id").alias("doc"), "sig"), "doc").join(
        sets.select(F.col("doc_id").alias("doc"), "shingles"), "doc")

    def kernel(batches):
        for group in sorted_groups(batches, ["family", "i", "j"]):
            if group.num_rows < 2:
                continue
            left, right = _candidates(group, bounds)
            if not len(left):
                continue
            used = np.unique(np.concatenate([left, right]))
            found = group.column("shingles").take(pa.array(used)).combine_chunks()
            found = [x.values.to_numpy() for x in found]
            x, y = np.searchsorted(used, left), np.searchsorted(used, right)
            shared = overlaps(found)[x, y]
            sizes = np.array([len(v) for v in found])
            ok = shared * 100 >= (sizes[x] + sizes[y] - shared) * percent
            if ok.any():
                yield _stars(group.column("doc").to_numpy(), left[ok], right[ok])

    return _blocks(rows, "family").mapInArrow(kernel, "a long, b long").filter("a <> b").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 5, percent: int = 75, miss: float = 1e-6) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Two documents are linked if 100 * shared shingles >= ``percent`` * all
    shingles of both; component_id is the smallest id reachable, kept marks its
    row. Texts without words (null, empty, white space) have no shingles and
    are linked with nothing. Rows that share an id are one document for links,
    and each is returned; a null id is linked with nothing and kept. Other
    columns are ignored, an empty table gives no rows, and texts may have any
    length.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).alias("text"))
    bounds = least_matches(percent / 100, miss)
    signed = materialize(_sign(docs, shingle), "signed")
    classes = materialize(
        signed.filter("key IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")),
        "classes")
    sigs = materialize(
        signed.join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi")
        .select("doc_id", "bands", "sig").filter("sig IS NOT NULL"), "sigs")
    bands = sigs.select(F.col("doc_id").alias("doc"), F.explode("bands").alias("bucket"))
    shared = bands.groupBy("bucket").agg(
        F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo <> hi")
    members = materialize(bands.join(shared.select("bucket", "lo"), "bucket").distinct(), "members")

    verifier = _Verifier(docs.filter("doc_id IS NOT NULL"), sigs, shingle, percent, bounds)
    pairs = members.filter("doc <> lo").select(
        F.col("lo").alias("a"), F.col("doc").alias("b")).distinct()
    links = materialize(
        verifier.links(materialize(verifier.prune(pairs), "survivors")), "links")
    comps = materialize(connected_components(links.toDF("src", "dst")), "components")

    # Once more with other members as the ones to compare with, then the rest.
    left = materialize(_open_buckets(
        members.filter("doc <> lo").select("bucket", "doc"), comps), "open")
    if left.limit(1).count():
        pivots = left.groupBy("bucket").agg(F.min(F.struct(
            F.xxhash64("doc", "bucket").alias("h"), "doc", "comp")).alias("pivot")).select(
            "bucket", F.col("pivot.doc").alias("pivot"), F.col("pivot.comp").alias("pivot_comp"))
        met = left.join(pivots, "bucket")
        pairs = met.filter("comp <> pivot_comp").select(
            F.least("pivot", "doc").alias("a"), F.greatest("pivot", "doc").alias("b")).distinct()
        links = links.unionByName(materialize(
            verifier.links(materialize(verifier.prune(pairs), "survivors")), "links"))
        comps = materialize(connected_components(links.toDF("src", "dst")), "components")
        left = materialize(_open_buckets(
            met.filter("doc <> pivot").select("bucket", "doc"), comps), "open")
        if left.limit(1).count():
            families = materialize(_families(left, sigs, bounds), "families")
            sets = verifier.read_sets(families.select(F.col("doc").alias("doc_id")))
            links = links.unionByName(materialize(
                _family_links(families, sigs, sets, bounds, percent), "links"))
            comps = materialize(connected_components(links.toDF("src", "dst")), "components")

    named = classes.filter("copies > 1").select("key", "class_id")
    rows = signed.select("doc_id", "n_shingles", "key").join(named, "key", "left").withColumn(
        "class_id", F.coalesce("class_id", "doc_id"))
    rows = rows.join(comps, F.col("class_id") == F.col("node"), "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id"))
        .alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
