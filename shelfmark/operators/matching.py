"""Term matching between request texts and captions: an inverted index, rarest terms first."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import caption_terms, content_terms
from shelfmark.session import materialize

CAPTIONS, REQUESTS = 2_048, 128  # in a split, in a block
TERMS = 1_024  # in one product


def request_terms(requests: DataFrame) -> DataFrame:
    """(query_id, term, copies): content terms with their repeats."""
    return (
        requests.select("query_id", F.explode(content_terms(F.col("text"))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("copies"))
    )


def term_hits(captions: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, path, hits): query terms a caption holds, repeats counted.

    Every caption that shares one term is a row, which may be most of the
    catalog for each request; ``matches_over`` gives those over a threshold.

    A caption's terms are distinct before they are exploded, so one aggregate
    is enough. With ``terms`` broadcast the join only filters, and the sums are
    complete inside a map task, as a caption never spans two.
    """
    words = captions.select("path", F.explode(caption_terms(F.col("caption"))).alias("term"))
    return (
        words.join(terms, "term").groupBy("query_id", "path")
        .agg(F.sum("copies").cast("int").alias("hits"))
    )


def index_captions(captions: DataFrame) -> DataFrame:
    """(split, paths, terms, sizes, starts, rows): captions by term, some thousand to a row.

    ``rows[starts[i]:starts[i + 1]]`` are the places in ``paths`` that hold
    ``terms[i]``, ``sizes[i]`` of them. Made in one scan without a shuffle and
    written once for all searches.
    """

    def kernel(batches):
        split = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, CAPTIONS):
                part = batch.slice(at, CAPTIONS)
                own = part.column(1)
                terms = own.flatten().dictionary_encode()
                codes = terms.indices.to_numpy()
                rows = np.repeat(np.arange(part.num_rows, dtype="<i4"),
                                 np.diff(own.offsets.to_numpy()))
                order = np.argsort(codes, kind="stable")
                sizes = np.bincount(codes, minlength=len(terms.dictionary))
                yield pa.RecordBatch.from_pydict({
                    "split": [split], "paths": [part.column(0).to_pylist()],
                    "terms": [terms.dictionary.to_pylist()], "sizes": [sizes],
                    "starts": [np.concatenate([[0], np.cumsum(sizes)]).astype("<i4").tobytes()],
                    "rows": [rows[order].astype("<i4").tobytes()]}, schema=layout)
                split += 1

    layout = pa.schema([("split", pa.int64()), ("paths", pa.list_(pa.string())),
                        ("terms", pa.list_(pa.string())), ("sizes", pa.list_(pa.int32())),
                        ("starts", pa.binary()), ("rows", pa.binary())])
    words = captions.select("path", caption_terms(F.col("caption")).alias("own"))
    return materialize(words.mapInArrow(
        kernel, "split long, paths array<string>, terms array<string>, sizes array<int>, "
                "starts binary, rows binary"), "captions")


def term_plans(terms: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, listed, total): each request's (n, term, copies), rarest term first.

    ``n`` is the number of captions that hold the term. A request's terms are
    bounded by its text.
    """
    listed = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("_t")).select(
        F.col("_t.terms").alias("term"), F.col("_t.sizes").alias("n"))
    counted = listed.join(terms.select("term"), "term", "left_semi").groupBy("term").agg(
        F.sum("n").alias("n"))
    return (
        terms.join(counted, "term", "left")
        .groupBy("query_id").agg(
            F.array_sort(F.collect_list(F.struct(
                F.coalesce("n", F.lit(0)).alias("n"), "term", "copies"))).alias("listed"),
            F.sum("copies").cast("int").alias("total"))
    )


class _Captions:
    """Captions of one split, from row ``i`` of a batch."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.paths = batch.column("paths")[i].values
        self.terms = batch.column("terms")[i].values
        self.rows, self.starts = (
            np.frombuffer(batch.column(c)[i].as_py(), "<i4") for c in ("rows", "starts"))

    def holders(self, term: int) -> np.ndarray:
        return self.rows[self.starts[term]:self.starts[term + 1]]


class _Wanted:
    """The requests of one block, as [term, request] copies; terms come rarest first."""

    def __init__(self, asked: list[dict]):
        self.ids = pa.array([a["query_id"] for a in asked], pa.string())
        self.needed = np.array([a["needed"] for a in asked])
        self.total = np.array([a["total"] for a in asked])
        self.apart = np.array([bool(a["apart"]) for a in asked])
        order = sorted({(t["n"], t["term"]) for a in asked for t in a["listed"]})
        spots = {term: i for i, (_, term) in enumerate(order)}
        self.terms = pa.array([term for _, term in order], pa.string())
        self.only = [a["only"] for a in asked]
        self.copies = np.zeros((len(order), len(asked)), np.float32)
        self.opens = np.zeros(len(order), bool)
        for slot, request in enumerate(asked):
            left = request["total"]
            for term in request["listed"]:
                at = spots[term["term"]]
                self.copies[at, slot] = term["copies"]
                # A caption without this and every rarer term cannot be a match.
                self.opens[at] |= left >= request["needed"]
                left -= term["copies"]

    def hits(self, captions: _Captions) -> np.ndarray:
        """[caption, request] copies held, 0 under the needed hits."""
        n = len(captions.paths)
        found = np.zeros((n, len(self.ids)), np.float32)
        # (place among the asked terms, place among the split's terms) of what both have.
        there = pc.index_in(self.terms, value_set=captions.terms).fill_null(-1).to_numpy()
        met = [(at, there[at]) for at in np.flatnonzero(there >= 0).tolist()]
        open_rows = np.zeros(n, bool)
        for at, term in met:
            if self.opens[at]:
                open_rows[captions.holders(term)] = True
        if any(only is not None for only in self.only):
            shown = pa.array(sorted({path for only in self.only for path in only or ()}),
                             pa.string())
            open_rows &= pc.is_in(captions.paths, value_set=shown).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(open_rows)
        place = np.cumsum(open_rows) - 1
        for start in range(0, len(met) if rows.size else 0, TERMS):
            part = met[start:start + TERMS]  # whole numbers, exact in single precision
            held = np.zeros((len(rows), len(part)), np.float32)
            for column, (_, term) in enumerate(part):
                own = captions.holders(term)
                held[place[own[open_rows[own]]], column] = 1
            found[rows] += held @ self.copies[[at for at, _ in part]]
        found[found < self.needed] = 0
        return found.astype(np.int64)


def _met(index: DataFrame, plans: DataFrame, total: int, kernel, schema: str) -> DataFrame:
    """Splits of captions x blocks of requests through ``kernel``."""
    blocks = max(1, -(-total // REQUESTS))
    for name, kind in (("apart", "boolean"), ("only", "array<string>")):
        if name not in plans.columns:
            plans = plans.withColumn(name, F.lit(None).cast(kind))
    asked = plans.select(
        F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"),
        F.struct("query_id", "needed", "total", "apart", "only", "listed").alias("one"),
    ).groupBy("block").agg(F.collect_list("one").alias("asked"))

    def run(batches):
        known: dict = {}
        captions, last = None, None
        for batch in batches:
            splits, blocks_ = batch.column("split").to_pylist(), batch.column("block").to_pylist()
            for i, (split, block) in enumerate(zip(splits, blocks_)):
                if split != last:
                    captions, last = _Captions(batch, i), split
                if block not in known:
                    known[block] = _Wanted(batch.column("asked")[i].as_py())
                yield from kernel(captions, known[block])

    return index.drop("sizes").crossJoin(asked).mapInArrow(run, schema)


def _emitted(captions: _Captions, wanted: _Wanted, hits: np.ndarray) -> dict:
    rows, slots = np.nonzero(hits)
    return {"query_id": wanted.ids.take(pa.array(slots)),
            "path": captions.paths.take(pa.array(rows)),
            "hits": pa.array(hits[rows, slots].astype(np.int32))}


def matches_over(index: DataFrame, plans: DataFrame, total: int) -> DataFrame:
    """(query_id, path, hits) of the captions that reach each request's ``needed`` hits.

    ``index`` is ``index_captions``, ``plans`` is ``term_plans`` with a column
    ``needed`` (at least 1) and maybe ``only`` (the paths it may match), ``total``
    about how many requests there are. Requests come in blocks, captions in
    splits with a list of rows by term. Of a request's terms, rarest first, as
    many open captions as could still make a match together with those after
    them; only opened captions are counted, as one product of (caption, term)
    and (term, request). Nothing under the threshold leaves the task.
    """

    def kernel(captions, wanted):
        found = wanted.hits(captions)
        if found.any():
            yield pa.RecordBatch.from_pydict(_emitted(captions, wanted, found))

    return _met(index, plans, total, kernel, "query_id string, path string, hits int")


def hits_among(index: DataFrame, plans: DataFrame, total: int, shown: DataFrame) -> DataFrame:
    """(query_id, path, hits) of the shown (query_id, path) rows that hold any term.

    A request shows a bounded number of rows; their paths travel with its terms.
    """
    only = shown.groupBy("query_id").agg(F.collect_list("path").alias("only"))
    found = matches_over(index, plans.join(only, "query_id").withColumn("needed", F.lit(1)), total)
    return found.join(shown.select("query_id", "path"), ["query_id", "path"], "left_semi")


def match_counts(index: DataFrame, plans: DataFrame, total: int,
                 pool: DataFrame | None = None) -> DataFrame:
    """(query_id, full_count, partial_count): captions with all terms, and with the needed ones.

    ``plans`` as for ``matches_over``, with a flag ``apart`` for requests that
    see only their (query_id, path) rows of ``pool``. All others are counted
    where the captions are, and only numbers leave the task.
    """

    def kernel(captions, wanted):
        found = wanted.hits(captions)
        full = found == wanted.total
        yield pa.RecordBatch.from_pydict({
            "query_id": wanted.ids, "path": pa.nulls(len(wanted.ids), pa.string()),
            "full": pa.array(np.where(wanted.apart, 0, full.sum(axis=0))),
            "part": pa.array(np.where(wanted.apart, 0, (found > 0).sum(axis=0)))})
        found[:, ~wanted.apart] = 0
        if found.any():
            rows = _emitted(captions, wanted, found)
            at, slot = np.nonzero(found)
            yield pa.RecordBatch.from_pydict({
                "query_id": rows["query_id"], "path": rows["path"],
                "full": pa.array(full[at, slot].astype(np.int64)),
                "part": pa.array(np.ones(len(at), np.int64))})

    rows = _met(index, plans, total, kernel,
                "query_id string, path string, full long, part long")
    if pool is not None:
        rows = rows.join(pool.withColumn("_in", F.lit(True)), ["query_id", "path"], "left").filter(
            F.col("path").isNull() | F.col("_in"))
    return rows.groupBy("query_id").agg(F.sum("full").cast("int").alias("full_count"),
                                        F.sum("part").cast("int").alias("partial_count"))
