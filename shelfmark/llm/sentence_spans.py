"""Repeated passages: every run of consecutive sentences is hashed and joined globally.

A sentence ends at ``.``, ``!`` or ``?`` before white space, at a line end, and
before a word that starts with a capital letter, because a passage pasted into
running text begins with one. From every sentence on, and back from every
sentence, the shortest run of at least ``sentences`` sentences and
``min_words`` words is a span (or of over ``alone`` words in fewer sentences).
Both directions together cover every sentence of a shared passage of more than
``alone`` words. With ``whole``, every run of that many whole sentences is a span
too, however few its words; a capital inside a sentence starts none of those. Spans
are equal where 96 bits of hash are (64 and 32 of two sums over 128-bit words). Every text is cut once. Of
equal spans the first by (document, place) stays; sentences covered by any other
one are removed.

A span that its own text had before is known where the text is read and carries
no hash. Of the others the smallest and the largest document are found by hash,
map-side first and one row per hash, so a passage that every document holds is
one row per task. Only spans of several documents are joined back, and what is
gathered per document is bounded by its own length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import checked_broadcast, lean, mixed
from shelfmark.session import materialize

WORD = re.compile(r"\S+")
CAPITAL, CLOSING = 1, 2


class _Words(dict):
    """Numbers of words; by number, 128 bits of hash of the lower-cased form and how it is written."""

    LIMIT = 200_000

    def __init__(self):
        super().__init__()
        self.codes, self.marks = np.empty((2, 4096), np.uint64), np.empty(4096, np.uint8)

    def __missing__(self, word: str) -> int:
        i = len(self)
        if i == len(self.marks):
            self.codes = np.concatenate([self.codes, np.empty_like(self.codes)], axis=1)
            self.marks = np.concatenate([self.marks, np.empty_like(self.marks)])
        code = xxhash.xxh3_128_intdigest(word.lower().encode("utf-8", "surrogatepass"))
        self.codes[:, i] = code >> 64, code & 0xFFFFFFFFFFFFFFFF
        self.marks[i] = word[0].isupper() * CAPITAL | (word[-1] in ".!?") * CLOSING
        self[word] = i
        return i


class Sentences:
    """Cuts texts into sentences and hashes their runs."""

    def __init__(self, sentences: int, min_words: int, alone: int, whole: int = 0):
        self.sentences, self.min_words, self.alone = sentences, min_words, alone
        self.whole = whole
        self.words = _Words()
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def cut(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(two rows of word hashes, the first word of each sentence and the number of words,
        which of these places do not rest on a capital alone)."""
        if len(self.words) > self.words.LIMIT:
            self.words = _Words()
        lines = [line.split() for line in text.split("\n")] if text else []
        flat = [w for line in lines for w in line]
        if not flat:
            return np.zeros((2, 0), np.uint64), np.zeros(1, np.int64), np.ones(1, bool)
        known = np.fromiter(map(self.words.__getitem__, flat), np.int64, len(flat))
        marks = self.words.marks[known]
        sure = np.append((marks & CLOSING) > 0, True)
        sure[1:] = sure[:-1].copy()
        sure[np.cumsum([0, *map(len, lines)])] = True
        starts = sure.copy()
        starts[:-1] |= (marks & CAPITAL) > 0
        starts = np.flatnonzero(starts)
        return self.words.codes[:, known], starts, sure[starts]

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            size = max(n, 2 * len(self.powers))
            self.powers = np.cumprod(np.append(np.ones(1, np.uint64),
                                               np.full(size - 1, self.base)))
            self.inverses = np.cumprod(np.append(np.ones(1, np.uint64),
                                                 np.full(size - 1, self.inverse)))

    def spans(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(two rows of hashes, first sentence, sentences) of every span, and all sentences."""
        values, starts, sure = self.cut(text)
        total, last = values.shape[1], len(starts) - 1
        at = np.arange(last + 1)
        ahead = np.minimum(
            np.maximum(np.searchsorted(starts, starts + self.min_words), at + self.sentences),
            np.searchsorted(starts, starts + self.alone + 1))
        back = np.maximum(
            np.minimum(np.searchsorted(starts, starts - self.min_words, "right") - 1,
                       at - self.sentences),
            np.searchsorted(starts, starts - self.alone - 1, "right") - 1)
        pairs = np.concatenate([
            np.stack([at, ahead], axis=1)[ahead <= last],
            np.stack([back, at], axis=1)[back >= 0],
            self._whole_runs(np.flatnonzero(sure))])
        code = np.unique(pairs[:, 0] * (last + 1) + pairs[:, 1])
        first, stop = code // (last + 1), code % (last + 1)
        self._grow(total + 1)
        sums = np.zeros((2, total + 1), np.uint64)
        np.cumsum(values * self.powers[:total], axis=1, out=sums[:, 1:])
        begin, end = starts[first], starts[stop]
        hashed = (sums[:, end] - sums[:, begin]) * self.inverses[begin]
        return mixed(hashed ^ mixed((end - begin).astype(np.uint64))), first, stop - first, last

    def _whole_runs(self, bounds: np.ndarray) -> np.ndarray:
        """(first, stop) of the runs of ``whole`` sentences between ``bounds``."""
        if not 0 < self.whole < len(bounds):
            return np.zeros((0, 2), np.int64)
        return np.stack([bounds[:-self.whole], bounds[self.whole:]], axis=1)

    def without(self, text: str, cuts: list[tuple[int, int]]) -> tuple[str, int]:
        """(text without the sentences of ``cuts``, sentences removed)."""
        starts = self.cut(text)[1]
        gone = np.zeros(len(starts), bool)
        for first, count in cuts:
            gone[first:first + count] = True
        places = [m.start() for m in WORD.finditer(text)] + [len(text)]
        kept, at = [], 0
        for i in np.flatnonzero(gone[:-1]).tolist():
            start, stop = places[starts[i]], places[starts[i + 1]]
            if start > at:
                kept.append(text[at:start])
            at = stop
        left = "".join(kept) + text[at:]
        return left if left.strip() else "", int(gone.sum())


def _seen(numbers: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Which rows have the number and both hashes of an earlier one; numbers ascend."""
    order = np.lexsort((high, low))  # stable, so by number, and the first of equal rows leads
    equal = np.ones(max(len(order) - 1, 0), bool)
    for values in (numbers, high, low):
        values = values[order]
        equal &= values[1:] == values[:-1]
    seen = np.zeros(len(order), bool)
    seen[order[1:]] = equal
    return seen


def _spans(rows: DataFrame, sizes: tuple[int, int, int, int]) -> DataFrame:
    """Every span of every row, and a row with count 0 that has the number of sentences.

    The latter and spans that came before in the same text have null hashes.
    """

    def kernel(batches):
        tool = Sentences(*sizes)
        for batch in batches:
            keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = [tool.spans(t) for t in batch.column(2).to_pylist()]
            totals = np.array([f[3] for f in found])
            counts = [len(f[1]) for f in found]
            none = np.zeros(len(found), np.int64)
            high, low = np.concatenate([f[0] for f in found], axis=1)
            high = (high >> np.uint64(32)).astype(np.uint32).view(np.int32)
            unmarked = np.append(_seen(np.repeat(np.arange(len(found)), counts), high, low),
                                 np.ones(len(found), bool))
            hashes = np.append(high, none.astype(np.int32)), np.append(low.view(np.int64), none)
            columns = [np.append(np.repeat(k, counts), k) for k in keys]
            columns += [np.append(np.concatenate([f[1] for f in found]), totals).astype(np.int32),
                        np.append(np.concatenate([f[2] for f in found]), none).astype(np.int32)]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, mask=unmarked) for c in hashes), *map(pa.array, columns)],
                names=["high", "low", "doc_id", "version", "first", "count"])

    return rows.mapInArrow(
        lean(kernel), "high int, low long, doc_id long, version long, first int, count int")


def _cleaned(sizes: tuple[int, int, int, int]):
    """A function of (text, cuts): the text left and the sentences removed; of null cuts nothing."""

    @F.arrow_udf("text string, removed int")
    def clean(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        tool = Sentences(*sizes)
        for texts, cuts in batches:
            left, removed = [], []
            for at in range(0, len(texts), 256):  # few texts alive at once
                for text, spots in zip(texts.slice(at, 256).to_pylist(),
                                       cuts.slice(at, 256).to_pylist()):
                    new, gone = (None, None) if spots is None else tool.without(
                        text, [(s["first"], s["count"]) for s in spots])
                    left.append(new)
                    removed.append(gone)
            yield pa.StructArray.from_arrays(
                [pa.array(left, pa.string()), pa.array(removed, pa.int32())],
                names=["text", "removed"])

    return clean


def remove_repeats(docs: DataFrame, *, sentences: int = 2, min_words: int = 30, alone: int = 50,
                   whole: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the text cleaned, plus n_sentences and n_removed.

    Columns of these two names in ``docs`` are replaced; any other name may
    occur. Equal rows under one id count as one occurrence and are all treated
    alike; other rows that share an id are ordered by a hash of their text.
    Rows with a null id are neither compared nor changed (both counts null).
    Null and empty texts have no sentences and stay; a text of which nothing is
    left is empty. A text that loses nothing is returned unchanged, to the byte,
    and never leaves the JVM after its one reading.
    """
    sizes = (sentences, min_words, alone, whole)
    keep = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    named = F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("version")
    spans = materialize(_spans(
        docs.filter(F.col(id_col).isNotNull()).select(*named, F.col(text_col).alias("text")),
        sizes), "spans")
    spot, one = ["doc_id", "version", "first", "count"], ["high", "low"]
    real = spans.filter("low IS NOT NULL")
    repeated = materialize(
        real.groupBy(*one).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        .filter("lo < hi").select(*one, "lo"), "repeats")
    cuts = real.join(repeated, one).filter("doc_id > lo").select(spot)
    # Rows that share an id but not their text: the smallest version has what others repeat.
    shared = materialize(
        spans.filter("count = 0").groupBy("doc_id")
        .agg(F.min("version").alias("lo"), F.max("version").alias("hi"))
        .filter("lo < hi").select("doc_id"), "shared")
    inside = real.join(checked_broadcast(shared), "doc_id")
    earliest = inside.groupBy("doc_id", *one).agg(
        F.min("version").alias("lo"), F.max("version").alias("hi")).filter("lo < hi")
    later = inside.join(earliest, ["doc_id", *one]).filter("version > lo").select(spot)
    # Each document's own row says how many sentences it has, the others what to cut.
    found = materialize(
        spans.filter("low IS NULL").select(spot).unionByName(cuts).unionByName(later)
        .groupBy("doc_id", "version")
        .agg(F.max(F.when(F.col("count") == 0, F.col("first"))).alias("total"),
             F.collect_set(F.when(F.col("count") > 0, F.struct("first", "count"))).alias("cuts"))
        .select("doc_id", "version", "total",
                F.when(F.size("cuts") > 0, F.col("cuts")).alias("cuts")), "cuts")
    joined = docs.select(*named, F.struct(*keep).alias("row")).join(
        found, ["doc_id", "version"], "left").select("row", "total", "cuts")
    text = F.col("row").getField(text_col)
    cleaned = joined.withColumn("new", _cleaned(sizes)(
        F.when(F.col("cuts").isNotNull(), text), F.col("cuts")))
    return cleaned.select(
        *(F.coalesce("new.text", text).alias(c) if c == text_col else F.col("row").getField(c).alias(c)
          for c in keep),
        F.col("total").alias("n_sentences"),
        F.when(F.col("total").isNotNull(), F.coalesce("new.removed", F.lit(0))).alias("n_removed"))
