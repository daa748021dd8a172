"""Toxicity of texts: a lexicon trie met by Levenshtein automata, hits weighed by context.

The lexicon is learned from labelled rows: whole words, and stems that words
begin with, that are far more frequent in toxic documents than in clean ones.
They form one trie. A word is turned into its Levenshtein automaton, whose
states (place in the word, edits so far) are carried down the trie together,
so one descent finds every term within one edit; short terms must match as
they are. Misspellings that clean training texts use as ordinary words are
left out. Around each hit a window of words decides whether it is quoted (an
opening mark before it and a closing one after it); quoted and open hits are
separate inputs of a logistic model over the strength and density of hits.

The model is fitted on at most ``sample`` labelled rows, chosen by a hash of
their id (a fixed bound, whatever the size); every text is then scored whole,
in one scan, without a shuffle.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import lean
from shelfmark.session import materialize

PART = re.compile(r"[^\W_]+")
OPENING, CLOSING = "\"“„«‘'‹", "\"”“»’'›"
STEMS, WINDOW, MOST_TERMS, REMEMBERED = range(4, 8), 12, 2_000, 200_000


class Lexicon:
    """Terms with weights in a trie; stems match any word that begins with them."""

    def __init__(self, terms: dict[tuple[str, bool], float], innocent: frozenset[str] = frozenset(),
                 fuzzy_from: int = 5):
        self.root: dict = {}
        self.innocent, self.fuzzy_from = innocent, fuzzy_from
        for (term, stem), weight in terms.items():
            node = self.root
            for letter in term:
                node = node.setdefault(letter, {})
            node.setdefault("ends", []).append((len(term), stem, weight))

    def find(self, word: str) -> tuple[int, float] | None:
        """(edits, weight) of the best term: fewest edits, then the greatest weight.

        The automaton's state without an edit goes down the trie with the
        word; at every node on the way it branches into the states with one
        edit (a letter left out, replaced or put in), which go on letter by
        letter and mostly end at once.
        """
        best: tuple[int, float] | None = None
        size, node, i = len(word), self.root, 0

        def accept(node: dict, i: int, edits: int) -> None:
            nonlocal best
            for length, stem, weight in node.get("ends", ()):
                if (stem or i == size) and (not edits or length >= self.fuzzy_from + stem):
                    if best is None or (edits, -weight) < (best[0], -best[1]):
                        best = (edits, weight)

        def follow(node: dict, i: int) -> None:
            while node is not None:
                if "ends" in node:
                    accept(node, i, 1)
                node = node.get(word[i]) if i < size else None
                i += 1

        while node is not None:
            if "ends" in node:
                accept(node, i, 0)
            now, after = word[i:i + 1], word[i + 1:i + 2]
            if after in node:
                follow(node, i + 1)
            for letter, child in node.items():
                if letter != "ends":
                    if letter != now and now and (not after or after in child or "ends" in child):
                        follow(child, i + 1)
                    if not now or now in child or "ends" in child:
                        follow(child, i)
            if "ends" in node and i < size:
                accept(node, i + 1, 1)
            node = node.get(now) if now else None
            i += 1
        if best and best[0] and word in self.innocent:
            return None
        return best


class Matcher(dict):
    """Raw words and what they hit, remembered for frequent ones."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def __missing__(self, raw: str):
        hit = None
        for word in PART.findall(raw.lower()):
            found = self.lexicon.find(word)
            if found and (hit is None or (found[0], -found[1]) < (hit[0], -hit[1])):
                hit = (*found, word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[raw] = hit
        return hit

    def hits(self, text: str | None) -> tuple[list[tuple[int, tuple]], list[str]]:
        words = text.split() if text else []
        found = list(map(self.__getitem__, words))
        return [(i, h) for i, h in enumerate(found) if h], words


def quoted(words: list[str], at: int) -> bool:
    """Whether a quotation opens before word ``at`` and closes after it, within the window."""
    opened = False
    for i in range(at, max(-1, at - WINDOW - 1), -1):
        if i < at and words[i].rstrip(".,;:!?")[-1:] in CLOSING:
            return False
        if words[i][0] in OPENING:
            opened = True
            break
    if not opened:
        return False
    return any(words[i].rstrip(".,;:!?")[-1:] in CLOSING for i in
               range(at, min(len(words), at + WINDOW + 1)))


def features(matcher: Matcher, text: str | None) -> list[float]:
    """Strength of open exact, open misspelled and quoted hits, and open hits per 100 words."""
    hits, words = matcher.hits(text)
    exact = fuzzy = held = 0.0
    count = 0
    for at, (edits, weight, _) in hits:
        if quoted(words, at):
            held += weight
        elif edits:
            fuzzy, count = fuzzy + weight, count + 1
        else:
            exact, count = exact + weight, count + 1
    return [math.log1p(exact), math.log1p(fuzzy), math.log1p(held),
            math.log1p(100.0 * count / max(1, len(words)))]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Weights and intercept (last) by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty @ w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, slope)
    return w


def _terms(sample: DataFrame, min_docs: int, min_share: float, purity: float) -> dict[tuple[str, bool], float]:
    """Words and stems of toxic texts with their log odds, from document counts by label."""

    def kernel(batches):
        for batch in batches:
            counts: dict[tuple[str, bool], list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(PART.findall(text.lower())) if text else set()
                seen = {(w, False) for w in words if 3 <= len(w) <= 40}
                seen.update((w[:n], True) for w in words for n in STEMS if n <= len(w) <= 40)
                for term in seen:
                    counts.setdefault(term, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in counts]), pa.array([s for _, s in counts], pa.bool_()),
                 pa.array([c[1] for c in counts.values()], pa.int64()),
                 pa.array([c[0] for c in counts.values()], pa.int64())],
                names=["term", "stem", "toxic", "clean"])

    totals = {bool(r["toxic"]): r["n"] for r in
              sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return {}
    odds = F.log((F.col("toxic") + 0.5) / (totals[True] + 1)) - F.log(
        (F.col("clean") + 0.5) / (totals[False] + 1))
    rows = (
        sample.select("text", F.col("toxic").cast("int").alias("toxic"))
        .mapInArrow(kernel, "term string, stem boolean, toxic long, clean long")
        .groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter(F.col("toxic") >= max(min_docs, min_share * totals[True]))
        .filter(F.col("toxic") >= purity * (F.col("toxic") + F.col("clean")))
        .withColumn("odds", odds)
        .orderBy(F.desc("toxic"), F.desc(F.length("term")), "stem", "term")
        .limit(4 * MOST_TERMS).collect()
    )
    # The most frequent first, of equally frequent ones the longest: a term is
    # left out if it begins with a chosen stem or if a chosen term begins with it.
    chosen: dict[tuple[str, bool], float] = {}
    stems: set[str] = set()
    begun: set[str] = set()
    for r in rows:
        term = r["term"]
        if term in begun or any(term[:n] in stems for n in STEMS):
            continue
        chosen[term, r["stem"]] = min(8.0, r["odds"])
        begun.update(term[:n] for n in range(1, len(term) + 1))
        if r["stem"]:
            stems.add(term)
        if len(chosen) == MOST_TERMS:
            break
    return chosen


def _innocent(sample: DataFrame, terms: dict[tuple[str, bool], float]) -> frozenset[str]:
    """Words one edit from a term that clean texts use at least as readily as toxic ones."""

    def kernel(batches):
        matcher = Matcher(Lexicon(terms))
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += {(h[2], toxic) for _, h in matcher.hits(text)[0] if h[0]}
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()),
                 pa.array([r[1] for r in rows], pa.bool_())], names=["word", "toxic"])

    rows = (
        sample.select("text", "toxic").mapInArrow(kernel, "word string, toxic boolean")
        .groupBy("word").agg(F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic"))
                             .alias("good"))
        .filter("good > 0 AND good >= bad").orderBy(F.desc("good"), "word").limit(20_000).collect()
    )
    return frozenset(r["word"] for r in rows)


def train(docs: DataFrame, labels: DataFrame, *, sample: int = 20_000, min_docs: int = 5,
          min_share: float = 0.015, purity: float = 0.8) -> tuple[Lexicon, np.ndarray]:
    """The lexicon and the model's weights from (doc_id, text) and (doc_id, toxic boolean).

    Without labels of both kinds the lexicon is empty and every score is the
    share of toxic labels (0 without any).
    """
    ids = materialize(labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labelled")
    rows = materialize(  # at most ``sample`` ids: a bounded broadcast
        docs.join(F.broadcast(ids), "doc_id").select("text", "toxic"), "sample")
    terms = _terms(rows, min_docs, min_share, purity)
    if not terms:
        share = rows.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
        base = -30.0 if not share else math.log(share / (1 - share)) if share < 1 else 30.0
        return Lexicon({}), np.array([0.0, 0.0, 0.0, 0.0, base])
    innocent = _innocent(rows, terms)

    def kernel(batches):
        matcher = Matcher(Lexicon(terms, innocent))
        for batch in batches:
            found = [features(matcher, t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    fitted = rows.mapInArrow(kernel, "x array<double>, toxic boolean").toArrow()
    x = np.array(fitted.column("x").to_pylist(), float)
    return Lexicon(terms, innocent), fit_logistic(x, fitted.column("toxic").to_numpy().astype(float))


def score(docs: DataFrame, lexicon: Lexicon, weights: np.ndarray, *, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""

    def kernel(batches):
        matcher = Matcher(lexicon)
        for batch in batches:
            x = np.array([features(matcher, t) for t in batch.column(1).to_pylist()], float)
            z = np.clip(x.reshape(-1, 4) @ weights[:4] + weights[4], -30, 30)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1 / (1 + np.exp(-z)))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).alias("text")).mapInArrow(
        lean(kernel), "doc_id long, score double")


def keep_clean(docs: DataFrame, lexicon: Lexicon, weights: np.ndarray, *,
               text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score under ``limit``."""
    at = docs.columns.index(text_col)

    def kernel(batches):
        matcher = Matcher(lexicon)
        for batch in batches:
            x = np.array([features(matcher, t) for t in batch.column(at).to_pylist()], float)
            z = x.reshape(-1, 4) @ weights[:4] + weights[4]
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))) < limit))

    return docs.mapInArrow(lean(kernel), docs.schema)


def training_labels(labels: DataFrame, folds: int = 5) -> DataFrame:
    """(doc_id, toxic) outside the held-out fold; a document labelled twice is toxic if ever so."""
    return labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(
        fold(F.col("doc_id"), folds) != 0).groupBy("doc_id").agg(
        F.max(F.col("toxic") == 1).alias("toxic"))


def fold(doc_id, folds: int):
    return F.crc32(doc_id.cast("string")) % folds


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id",
             text_col: str = "text", folds: int = 5, sample: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Labels are learned only from ids outside fold 0; a score depends on the
    text alone. Null and empty texts score as texts without hits, a null id is
    not held out, repeated rows are scored each, other columns are ignored and
    an empty table gives no rows.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.col(text_col).alias("text"))
    lexicon, weights = train(named, training_labels(labels, folds), sample=sample)
    return score(named, lexicon, weights).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), folds) == 0, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
