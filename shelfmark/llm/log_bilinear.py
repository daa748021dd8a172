"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

The words before a token predict a vector (each position weighs the
components of its word's vector), its product with a word's output vector plus
the word's bias is the word's score, and scores are normalised over the
vocabulary by a batched matrix product. The vocabulary is the most frequent
words, the end of a text, and one class for all other words; inside that class
a word's share is its count plus one, so probabilities of all words and of
one unknown word sum to 1.

Counts cover every training text: each task adds up its own words and the sums
are shuffled by word. Every task trains on all of its training tokens (a
minibatch shares its noise words, so scores and gradients are matrix products)
and the parameters are averaged over tasks by number of tokens, row by row.
Scoring needs the count of every token: those of the most frequent words
travel with the tasks (a fixed number), all others are joined by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import WordHashes, words_of
from shelfmark.session import materialize

END = -1  # stands for the end of a text among word hashes
CLASSES, HEAD, WIDTH, BATCH, NOISE, SLICE = 1_023, 100_000, 32, 1_024, 64, 200_000


def token_hashes(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Hashes of the words and then the end."""
    found = np.append(hashes.of(words_of(text)), np.uint64(0)).view(np.int64)
    found[:-1][found[:-1] == END] = END - 1
    found[-1] = END
    return found


def count_words(texts: DataFrame) -> DataFrame:
    """(hash, n) over all rows of (text)."""

    def kernel(batches):
        hashes = WordHashes()
        for batch in batches:
            found = [token_hashes(t, hashes) for t in batch.column(0).to_pylist()]
            if found:
                values, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values), pa.array(counts)], names=["hash", "n"])

    return texts.mapInArrow(kernel, "hash long, n long").groupBy("hash").agg(
        F.sum("n").alias("n"))


class Vocabulary:
    """Class numbers of token hashes; the class after the last word is all others."""

    def __init__(self, words: np.ndarray):
        self.words = np.sort(words)
        self.other = len(words)
        self.end = int(np.searchsorted(self.words, END))

    def of(self, tokens: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.words, tokens)
        inside = at < len(self.words)
        inside[inside] = self.words[at[inside]] == tokens[inside]
        return np.where(inside, at, self.other)


def contexts(classes: list[np.ndarray], order: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(targets, the ``order`` classes before each): a text begins after ends."""
    targets = np.concatenate(classes)
    before = np.empty((len(targets), order), np.int64)
    at = 0
    for one in classes:
        for i in range(order):
            before[at:at + len(one), i] = np.concatenate(
                [np.full(min(i + 1, len(one)), end), one[:max(0, len(one) - i - 1)]])
        at += len(one)
    return targets, before


class LogBilinear:
    """Parameters r (context vectors), q (output vectors), b (biases), c (position weights)."""

    def __init__(self, counts: np.ndarray, order: int, width: int = WIDTH, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.share = counts / counts.sum()
        self.r = rng.normal(0, 0.3, (len(counts), width)).astype(np.float32)
        self.q = rng.normal(0, 0.1, (len(counts), width)).astype(np.float32)
        self.b = np.log(np.maximum(self.share, 1e-12)).astype(np.float32)
        self.c = np.full((order, width), 1 / order, np.float32)
        self.sums = [np.full_like(p, 0.1) for p in self.parts()]

    def parts(self) -> list[np.ndarray]:
        return [self.r, self.q, self.b, self.c]

    def predicted(self, before: np.ndarray) -> np.ndarray:
        return (self.r[before] * self.c).sum(axis=1)

    def log_probabilities(self, before: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural logs, normalised over all classes; equal contexts are computed once."""
        code = np.zeros(len(before), np.int64)
        for column in before.T:
            code = code * len(self.b) + column
        _, first, which = np.unique(code, return_index=True, return_inverse=True)
        guess, total = self.predicted(before[first]), np.empty(len(first), np.float32)
        for s in range(0, len(first), 4096):
            scores = guess[s:s + 4096] @ self.q.T
            scores += self.b
            top = scores.max(axis=1, keepdims=True)
            scores -= top
            np.exp(scores, out=scores)
            total[s:s + 4096] = np.log(scores.sum(axis=1)) + top[:, 0]
        own = np.einsum("ij,ij->i", guess[which], self.q[targets]) + self.b[targets]
        return (own - total[which]).astype(float)

    def train(self, targets: np.ndarray, before: np.ndarray, rng, rate: float) -> None:
        """One pass of noise-contrastive estimation in shuffled minibatches."""
        log_noise = np.log(NOISE * np.maximum(self.share, 1e-12)).astype(np.float32)
        ends = np.cumsum(self.share)
        order = rng.permutation(len(targets))
        for s in range(0, len(order), BATCH):
            at = order[s:s + BATCH]
            y, h = targets[at], before[at]
            noise = np.minimum(np.searchsorted(ends, rng.random(NOISE)), len(ends) - 1)
            guess = self.predicted(h)
            true = np.einsum("ij,ij->i", guess, self.q[y]) + self.b[y] - log_noise[y]
            false = guess @ self.q[noise].T + (self.b[noise] - log_noise[noise])
            up = (1 / (1 + np.exp(np.clip(true, -30, 30)))).astype(np.float32)
            down = (1 / (1 + np.exp(-np.clip(false, -30, 30)))).astype(np.float32)
            d_guess = up[:, None] * self.q[y] - down @ self.q[noise]
            d_q = _summed(y, up[:, None] * guess, len(self.b))
            np.subtract.at(d_q, noise, down.T @ guess)
            d_b = np.bincount(y, up, len(self.b)).astype(np.float32)
            np.subtract.at(d_b, noise, down.sum(axis=0))
            d_r, d_c = np.zeros_like(self.r), np.empty_like(self.c)
            for i in range(h.shape[1]):
                d_r += _summed(h[:, i], d_guess * self.c[i], len(self.b))
                d_c[i] = (d_guess * self.r[h[:, i]]).sum(axis=0) / len(y)
            for part, slope, total in zip(self.parts(), (d_r, d_q, d_b, d_c), self.sums):
                total += slope * slope
                part += rate * slope / np.sqrt(total)


def _summed(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """``values`` added up by row number."""
    order = np.argsort(rows, kind="stable")
    names, starts = np.unique(rows[order], return_index=True)
    out = np.zeros((size, values.shape[1]), np.float32)
    out[names] = np.add.reduceat(values[order], starts, axis=0)
    return out


def fit(texts: DataFrame, vocabulary: Vocabulary, counts: np.ndarray, order: int,
        rate: float = 0.1) -> LogBilinear:
    """Every task trains on its own texts; parameters are averaged by row."""

    def kernel(batches):
        hashes, model = WordHashes(), LogBilinear(counts, order)
        rng = np.random.default_rng(TaskContext.get().partitionId())
        held, size, seen = [], 0, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(vocabulary.of(token_hashes(text, hashes)))
                size += len(held[-1])
                if size >= SLICE:
                    model.train(*contexts(held, order, vocabulary.end), rng, rate)
                    held, size, seen = [], 0, seen + size
        if size:
            model.train(*contexts(held, order, vocabulary.end), rng, rate)
            seen += size
        if seen:
            flat = [(k, i, row) for k, part in enumerate(model.parts())
                    for i, row in enumerate(part.reshape(len(part), -1))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in flat], pa.int32()),
                 pa.array([f[1] for f in flat], pa.int32()),
                 pa.array([f[2].astype(float) * seen for f in flat], pa.list_(pa.float64())),
                 pa.array([seen] * len(flat), pa.int64())],
                names=["part", "row", "sums", "seen"])

    trained = texts.mapInArrow(kernel, "part int, row int, sums array<double>, seen long")
    rows = (
        trained.select("part", "row", "seen", F.posexplode("sums").alias("col", "value"))
        .groupBy("part", "row", "col")
        .agg((F.sum("value") / F.sum("seen")).alias("value")).toArrow()
    )  # as many values as the model has, whatever the corpus
    model = LogBilinear(counts, order)
    part, row, col, value = (rows.column(i).to_numpy() for i in range(4))
    for k, target in enumerate(model.parts()):
        own = part == k
        target.reshape(len(target), -1)[row[own], col[own]] = value[own]
    return model


def _score(docs: DataFrame, model: LogBilinear, vocabulary: Vocabulary, head: np.ndarray,
           head_counts: np.ndarray, order: int) -> DataFrame:
    """Per row: sums over its tokens, and the hashes of those the head does not hold."""

    def kernel(batches):
        hashes = WordHashes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out, held, size = [], [], 0

            def flush():
                nonlocal held, size
                if not held:
                    return None
                classes = [vocabulary.of(tokens) for _, tokens in held]
                targets, before = contexts(classes, order, vocabulary.end)
                logs = model.log_probabilities(before, targets) / np.log(10)
                tokens = np.concatenate([t for _, t in held])
                at = np.minimum(np.searchsorted(head, tokens), len(head) - 1)
                known = head[at] == tokens
                log_count = np.where(known, np.log10(head_counts[at] + 1.0), 0.0)
                others = targets == vocabulary.other
                starts = np.cumsum([0, *(len(c) for c in classes[:-1])])

                def by_text(values):
                    return np.add.reduceat(values, starts)

                rare = [np.unique(t[~known[s:s + len(t)]], return_counts=True)
                        for s, (_, t) in zip(starts, held)]
                result = pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in held], pa.int64()),
                     pa.array([len(c) for c in classes], pa.int64()),
                     pa.array(by_text((known & (head_counts[at] > 0)).astype(np.int64))),
                     pa.array(by_text(others.astype(np.int64))),
                     pa.array(by_text(log_count)), pa.array(by_text(log_count * others)),
                     pa.array(by_text(logs)),
                     pa.array([r[0] for r in rare], pa.list_(pa.int64())),
                     pa.array([r[1] for r in rare], pa.list_(pa.int64()))],
                    names=["doc_id", "n_tokens", "known", "others", "base", "inside", "lm",
                           "rare", "times"])
                held, size = [], 0
                return result

            for i, text in zip(ids, texts):
                held.append((i, token_hashes(text, hashes)))
                size += len(held[-1][1])
                if size >= SLICE:
                    yield flush()
            if held:
                yield flush()

    return docs.mapInArrow(
        kernel, "doc_id long, n_tokens long, known long, others long, base double, "
                "inside double, lm double, rare array<long>, times array<long>")


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                folds: int = 7, held_fold: int = 2, order: int = 2, classes: int = CLASSES,
                head_words: int = HEAD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learned from rows whose crc32(id) mod ``folds`` is not ``held_fold``; a
    null id is not held out. A null or empty text is its end token alone.
    Repeated rows are counted and scored each, other columns are ignored, and
    texts of any length are scored whole. Without training rows all counts are
    0 and both scores are those of unknown words. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_fold, F.lit(False))
    learn = rows.filter(~held).select("text")
    counts = materialize(count_words(learn), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("n"), "hash").limit(head_words).toArrow()  # a fixed number of rows
    hashes, numbers = (top.column(i).to_numpy() for i in range(2))
    if END not in hashes[:classes]:  # the end is always a class of its own
        end, words = counts.filter(F.col("hash") == END).first(), hashes != END
        hashes = np.concatenate([[END], hashes[words]]).astype(np.int64)
        numbers = np.concatenate([[end["n"] if end else 0], numbers[words]]).astype(np.int64)
    vocabulary = Vocabulary(hashes[:classes])
    by_class = np.zeros(vocabulary.other + 1)
    by_class[vocabulary.of(hashes[:classes])] = numbers[:classes]
    other_tokens = int(total - numbers[:classes].sum())
    other_words = int(distinct - (numbers[:classes] > 0).sum())
    by_class[-1] = other_tokens + other_words + 1
    by_class = np.maximum(by_class, 0.5)
    model = fit(learn, vocabulary, by_class, order)

    ranks = np.argsort(hashes)
    scored = materialize(
        _score(rows, model, vocabulary, hashes[ranks], numbers[ranks], order)
        .withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = (
        scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r"))
        .select("row", "r.rare", "r.times").join(
            counts.withColumnRenamed("hash", "rare"), "rare")
        .groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"),
                            F.sum("times").alias("found"))
    )
    base_all = float(np.log10(total + distinct + 1.0))
    base_other = float(np.log10(other_tokens + other_words + 1.0))
    more = F.coalesce("more", F.lit(0.0))
    return scored.drop("rare", "times").join(rare, "row", "left").select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_fold,
                             F.lit(False)).alias("held_out"),
        "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * base_all).alias("base_score"),
        (F.col("lm") + F.col("inside") + more - F.col("others") * base_other).alias("score"))
