"""Packing whole documents into sequences whose every window holds the target mixture.

Each source is a queue of tokens. A window of several sequences is filled by
deficit round robin: every source is credited its share of the window, spends
whole tokens of its credit and carries the rest, so that the mixture is right
in each window and exact over many. Sequences are full but for the last one.

How it is spread out: a document's place in its queue is the sum over earlier
partitions plus what its own task has counted. The token counts of all queues
at any place of the output follow from the totals alone (the tokens in order
of virtual time (2k - 1) / 2w, decided in whole numbers), so the output is cut
into groups of windows that are filled independently: every group knows what
each source has been given before it, and with it the deficits it starts from.
A group is a fixed number of tokens, whatever the sizes of documents or sources.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import checked_broadcast, lean, partitions, sorted_groups
from shelfmark.llm.tokens import Encoder, encoding, slices
from shelfmark.session import materialize

# Sources beyond the largest so many share one queue.
MAX_QUEUES = 10_000
REST = "rest"


class Schedule:
    """How many tokens each queue has given once ``x`` are out; all in whole numbers."""

    def __init__(self, totals: list[int], weights: list[int]):
        self.totals, self.weights = totals, weights
        self.size = sum(totals)
        self.known: dict[int, list[int]] = {0: [0] * len(totals), self.size: list(totals)}
        # Virtual time runs until queue i is empty at totals[i] / weights[i].
        self.ends = sorted(range(len(totals)), key=lambda i: totals[i] / weights[i])

    def _time(self, x: int) -> float:
        """The virtual time by which about ``x`` tokens are out."""
        rate, before, last = float(sum(self.weights)), 0.0, 0.0
        for i in self.ends:
            end = self.totals[i] / self.weights[i]
            if before + rate * (end - last) >= x or rate <= 0:
                break
            before, last = before + rate * (end - last), end
            rate -= self.weights[i]
        return last + (x - before) / rate if rate > 0 else last

    def given(self, x: int) -> list[int]:
        """The first ``x`` tokens by (virtual time, queue), counted by queue."""
        x = min(x, self.size)
        if x in self.known:
            return self.known[x]
        time = self._time(x)
        # A little early, so that tokens are only added, in exact order.
        out = [max(0, min(t, int(w * time + 0.5) - 2))
               for t, w in zip(self.totals, self.weights)]
        while (over := sum(out) - x) > 0:
            out = [max(0, n - over) for n in out]
        # Tokens at times up to the latest one taken must all be taken.
        out = self._even(out)
        missing = x - sum(out)
        heap = [_Next(2 * n + 1, w, i) for i, (n, w, t) in
                enumerate(zip(out, self.weights, self.totals)) if n < t]
        heapq.heapify(heap)
        for _ in range(missing):
            top = heap[0]
            i = top.queue
            out[i] += 1
            if out[i] < self.totals[i]:
                heapq.heapreplace(heap, _Next(2 * out[i] + 1, self.weights[i], i))
            else:
                heapq.heappop(heap)
        self.known[x] = out
        return out

    def _even(self, out: list[int]) -> list[int]:
        """The largest prefix by virtual time inside ``out``: cut at the earliest next token."""
        nexts = [_Next(2 * n + 1, w, i) for i, (n, w, t) in
                 enumerate(zip(out, self.weights, self.totals)) if n < t]
        if not nexts:
            return out
        first = min(nexts)
        cut = []
        for i, (n, w) in enumerate(zip(out, self.weights)):
            # Tokens k with (2k - 1) / w before (odd / w of the first), ties by queue.
            limit = first.odd * w
            k = (limit // first.weight + 1) // 2
            if k and (2 * k - 1) * first.weight == limit and i >= first.queue:
                k -= 1
            cut.append(min(n, k))
        return cut


class _Next:
    """The virtual time odd / (2 * weight) of a queue's next token."""

    __slots__ = ("odd", "weight", "queue")

    def __init__(self, odd: int, weight: int, queue: int):
        self.odd, self.weight, self.queue = odd, weight, queue

    def __lt__(self, other: _Next) -> bool:
        a, b = self.odd * other.weight, other.odd * self.weight
        return (a, self.queue) < (b, other.queue)


def _encode(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(doc_id, source, part, at, n, ids); ``at`` counts the task's own tokens of the source."""

    def kernel(batches):
        with encoding(vocabulary) as model:
            yield from encoded(batches, model)

    def encoded(batches, model):
        counts: dict[str | None, int] = {}
        part, end = TaskContext.get().partitionId(), np.array([end_id], model.dtype).tobytes()
        for batch in batches:
            keys, names, texts = (c.to_pylist() for c in batch.columns)
            for start, stop in slices(texts):
                data = [ids + end for ids in model.encode(texts[start:stop])]
                sizes = [len(ids) // model.dtype.itemsize for ids in data]
                places = []
                for name, n in zip(names[start:stop], sizes):
                    places.append(counts.get(name, 0))
                    counts[name] = places[-1] + n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[start:stop], pa.int64()),
                     pa.array(names[start:stop], pa.string()),
                     pa.array([part] * len(data), pa.int64()), pa.array(places, pa.int64()),
                     pa.array(sizes, pa.int64()), pa.array(data, pa.binary())],
                    names=["doc_id", "source", "part", "at", "n", "ids"])

    return docs.mapInArrow(
        lean(kernel), "doc_id long, source string, part long, at long, n long, ids binary")


def _segments(rows: DataFrame, schedule: Schedule, group_tokens: int, dtype: str) -> DataFrame:
    """Documents cut where the groups of the output cut their queue."""

    def kernel(batches):
        step, groups = np.dtype(dtype).itemsize, -(-schedule.size // group_tokens)

        def edge(group: int, queue: int) -> int:
            return schedule.given(group * group_tokens)[queue]

        for batch in batches:
            out = []
            for doc_id, queue, start, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                lo, hi = 0, groups  # the last group whose edge is at or before the start
                while hi - lo > 1:
                    mid = (lo + hi) // 2
                    lo, hi = (mid, hi) if edge(mid, queue) <= start else (lo, mid)
                group, done = lo, 0
                while done < n:
                    stop = min(n, edge(group + 1, queue) - start)
                    if stop > done:
                        out.append((group, queue, start + done, doc_id, done, n,
                                    ids[done * step:stop * step]))
                        done = stop
                    group += 1
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 6 + [pa.binary()])],
                    names=["group", "queue", "place", "doc_id", "start", "doc_tokens", "ids"])

    return rows.mapInArrow(lean(kernel), "group long, queue long, place long, doc_id long, "
                                   "start long, doc_tokens long, ids binary")


def deficit_windows(quotas: dict[int, int], credit: dict[int, float], weights: dict[int, int],
                    window: int):
    """Deficit round robin over one group: (queue, tokens) in the order served.

    ``quotas`` is what each queue gives to the group, ``credit`` its deficit so
    far. Each window credits every queue that is not empty with its share,
    takes whole tokens, and fills what fractions leave open from the queues
    with the largest deficits. The queue that is served first rotates.
    """
    queues = sorted(q for q, n in quotas.items() if n)
    left = np.array([quotas[q] for q in queues], np.int64)
    weight = np.array([weights[q] for q in queues], float)
    deficit = np.array([credit[q] for q in queues], float)
    turn = 0
    while total := int(left.sum()):
        space = min(window, total)
        active = left > 0
        deficit[active] += space * weight[active] / weight[active].sum()
        take = np.clip(np.floor(deficit), 0, left).astype(np.int64)
        over = int(take.sum()) - space
        for i in np.argsort(deficit - take, kind="stable"):  # carried credit exceeds the space
            if over <= 0:
                break
            back = min(over, int(take[i]))
            take[i] -= back
            over -= back
        space -= int(take.sum())
        while space:
            order = np.argsort(-(deficit - take), kind="stable")
            for i in order[(left - take)[order] > 0]:
                more = min(space, int(left[i] - take[i]),
                           max(1, int(np.ceil(deficit[i] - take[i]))))
                take[i] += more
                space -= more
                if not space:
                    break
        deficit -= take
        left -= take
        deficit[left == 0] = 0.0
        for i in np.roll(np.arange(len(queues)), -turn):
            if take[i]:
                yield queues[i], int(take[i])
        turn = (turn + 1) % len(queues)


def _fill(segments: DataFrame, schedule: Schedule, group_tokens: int, length: int, window: int,
          dtype: str) -> DataFrame:

    def kernel(batches):
        for rows in sorted_groups(batches, ["group"]):
            group = rows.column("group")[0].as_py()
            first = group * group_tokens
            given, upto = schedule.given(first), schedule.given(first + group_tokens)
            quotas = {i: b - a for i, (a, b) in enumerate(zip(given, upto)) if b > a}
            # What the shares of the tokens so far would have been, less what was given.
            pace = schedule._time(first)
            credit = {q: min(schedule.weights[q] * pace, schedule.totals[q]) - given[q]
                      for q in quotas}
            queue, doc, start, total = (
                rows.column(c).to_numpy() for c in ("queue", "doc_id", "start", "doc_tokens"))
            null = rows.column("doc_id").is_null().to_numpy()
            data = rows.column("ids").to_pylist()
            step = np.dtype(dtype).itemsize
            nxt = {q: int(np.searchsorted(queue, q)) for q in quotas}
            used = dict.fromkeys(quotas, 0)
            out, place = [], 0
            for q, need in deficit_windows(quotas, credit, dict(enumerate(schedule.weights)),
                                           window):
                while need:
                    row, skip = nxt[q], used[q]
                    have = len(data[row]) // step - skip
                    n = min(need, have, length - place % length)
                    ids = np.frombuffer(data[row], dtype, n, skip * step).astype("<u4")
                    out.append((None if null[row] else int(doc[row]), int(start[row]) + skip, n,
                                zlib.crc32(ids.tobytes()), int(total[row]),
                                (first + place) // length, place % length))
                    place, need = place + n, need - n
                    nxt[q], used[q] = (row + 1, 0) if n == have else (row, skip + n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*out)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                       "offset"])

    keys = ["group", "queue", "place"]
    return (
        segments.repartition(partitions(segments), "group").sortWithinPartitions(*keys)
        .mapInArrow(lean(kernel), "doc_id long, start long, length long, ids_crc32 long, "
                            "doc_tokens long, sequence_id long, offset long")
    )


def pack(docs: DataFrame, vocabulary: str, *, end_id: int = 1, length: int = 2048,
         window_sequences: int = 16, group_windows: int = 32,
         targets: dict[str, float] | None = None, id_col: str = "doc_id",
         text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    All tokens of all documents are placed once. ``targets`` gives the wanted
    shares by source (default: the sources' own token shares, so that all
    queues end together); sources it does not name come when those are used
    up, and a source that runs dry leaves its share to the others. Null or
    empty texts are the end id alone, a null source is a queue of its own, and
    sources beyond the largest MAX_QUEUES share one queue. Rows that repeat
    are packed as often as they come. Other columns are ignored; an empty
    table gives no rows.
    """
    window = length * window_sequences
    group_tokens = window * group_windows
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(source_col).cast("string").alias("source"),
                       F.col(text_col).alias("text"))
    named = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    encoded = materialize(_encode(docs, vocabulary, end_id), "encoded", compression="zstd")
    encoded = encoded.withColumn("name", named)
    totals = encoded.groupBy("name").agg(F.sum("n").alias("n"))
    queues = totals.orderBy(F.desc("n"), "name").limit(MAX_QUEUES + 1).collect()
    if not queues:
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                "sequence_id long, offset long")
    if len(queues) > MAX_QUEUES:
        top = docs.sparkSession.createDataFrame(
            [(q["name"],) for q in queues[:MAX_QUEUES]], "name string")
        encoded = encoded.join(F.broadcast(top.withColumn("own", F.col("name"))), "name", "left"
                               ).withColumn("name", F.coalesce("own", F.lit(REST))).drop("own")
        queues = encoded.groupBy("name").agg(F.sum("n").alias("n")).collect()
    names = sorted(q["name"] for q in queues)
    sizes = {q["name"]: q["n"] for q in queues}
    if targets is None:
        weights = [sizes[n] for n in names]
    else:
        weights = [max(1, round((targets.get(n[1:], 0.0) if n[:1] == "=" else 0.0) * (1 << 40)))
                   for n in names]
    schedule = Schedule([sizes[n] for n in names], weights)

    # Where the tokens of each (task, queue) begin: one row per pair.
    counted = encoded.groupBy("name", "part").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("name").orderBy("part")
    numbers = docs.sparkSession.createDataFrame(list(enumerate(names)), "queue long, name string")
    bases = materialize(counted.select(
        "name", "part", (F.sum("n").over(order) - F.col("n")).alias("base")
    ).join(F.broadcast(numbers), "name"), "bases")
    rows = encoded.join(checked_broadcast(bases), ["name", "part"])
    if len(queues) <= MAX_QUEUES and REST not in names:
        place = F.col("base") + F.col("at")
    else:  # a task counts by source, so places inside the shared queue are summed up here
        inside = Window.partitionBy("name", "part").orderBy("source", "at")
        place = F.col("base") + F.sum("n").over(inside) - F.col("n")
    rows = rows.select("doc_id", "queue", place.alias("place"), "n", "ids")
    dtype = Encoder(vocabulary).dtype.str
    return _fill(_segments(rows, schedule, group_tokens, dtype), schedule, group_tokens,
                 length, window, dtype)
